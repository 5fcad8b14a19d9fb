"""SQL with the aggregate ST_Extent.

A SQL function may not hold an aggregate, so ``sql`` writes each call out as minima and maxima of the bounds
before Spark parses the text, each from its own side alone: FILTER and OVER go to all four, DISTINCT makes no difference and is dropped. Quoted
text and comments are left alone. An item of a select list without a name keeps the call's text as its name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestrata.functions.geometry import LARGEST, register
from lodestrata.functions.wkb import register_formats

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|\w+|\s+|.", re.S)


def _skip(tokens: list[str], i: int) -> int:
    """The next place that is neither white space nor a comment."""
    while i < len(tokens) and (tokens[i].isspace() or tokens[i].startswith(("--", "/*"))):
        i += 1
    return i


def _closing(tokens: list[str], i: int) -> int:
    """The place of the parenthesis that closes the one at ``i``."""
    depth = 0
    for j in range(i, len(tokens)):
        depth += (tokens[j] == "(") - (tokens[j] == ")")
        if not depth:
            return j
    raise ValueError("an open parenthesis in the SQL text")


def _word(tokens: list[str], i: int) -> str:
    return tokens[i].upper() if i < len(tokens) else ""


def expand(text: str) -> str:
    """``text`` with every call of ST_Extent written out."""
    tokens, out, i = _TOKEN.findall(text), [], 0
    scopes, before = [True], ""  # whether each open parenthesis holds a query; the last word or mark
    while i < len(tokens):
        t = tokens[i]
        after = _skip(tokens, i + 1)
        if t.lower() != "st_extent" or _word(tokens, after) != "(":
            if t == "(":
                scopes.append(_word(tokens, _skip(tokens, i + 1)) in ("SELECT", "WITH"))
            elif t == ")" and len(scopes) > 1:
                scopes.pop()
            if not t.isspace() and not t.startswith(("--", "/*")):
                before = t.upper()
            out.append(t)
            i += 1
            continue
        end = _closing(tokens, after)
        inner = "".join(tokens[after + 1 : end])
        argument = expand(re.sub(r"^\s*(?:DISTINCT|ALL)\s+", "", inner, flags=re.I))
        stop, suffix = end + 1, ""
        nxt = _skip(tokens, stop)
        if _word(tokens, nxt) == "FILTER":
            close = _closing(tokens, _skip(tokens, nxt + 1))
            suffix += " " + "".join(tokens[nxt : close + 1])
            stop = close + 1
            nxt = _skip(tokens, stop)
        if _word(tokens, nxt) == "OVER":
            at = _skip(tokens, nxt + 1)
            close = _closing(tokens, at) if tokens[at] == "(" else at
            suffix += " " + "".join(tokens[nxt : close + 1])
            stop = close + 1
            nxt = _skip(tokens, stop)
        side = lambda f, field, none: f"'{field}', coalesce({f}(st_{field}({argument})){suffix}, {none})"  # noqa: E731, B023
        call = f"named_struct({side('min', 'xmin', LARGEST)}, {side('min', 'ymin', LARGEST)}, {side('max', 'xmax', '-' + LARGEST)}, {side('max', 'ymax', '-' + LARGEST)})"
        alone = scopes[-1] and before in ("SELECT", ",", "DISTINCT") and _word(tokens, nxt) in ("", ",", "FROM", ")", ";")
        if alone:
            name = "".join(tokens[i : end + 1]).replace("`", "``")
            call += f" AS `{name}`"
        out.append(call)
        before, i = ")", stop
    return "".join(out)


def sql(spark: SparkSession, text: str) -> DataFrame:
    """``spark.sql`` with all ST functions, ST_Extent among them."""
    if not spark.catalog.functionExists("st_xmin"):
        register(spark)
    if not spark.catalog.functionExists("st_geomfromtext"):
        register_formats(spark)
    return spark.sql(expand(text))
