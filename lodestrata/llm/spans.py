"""Regular-expression matches with their places, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
#: Matches whose places are summed up one after the other; more are summed in pieces.
PIECE = 128


def with_matches(df: DataFrame, name: str, text: str, pattern: str, if_contains: str | None = None) -> DataFrame:
    """``df`` with the leftmost non-overlapping matches of ``pattern`` in column ``text``, as an array of
    start, end (code points, end exclusive) and matched text. The pieces between the matches give the places.

    ``if_contains``: a string that every match contains; texts without it are not searched.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(own, F.lit(pattern), F.lit(0))
    if if_contains is not None:
        found = F.when(F.contains(own, F.lit(if_contains)), found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(f"_m_{name}", found)
    m = F.col(f"_m_{name}")
    df = df.withColumn(f"_p_{name}", F.when(F.size(m) > 0, F.split(own, pattern, -1)).otherwise(F.array().cast("array<string>")))
    gaps = F.zip_with(m, F.slice(F.col(f"_p_{name}"), F.lit(1), F.size(m)), lambda a, b: F.struct(F.length(b).alias("gap"), a.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    few = lambda gaps: F.aggregate(gaps, zero, step)  # noqa: E731  adds to an array, so only a piece of many
    pieces = F.transform(F.sequence(F.lit(0), F.size(m) - 1, F.lit(PIECE)), lambda i: few(F.slice(gaps, i + 1, F.lit(PIECE))))
    starts = lambda pieces: F.aggregate(F.transform(pieces, lambda p: p["at"]), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    moved = lambda p, at: F.transform(p["out"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["m"].alias("m")))
    many = F.flatten(F.zip_with(F.col(f"_g_{name}"), F.slice(starts(F.col(f"_g_{name}")), F.lit(1), F.size(f"_g_{name}")), moved))
    df = df.withColumn(f"_g_{name}", F.when(F.size(m) > PIECE, pieces))
    none = F.array().cast(SPAN)
    spans = F.when(F.size(m) == 0, none).when(F.size(m) <= PIECE, few(gaps)["out"]).otherwise(many)
    return df.withColumn(name, spans).drop(f"_m_{name}", f"_p_{name}", f"_g_{name}")


def named(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(number, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0
