"""Well-known binary: the kind from the header by built-in functions, everything else by an Arrow function."""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.geometry import GEOMETRY, KINDS

ALL = (*KINDS, "GeometryCollection")
_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
_TYPE = pa.struct([("kind", pa.string()), ("dims", pa.int32()), ("coords", pa.list_(pa.list_(pa.list_(_VERTEX)))), ("wkt", pa.string())])


def wkb_geometry_type(wkb: Column | str) -> Column:
    """ST_GeometryType of a WKB column: codes 1 to 7, ISO and extended Z, M and ZM, both byte orders."""
    wkb = F.col(wkb) if isinstance(wkb, str) else wkb
    little = F.hex(F.substring(wkb, 1, 1)) == "01"
    digits = F.hex(F.substring(wkb, 2, 4))
    swapped = F.concat(F.substring(digits, 7, 2), F.substring(digits, 5, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    code = F.conv(F.when(little, swapped).otherwise(digits), 16, 10).cast("long")
    thousand, flags = F.floor(code % 268435456 / 1000), F.floor(code / 1073741824)
    high = flags.isin(2, 3) | thousand.isin(1, 3)
    measured = flags.isin(1, 3) | thousand.isin(2, 3)
    kind = code % 268435456 % 1000
    name = F.get(F.array(*(F.lit(k) for k in ALL)), (kind - 1).cast("int"))
    bad = F.raise_error(F.lit("not a WKB geometry header"))
    known = name.isNotNull() & F.hex(F.substring(wkb, 1, 1)).isin("00", "01") & (code % 268435456 < 4000)
    # the headers of plain geometries are looked up, all others worked out
    plain = [F.lit(v) for i, k in enumerate(ALL, 1) for o in "<>" for v in (struct.pack(f"{o}BI", o == "<", i).hex().upper(), f"ST_{k}")]
    worked_out = F.when(wkb.isNull(), F.lit(None).cast("string")).when(known, F.concat(F.lit("ST_"), name, F.when(high, "Z").otherwise(""), F.when(measured, "M").otherwise(""))).otherwise(bad.cast("string"))
    return F.coalesce(F.try_element_at(F.create_map(*plain), F.hex(F.substring(wkb, 1, 5))), worked_out)


_NO_POINT = b"\x01\x01\0\0\0" + struct.pack("<dd", math.nan, math.nan)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.tag = data, 0, ""

    def take(self, fmt: str) -> tuple:
        out = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return out

    def geometry(self) -> tuple[str, str, list]:
        """Kind, tag of its dimensions and body: vertices of points and lines, rings, or members."""
        order = {0: ">", 1: "<"}.get(self.take("B")[0])
        if order is None:
            raise ValueError("not a WKB geometry: unknown byte order")
        code = self.take(order + "I")[0]
        flags, has_id, code = code >> 30, code & 0x20000000, code & 0x0FFFFFFF
        if code >= 4000 or not 1 <= code % 1000 <= 7:
            raise ValueError(f"not a supported WKB geometry: code {code}")
        z, m = bool(flags & 2) or code // 1000 in (1, 3), bool(flags & 1) or code // 1000 in (2, 3)
        dims, tag = 2 + z + m, " Z" * (z and not m) + " M" * (m and not z) + " ZM" * (z and m)
        self.tag = tag
        if has_id:
            self.take(order + "I")
        kind = ALL[code % 1000 - 1]

        def vertices(n: int) -> list[tuple]:
            flat = self.take(f"{order}{n * dims}d")
            return [flat[i : i + dims] for i in range(0, len(flat), dims)]

        count = lambda: self.take(order + "I")[0]
        if kind == "Point":
            return kind, tag, vertices(1)
        if kind == "LineString":
            return kind, tag, vertices(count())
        if kind == "Polygon":
            return kind, tag, [vertices(count()) for _ in range(count())]
        return kind, tag, [self.geometry() for _ in range(count())]


def _number(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    text = repr(x)
    if "e" in text:
        mantissa, exponent = text.split("e")
        return f"{mantissa}e{int(exponent)}"
    return text


def _text(kind: str, tag: str, body: list, tagged: bool = True) -> str:
    name = f"{kind.upper()}{tag} "
    vertex = lambda v: " ".join(map(_number, v))
    line = lambda vs: f"({','.join(map(vertex, vs))})"
    empty = not body or (kind == "Point" and all(map(math.isnan, body[0][:2]))) or (kind == "Polygon" and not body[0])
    if empty:
        return f"{kind.upper()} EMPTY" if tagged else "EMPTY"
    if kind in ("Point", "LineString"):
        out = line(body)
    elif kind == "Polygon":
        out = f"({','.join(line(r) if r else 'EMPTY' for r in body)})"
    else:
        out = f"({','.join(_text(*m, tagged=kind == 'GeometryCollection') for m in body)})"
    return name + out if tagged else out


def _flat(kind: str, body: list) -> list:
    if kind in ("Point", "LineString"):
        return body
    if kind == "Polygon":
        return [v for r in body for v in r]
    return [v for k, _, b in body for v in _flat(k, b)]


def _struct(kind: str, tag: str, body: list) -> dict:
    """The geometry struct. Measures stand in its text only."""
    dims = 3 if "Z" in tag else 2
    v = lambda p: {"x": p[0], "y": p[1], "z": p[2] if dims == 3 else None}
    empty = lambda p: all(map(math.isnan, p[:2]))
    if kind == "Point":
        coords = [] if not body or empty(body[0]) else [[[v(body[0])]]]
    elif kind == "LineString":
        coords = [[[v(p) for p in body]]]
    elif kind == "Polygon":
        coords = [[[v(p) for p in r] for r in body]]
    elif kind == "MultiPoint":
        nothing = (math.nan,) * 3
        coords = [[[v(m[2][0] if m[2] else nothing) for m in body]]]
    elif kind == "MultiLineString":
        coords = [[[v(p) for p in m[2]] for m in body]]
    elif kind == "MultiPolygon":
        coords = [[[v(p) for p in r] for r in m[2]] for m in body]
    else:
        coords = [[[v((*p, math.nan)[:3]) for p in _flat(kind, body)]]]
    told = kind == "GeometryCollection" or "M" in tag
    return {"kind": kind, "dims": dims, "coords": coords, "wkt": _text(kind, tag, body) if told else None}


def decoded(data: bytes | None) -> dict | None:
    """The geometry struct of one WKB value."""
    return None if data is None else _struct(*_Reader(data).geometry())


def _points(column: pa.Array) -> pa.Array | None:
    """The structs of a batch of plain little-endian points, decoded together; None for any other batch."""
    column = column.cast(pa.large_binary())
    raw = column.fill_null(_NO_POINT).cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8))
    if not len(raw) or (sizes != 21).any():
        return None
    start = np.frombuffer(raw.buffers()[1], np.int64, 1, raw.offset * 8)[0]
    body = np.frombuffer(raw.buffers()[2], np.uint8)[start : start + 21 * len(raw)].reshape(-1, 21)
    if (body[:, :5] != np.frombuffer(_NO_POINT[:5], np.uint8)).any():
        return None
    xy = np.ascontiguousarray(body[:, 5:]).view("<f8")
    empty = np.isnan(xy).all(1)
    null = np.asarray(column.is_null())
    count = np.concatenate([[0], np.cumsum(~empty)]).astype(np.int32)
    own, ones = xy[~empty], np.arange((~empty).sum() + 1, dtype=np.int32)
    z = pa.nulls(len(own), pa.float64())
    vertex = pa.StructArray.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), z], fields=list(_VERTEX))
    rings = pa.ListArray.from_arrays(pa.array(ones), pa.ListArray.from_arrays(pa.array(ones), vertex))
    n = len(raw)
    fields = [pa.array(["Point"] * n), pa.array(np.full(n, 2, np.int32)), pa.ListArray.from_arrays(pa.array(count), rings), pa.nulls(n, pa.string())]
    return pa.StructArray.from_arrays(fields, fields=list(_TYPE), mask=pa.array(null))


_LINE = np.frombuffer(struct.pack("<BI", 1, 2), np.uint8)
_HEAD = np.arange(9)


def _merged(plain: np.ndarray, found: pa.Array, others: pa.Array) -> pa.Array:
    """The rows in their order: ``plain`` ones from ``found``, the rest from ``others``."""
    if not len(others):
        return found
    place = np.where(plain, np.cumsum(plain) - 1, len(found) + np.cumsum(~plain) - 1)
    return pa.concat_arrays([found, others]).take(pa.array(place))


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _lines(column: pa.Array) -> pa.Array:
    """The structs of a batch: plain little-endian lines are decoded together, all others one by one."""
    raw = column.cast(pa.large_binary()).fill_null(b"").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    start, sizes = at[:-1] - at[0], np.diff(at)
    plain = sizes >= len(_HEAD)
    heads = data[start[plain, None] + _HEAD]
    told = np.ascontiguousarray(heads[:, 5:]).view("<u4")[:, 0].astype(np.int64)
    plain[plain] = (heads[:, :5] == _LINE).all(1) & (told * 16 + len(_HEAD) == sizes[plain])
    body = np.repeat(plain, sizes)
    body[start[plain, None] + _HEAD] = False
    xy = data[body].view("<f8").reshape(-1, 2)
    vertex = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.nulls(len(xy), pa.float64())], fields=list(_VERTEX))
    n = int(plain.sum())
    coords = vertex
    for ends in (_ends((sizes[plain] - len(_HEAD)) // 16), np.arange(n + 1), np.arange(n + 1)):
        coords = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coords)
    fields = [pa.array(["LineString"] * n, pa.string()), pa.array(np.full(n, 2, np.int32)), coords, pa.nulls(n, pa.string())]
    others = pa.array([decoded(x) for x in column.filter(pa.array(~plain)).to_pylist()], _TYPE)
    return _merged(plain, pa.StructArray.from_arrays(fields, fields=list(_TYPE)), others)


def _decode(column: pa.Array) -> pa.Array:
    if not len(column):
        return pa.array([], _TYPE)
    found = _points(column)
    return found if found is not None else _lines(column)


def from_wkb(wkb: Column | str) -> Column:
    """The geometry struct of a WKB column; NULL for NULL, an error for malformed bytes."""
    return F.arrow_udf(_decode, GEOMETRY)(wkb)


def encoded(g: dict | None) -> bytes | None:
    """Little-endian WKB (ISO codes) of one geometry struct; a collection comes from its text."""
    if g is None:
        return None
    if g["kind"] not in ALL:
        raise ValueError(f"the geometry column has no single type ({g['kind']}); only ST_GeometryType can be used on it")
    if g["wkt"] is not None:
        return _bytes(*_Words(g["wkt"]).geometry())
    z = " Z" if g["dims"] == 3 else ""
    v = lambda p: (p["x"], p["y"], p["z"]) if z else (p["x"], p["y"])
    nan = (math.nan,) * (3 if z else 2)
    parts = [[[v(p) for p in r] for r in part] for part in g["coords"]]
    first = parts[0] if parts else []
    body = {
        "Point": lambda: first[0] if first and first[0] else [nan],
        "LineString": lambda: first[0] if first else [],
        "Polygon": lambda: first,
        "MultiPoint": lambda: [("Point", z, [p]) for p in (first[0] if first else [])],
        "MultiLineString": lambda: [("LineString", z, r) for r in first],
        "MultiPolygon": lambda: [("Polygon", z, p) for p in parts],
    }[g["kind"]]()
    return _bytes(g["kind"], z, body)


def _bytes(kind: str, tag: str, body: list) -> bytes:
    n = 2 + len(tag.strip())
    head = struct.pack("<BI", 1, ALL.index(kind) + 1 + {"": 0, " Z": 1000, " M": 2000, " ZM": 3000}[tag])
    flat = lambda vs: struct.pack(f"<{len(vs) * n}d", *(x for v in vs for x in v))
    if kind == "Point":
        return head + flat(body or [(math.nan,) * n])
    head += struct.pack("<I", len(body))
    if kind == "LineString":
        return head + flat(body)
    if kind == "Polygon":
        return head + b"".join(struct.pack("<I", len(r)) + flat(r) for r in body)
    return head + b"".join(_bytes(*m) for m in body)


class _Words:
    """Reads well-known text."""

    def __init__(self, text: str):
        self.words, self.at = re.findall(r"[A-Za-z]+|[-+]?(?:[0-9]*\.?[0-9]+\.?(?:[eE][-+]?[0-9]+)?|nan|inf)|[(),]|\S", text), 0

    def next(self) -> str:
        word = self.words[self.at] if self.at < len(self.words) else ""
        return word.upper()

    def take(self, *wanted: str) -> str:
        word = self.next()
        if wanted and word not in wanted:
            raise ValueError(f"not well-known text: {' or '.join(wanted)} expected, not {word or 'the end'!r}")
        self.at += 1
        return word

    def many(self, one) -> list:
        if self.next() == "EMPTY":
            self.take()
            return []
        self.take("(")
        out = [one()]
        while self.take(",", ")") == ",":
            out.append(one())
        return out

    def geometry(self) -> tuple[str, str, list]:
        names = {k.upper(): k for k in ALL}
        word = self.take(*names)
        tag = f" {self.take()}" if self.next() in ("Z", "M", "ZM") else ""
        n = 2 + len(tag.strip())

        def vertex() -> tuple:
            try:
                return tuple(float(self.take()) for _ in range(n))
            except ValueError as e:
                raise ValueError(f"not well-known text: {e}") from e

        line = lambda: self.many(vertex)

        def point() -> tuple:  # members of a multi-point may stand without parentheses
            return ("Point", tag, self.many(vertex) if self.next() in ("(", "EMPTY") else [vertex()])

        kind = names[word]
        member = {"MultiPoint": point, "MultiLineString": lambda: ("LineString", tag, line()), "MultiPolygon": lambda: ("Polygon", tag, self.many(line)), "GeometryCollection": self.geometry}
        body = self.many(member[kind]) if kind in member else self.many(line) if kind == "Polygon" else line()
        return kind, tag, body

    def whole(self) -> tuple[str, str, list]:
        out = self.geometry()
        if self.next():
            raise ValueError(f"not well-known text: {self.next()!r} after its end")
        return out


def _parse(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _struct(*_Words(x).whole()) for x in column.to_pylist()], _TYPE)


def _held(plain: np.ndarray, rows: pa.Array, hold: pa.Array) -> pa.Array:
    """Drops the rows that do not hold from ``plain``, and from the values of its rows."""
    hold = hold.fill_null(False)
    plain[plain] = np.asarray(hold)
    return rows.filter(hold)


def _encode(column: pa.Array) -> pa.Array:
    """Lines of two dimensions with all their ordinates are encoded together, all others one by one."""
    kind, dims, coords, wkt = column.flatten()
    plain = np.ones(len(column), bool)
    own = pc.and_(pc.and_(pc.equal(kind, "LineString"), pc.equal(dims, 2)), pc.is_null(wkt))
    line = _held(plain, coords, pc.and_(own, pc.equal(pc.list_value_length(coords), 1))).flatten()
    line = _held(plain, line, pc.equal(pc.list_value_length(line), 1)).flatten()
    line = _held(plain, line, line.is_valid())
    x, y, _ = line.flatten().flatten()
    gaps = _ends(np.asarray(pc.or_(x.is_null(), y.is_null())))[_ends(np.asarray(pc.list_value_length(line)))]
    line = _held(plain, line, pa.array(np.diff(gaps) == 0))
    xy = np.stack([np.asarray(v, "<f8") for v in line.flatten().flatten()[:2]], 1)
    counts = np.asarray(pc.list_value_length(line))
    ends = _ends(counts * 16 + len(_HEAD))
    head = ends[:-1, None] + _HEAD
    body = np.ones(ends[-1], bool)
    body[head] = False
    data = np.empty(ends[-1], np.uint8)
    data[head] = np.concatenate([np.broadcast_to(_LINE, (len(line), 5)), counts.astype("<u4")[:, None].view(np.uint8)], 1)
    data[body] = xy.reshape(-1).view(np.uint8)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(line), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    others = pa.array([encoded(g) for g in column.filter(pa.array(~plain)).to_pylist()], pa.binary())
    return _merged(plain, found, others)


def from_wkt(text: Column | str) -> Column:
    """The geometry struct of a column of well-known text; NULL for NULL, an error for anything else."""
    return F.arrow_udf(_parse, GEOMETRY)(text)


def to_wkb(g: Column | str) -> Column:
    """Little-endian WKB of a geometry; NULL for NULL."""
    return F.arrow_udf(_encode, "binary")(g)


def register_formats(spark: SparkSession) -> None:
    """Makes ST_GeomFromText, ST_GeomFromBinary and ST_ToBinary known to the session."""
    for name, function, returns in (("st_geomfromtext", _parse, GEOMETRY), ("st_geomfrombinary", _decode, GEOMETRY), ("st_tobinary", _encode, "binary")):
        spark.udf.register(name, F.arrow_udf(function, returns))
