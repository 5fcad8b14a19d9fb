"""Geometry columns and the four ST functions, on built-in expressions alone.

A geometry is a struct that carries its own kind, so that it passes through aliases, subqueries, unions and joins:
``kind`` (Point, LineString, Polygon, MultiPoint, MultiLineString, MultiPolygon, GeometryCollection, Unknown or
Mixed), ``dims`` (2 or 3), ``coords`` (parts of rings of vertices) and, for collections and measured ones only, ``wkt``. Layouts:

    Point [[[p]]] or []     LineString, MultiPoint [[[p, ..]]]     Polygon, MultiLineString [[ring, ..]]
    MultiPolygon [[ring, ..], ..]     GeometryCollection [[[all vertices]]]

``register`` makes the functions known to a session as SQL functions, which Spark inlines into the plan; the Column
functions call the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VERTEX = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
COORDS = f"ARRAY<ARRAY<ARRAY<{VERTEX}>>>"
GEOMETRY = f"STRUCT<kind: STRING, dims: INT, coords: {COORDS}, wkt: STRING>"
BOUNDS = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
#: The largest double: an extent without any vertex runs from it down to its negative.
LARGEST = "1.7976931348623157E308D"


def number_sql(x: str) -> str:
    """A double as text: shortest digits, always a fraction or an exponent, plain from 1e-4 up to 1e16."""
    s = f"CAST({x} AS STRING)"
    # Spark's exponents between these bounds, written out: the shortest digits are exact as a decimal
    plain = f"regexp_replace(CAST(CAST({s} AS DECIMAL(38, 21)) AS STRING), '([.][0-9]+?)0+$', '$1')"
    return (
        # most numbers: between these bounds there is never an exponent, and the text is made once
        f"CASE WHEN abs({x}) >= 1E-3D AND abs({x}) < 1E7D THEN {s} WHEN contains({s}, 'n') THEN replace({s}, 'Infinity', 'inf') WHEN NOT contains({s}, 'E') THEN {s} "
        f"WHEN abs({x}) >= 1E-4D AND abs({x}) < 1E16D THEN {plain} ELSE replace(replace({s}, '.0E', 'e'), 'E', 'e') END"
    )


def _vertex(v: str) -> str:
    return f"concat({number_sql(f'{v}.x')}, ' ', {number_sql(f'{v}.y')}, IF(g.dims = 3, concat(' ', {number_sql(f'{v}.z')}), ''))"


def _line(vs: str, name: str) -> str:
    return f"concat('(', array_join(transform({vs}, {name} -> {_vertex(name)}), ','), ')')"


def _lines(ls: str, name: str) -> str:
    return f"concat('(', array_join(transform({ls}, {name} -> IF(size({name}) = 0, 'EMPTY', {_line(name, name + 'v')})), ','), ')')"


_FLAT = "flatten(flatten(g.coords))"
_USABLE = "g.kind IN ('Unknown', 'Mixed')"
_REFUSED = "raise_error(concat('the geometry column has no single type (', g.kind, '); only ST_GeometryType can be used on it'))"


def _tagged(name: str, empty: str, body: str) -> str:
    return f"IF({empty}, '{name} EMPTY', concat('{name}', IF(g.dims = 3, ' Z ', ' '), {body}))"


def as_text_sql() -> str:
    none = "size(g.coords) = 0 OR size(g.coords[0]) = 0"
    no_vertex = f"{none} OR size(g.coords[0][0]) = 0"
    point = f"concat('(', {_vertex('g.coords[0][0][0]')}, ')')"
    points = f"concat('(', array_join(transform(g.coords[0][0], p -> IF(isnan(p.x) AND isnan(p.y), 'EMPTY', concat('(', {_vertex('p')}, ')'))), ','), ')')"
    polygons = f"concat('(', array_join(transform(g.coords, q -> IF(size(q) = 0 OR size(q[0]) = 0, 'EMPTY', {_lines('q', 'r')})), ','), ')')"
    return (
        f"CASE WHEN g IS NULL THEN CAST(NULL AS STRING) WHEN {_USABLE} THEN CAST({_REFUSED} AS STRING) WHEN g.wkt IS NOT NULL THEN g.wkt "
        f"WHEN g.kind = 'Point' THEN {_tagged('POINT', no_vertex + ' OR (isnan(g.coords[0][0][0].x) AND isnan(g.coords[0][0][0].y))', point)} "
        f"WHEN g.kind = 'LineString' THEN {_tagged('LINESTRING', no_vertex, _line('g.coords[0][0]', 'v'))} "
        f"WHEN g.kind = 'Polygon' THEN {_tagged('POLYGON', no_vertex, _lines('g.coords[0]', 'r'))} "
        f"WHEN g.kind = 'MultiPoint' THEN {_tagged('MULTIPOINT', no_vertex, points)} "
        f"WHEN g.kind = 'MultiLineString' THEN {_tagged('MULTILINESTRING', none, _lines('g.coords[0]', 'r'))} "
        f"WHEN g.kind = 'MultiPolygon' THEN {_tagged('MULTIPOLYGON', 'size(g.coords) = 0', polygons)} END"
    )


_SIDES = (("xmin", "min", "x"), ("ymin", "min", "y"), ("xmax", "max", "x"), ("ymax", "max", "y"))
_BOX = "named_struct(" + ", ".join(f"'{name}', array_{f}(array_remove(f.{axis}, DOUBLE('NaN')))" for name, f, axis in _SIDES) + ")"
#: The bounds of g, from its vertices once.
_BOUNDS = f"transform(array({_FLAT}), f -> {_BOX})[0]"


def bounds_sql() -> str:
    return f"CASE WHEN g IS NULL THEN CAST(NULL AS {BOUNDS}) WHEN {_USABLE} THEN CAST({_REFUSED} AS {BOUNDS}) ELSE {_BOUNDS} END"


def side_sql(f: str, axis: str) -> str:
    """One side of the bounds, a point's straight from its ordinate. Without a lambda, so that Spark compiles it into an aggregate."""
    own, all_ = f"get(get(get(g.coords, 0), 0), 0).{axis}", f"array_{f}(array_remove({_FLAT}.{axis}, DOUBLE('NaN')))"
    return f"CASE WHEN g IS NULL THEN CAST(NULL AS DOUBLE) WHEN {_USABLE} THEN CAST({_REFUSED} AS DOUBLE) WHEN g.kind = 'Point' THEN IF(isnan({own}), CAST(NULL AS DOUBLE), {own}) ELSE {all_} END"


def envelope_sql() -> str:
    corner = lambda x, y: f"named_struct('x', b.{x}, 'y', b.{y}, 'z', CAST(NULL AS DOUBLE))"
    ring = ", ".join(corner(x, y) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")))
    coords = f"transform(array({_BOUNDS}), b -> IF(b.xmin IS NULL OR b.ymin IS NULL, CAST(array() AS {COORDS}), array(array(array({ring})))))[0]"
    return f"CASE WHEN g IS NULL THEN CAST(NULL AS {GEOMETRY}) WHEN {_USABLE} THEN CAST({_REFUSED} AS {GEOMETRY}) ELSE named_struct('kind', 'Polygon', 'dims', 2, 'coords', {coords}, 'wkt', CAST(NULL AS STRING)) END"


FUNCTIONS = {
    "st_geometrytype": ("STRING", "CASE WHEN g IS NOT NULL THEN concat('ST_', g.kind, IF(g.dims = 3, 'Z', '')) END"),
    "st_astext": ("STRING", as_text_sql()),
    "st_envelope": (GEOMETRY, envelope_sql()),
    "st_bounds": (BOUNDS, bounds_sql()),
    **{f"st_{name}": ("DOUBLE", side_sql(f, axis)) for name, f, axis in _SIDES},
}


def register(spark: SparkSession) -> None:
    """Makes ST_GeometryType, ST_AsText, ST_Envelope (and the helpers ST_Bounds, ST_XMin, ST_YMin, ST_XMax and ST_YMax) known to the session, in any case."""
    for name, (returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(g {GEOMETRY}) RETURNS {returns} DETERMINISTIC CONTAINS SQL RETURN {body}")


def _call(name: str, g: Column | str) -> Column:
    spark = SparkSession.active()
    if not spark.catalog.functionExists(name):
        register(spark)
    return F.call_function(name, F.col(g) if isinstance(g, str) else g)


def st_geometry_type(g: Column | str) -> Column:
    """``ST_<kind>``, with ``Z`` for three dimensions; NULL for NULL."""
    return _call("st_geometrytype", g)


def st_as_text(g: Column | str) -> Column:
    """Well-known text; members without a vertex are written EMPTY."""
    return _call("st_astext", g)


def st_envelope(g: Column | str) -> Column:
    """The bounding box as a closed polygon of five vertices, counter-clockwise; POLYGON EMPTY without a vertex."""
    return _call("st_envelope", g)


def st_bounds(g: Column | str) -> Column:
    """xmin, ymin, xmax and ymax of the vertices, NaN left out an axis; NULL fields without any. Those of a column that
    ``point`` has just made come from its ordinates."""
    known = getattr(g, "__dict__", {}).get("_lodestrata_bounds")
    return _call("st_bounds", g) if known is None else known


def st_extent(g: Column | str, null_if_empty: bool = False) -> Column:
    """Aggregate: the bounds of all geometries, by partial minima and maxima. Without any vertex the fields run
    from the largest double to its negative, or are NULL with ``null_if_empty``."""
    known = getattr(g, "__dict__", {}).get("_lodestrata_bounds")
    return extent_of({name: _call(f"st_{name}", g) for name, _, _ in _SIDES} if known is None else known, null_if_empty)


def extent_of(bounds: Column | dict[str, Column], null_if_empty: bool = False, over=None, where: Column | None = None) -> Column:
    """The extent of bounds; ``over``: a window; ``where``: only rows that hold it."""

    def side(f, field: str, none: str) -> Column:
        value = bounds[field] if where is None else F.when(where, bounds[field])
        out = f(value) if over is None else f(value).over(over)
        return (out if null_if_empty else F.coalesce(out, F.expr(none))).alias(field)

    return F.struct(side(F.min, "xmin", LARGEST), side(F.min, "ymin", LARGEST), side(F.max, "xmax", f"-{LARGEST}"), side(F.max, "ymax", f"-{LARGEST}"))


# ---------------------------------------------------------------- constructors


def _geometry(kind: str, coords: Column, present: Column | None, dims: int = 2) -> Column:
    g = F.struct(F.lit(kind).alias("kind"), F.lit(dims).alias("dims"), coords.cast(COORDS).alias("coords"), F.lit(None).cast("string").alias("wkt"))
    return g if present is None else F.when(present, g)


def vertex(x: Column, y: Column, z: Column | None = None) -> Column:
    z = F.lit(None) if z is None else z
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    """A point; NULL if an ordinate is, empty if x and y are NaN."""
    present = x.isNotNull() & y.isNotNull() if z is None else x.isNotNull() & y.isNotNull() & z.isNotNull()
    x, y = x.cast("double"), y.cast("double")
    some = F.array(F.array(F.array(vertex(x, y, z))))
    g = _geometry("Point", F.when(F.isnan(x) & F.isnan(y), F.array().cast(COORDS)).otherwise(some.cast(COORDS)), present, 2 if z is None else 3)
    sides = (v for v in (x, y, x, y))
    g._lodestrata_bounds = F.when(present, F.struct(*(F.when(~F.isnan(v), v).alias(name) for (name, _, _), v in zip(_SIDES, sides, strict=True))))
    return g


def line_string(vertices: Column, dims: int = 2) -> Column:
    return _geometry("LineString", F.array(F.array(vertices)), vertices.isNotNull(), dims)


def multi_point(vertices: Column, dims: int = 2) -> Column:
    return _geometry("MultiPoint", F.array(F.array(vertices)), vertices.isNotNull(), dims)


def polygon(rings: Column, dims: int = 2) -> Column:
    return _geometry("Polygon", F.array(rings), rings.isNotNull(), dims)


def multi_line_string(lines: Column, dims: int = 2) -> Column:
    return _geometry("MultiLineString", F.array(lines), lines.isNotNull(), dims)


def multi_polygon(polygons: Column, dims: int = 2) -> Column:
    return _geometry("MultiPolygon", polygons, polygons.isNotNull(), dims)


def untyped(column: Column, kind: str) -> Column:
    """A geometry without a single type: ``kind`` is Unknown or Mixed."""
    return _geometry(kind, F.lit(None), column.isNotNull())
