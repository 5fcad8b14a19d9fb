"""Golden rows, number format, WKB, GeoParquet files, SQL text and streams."""

import json
import math
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.functions import wkb as W
from lodestrata.plans.sql import expand, sql
from lodestrata.sources.geoparquet import load_geoparquet, parsed
from lodestrata.streaming.extent import windowed_extent

NAN = math.nan
P = lambda *v: dict(zip("xyz", map(float, v), strict=False))
L = lambda *v: [P(*x) for x in v]
HOLED = [L((35, 10), (45, 45), (15, 40), (10, 20), (35, 10)), L((20, 30), (35, 35), (30, 20), (20, 30))]
#: kind -> rows of (native value, text, envelope corners or "EMPTY" or None)
# Geometries and texts that have to come out just so.
GOLDEN = {
    "Point": [(P(30, 10), "POINT (30.0 10.0)", (30, 10, 30, 10)), (P(NAN, NAN), "POINT EMPTY", "EMPTY"), (None, None, None), (P(40, 40), "POINT (40.0 40.0)", (40, 40, 40, 40))],
    "LineString": [(L((30, 10), (10, 30), (40, 40)), "LINESTRING (30.0 10.0,10.0 30.0,40.0 40.0)", (10, 10, 40, 40)), ([], "LINESTRING EMPTY", "EMPTY"), (None, None, None)],
    "Polygon": [
        ([L((30, 10), (40, 40), (20, 40), (10, 20), (30, 10))], "POLYGON ((30.0 10.0,40.0 40.0,20.0 40.0,10.0 20.0,30.0 10.0))", (10, 10, 40, 40)),
        (HOLED, "POLYGON ((35.0 10.0,45.0 45.0,15.0 40.0,10.0 20.0,35.0 10.0),(20.0 30.0,35.0 35.0,30.0 20.0,20.0 30.0))", (10, 10, 45, 45)),
        ([], "POLYGON EMPTY", "EMPTY"),
        (None, None, None),
    ],
    "MultiPoint": [(L((10, 40), (40, 30), (20, 20), (30, 10)), "MULTIPOINT ((10.0 40.0),(40.0 30.0),(20.0 20.0),(30.0 10.0))", (10, 10, 40, 40)), ([], "MULTIPOINT EMPTY", "EMPTY"), (None, None, None)],
    "MultiLineString": [([L((1, 2), (3, 4), (5, 6)), L((7, 8), (9, 0))], "MULTILINESTRING ((1.0 2.0,3.0 4.0,5.0 6.0),(7.0 8.0,9.0 0.0))", (1, 0, 9, 8)), ([], "MULTILINESTRING EMPTY", "EMPTY"), (None, None, None)],
    "MultiPolygon": [
        ([[L((0, 0), (4, 0), (2, 4), (0, 0))], [L((4, 4), (8, 4), (8, 8), (4, 8), (4, 4))]], "MULTIPOLYGON (((0.0 0.0,4.0 0.0,2.0 4.0,0.0 0.0)),((4.0 4.0,8.0 4.0,8.0 8.0,4.0 8.0,4.0 4.0)))", (0, 0, 8, 8)),
        ([], "MULTIPOLYGON EMPTY", "EMPTY"),
        (None, None, None),
    ],
}
DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


def native_type(kind, names="xy"):
    t = pa.struct([(n, pa.float64()) for n in names])
    for _ in range(DEPTH[kind]):
        t = pa.list_(t)
    return t


def wkb_of(kind, value, order="<"):
    code = 1 + list(W.ALL).index(kind)
    head = struct.pack(order + "BI", 1 if order == "<" else 0, code)
    points = lambda vs: b"".join(struct.pack(order + "2d", v["x"], v["y"]) for v in vs)
    n = lambda x: struct.pack(order + "I", len(x))
    if kind == "Point":
        return head + points([value])
    if kind == "LineString":
        return head + n(value) + points(value)
    if kind == "Polygon":
        return head + n(value) + b"".join(n(r) + points(r) for r in value)
    part = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}[kind]
    return head + n(value) + b"".join(wkb_of(part, v, order) for v in value)


def write(path, values, dtype, encoding, types, geo=None):
    meta = geo if geo is not None else json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": encoding, "geometry_types": types}}})
    t = pa.table({"col": pa.array(range(len(values)), pa.int64()), "geometry": pa.array(values, dtype)})
    pq.write_table(t.replace_schema_metadata({"geo": meta} if meta else {}), path)
    return str(path)


def box_text(box):
    if box is None or box == "EMPTY":
        return box and "POLYGON EMPTY"
    a, b, c, d = map(float, box)
    return f"POLYGON (({a} {b},{c} {b},{c} {d},{a} {d},{a} {b}))"


@pytest.mark.parametrize("kind", GOLDEN)
@pytest.mark.parametrize("form", ["native", "little", "big"])
def test_golden(spark, tmp_path, kind, form):
    rows = GOLDEN[kind]
    if form == "native":
        path = write(tmp_path / "t.parquet", [r[0] for r in rows], native_type(kind), kind.lower(), [kind])
    else:
        values = [None if r[0] is None else wkb_of(kind, r[0], "<" if form == "little" else ">") for r in rows]
        path = write(tmp_path / "t.parquet", values, pa.binary() if form == "little" else pa.large_binary(), "WKB", [kind])
    load_geoparquet(spark, path, "golden")
    found = spark.sql("SELECT ST_GeometryType(geometry), ST_AsText(geometry), ST_AsText(ST_Envelope(geometry)) FROM golden ORDER BY col").collect()
    assert [tuple(r) for r in found] == [(None if v is None else f"ST_{kind}", text, box_text(box)) for v, text, box in rows]
    e = sql(spark, "SELECT ST_Extent(g.geometry) FROM golden g").first()[0]
    boxes = [b for _, _, b in rows if isinstance(b, tuple)]
    assert tuple(e) == (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    assert spark.read.parquet(path).select(W.wkb_geometry_type("geometry")).collect() == [(None if v is None else f"ST_{kind}",) for v, _, _ in rows] if form != "native" else True


@pytest.mark.parametrize("kind", DEPTH)
def test_three_dimensions(spark, tmp_path, kind):
    value = P(1, 2, 3)
    for _ in range(DEPTH[kind]):
        value = [value]
    path = write(tmp_path / "z.parquet", [value], native_type(kind, "xyz"), kind.lower(), [f"{kind} Z"])
    r = load_geoparquet(spark, path).select(G.st_geometry_type("geometry"), G.st_as_text("geometry"), G.st_bounds("geometry")).first()
    assert r[0] == f"ST_{kind}Z" and r[1].startswith(f"{kind.upper()} Z (") and "1.0 2.0 3.0" in r[1]
    assert tuple(r[2]) == (1.0, 2.0, 1.0, 2.0)


def test_interleaved(spark, tmp_path):
    path = write(tmp_path / "i.parquet", [[[1.0, 2.0], [3.0, 4.0]]], pa.list_(pa.list_(pa.float64())), "linestring", ["LineString"])
    assert load_geoparquet(spark, path).select(G.st_as_text("geometry")).first()[0] == "LINESTRING (1.0 2.0,3.0 4.0)"


def test_collections_and_empty_members(spark):
    inner = wkb_of("Point", P(1, 2)) + wkb_of("LineString", L((3, 4), (5, 6)))
    both = struct.pack("<BII", 1, 7, 2) + inner
    members = wkb_of("MultiPoint", [P(NAN, NAN), P(1, 2)])
    z = struct.pack("<BI3d", 1, 0x80000001, 1, 2, 3)
    df = spark.createDataFrame([(0, both), (1, members), (2, z), (3, struct.pack("<BII", 1, 7, 0)), (4, None)], "i int, w binary")
    rows = df.select("i", W.from_wkb("w").alias("g"), "w").select("i", G.st_as_text("g"), G.st_geometry_type("g"), G.st_bounds("g"), W.wkb_geometry_type("w")).orderBy("i").collect()
    assert rows[0][1:3] == ("GEOMETRYCOLLECTION (POINT (1.0 2.0),LINESTRING (3.0 4.0,5.0 6.0))", "ST_GeometryCollection") and tuple(rows[0][3]) == (1, 2, 5, 6)
    assert rows[1][1] == "MULTIPOINT (EMPTY,(1.0 2.0))" and tuple(rows[1][3]) == (1, 2, 1, 2)
    assert rows[2][1:3] == ("POINT Z (1.0 2.0 3.0)", "ST_PointZ") and rows[2][4] == "ST_PointZ"
    assert rows[3][1] == "GEOMETRYCOLLECTION EMPTY" and rows[4][1] is None
    with pytest.raises(Exception, match="WKB"):
        spark.createDataFrame([(b"\x05junk",)], "w binary").select(W.wkb_geometry_type("w")).collect()


def test_untyped_and_malformed(spark, tmp_path):
    path = write(tmp_path / "m.parquet", [L((1, 2)), None], native_type("LineString"), "linestring", ["LineString", "MultiPoint"])
    df = load_geoparquet(spark, path)
    assert [r[0] for r in df.orderBy("col").select(G.st_geometry_type("geometry")).collect()] == ["ST_Mixed", None]
    with pytest.raises(Exception, match="no single type"):
        df.select(G.st_as_text("geometry")).collect()
    path = write(tmp_path / "u.parquet", [L((1, 2))], native_type("LineString"), "linestring", [])
    assert load_geoparquet(spark, path).select(G.st_geometry_type("geometry")).first()[0] == "ST_Unknown"
    wkb = write(tmp_path / "w.parquet", [wkb_of("Point", P(1, 2)), wkb_of("LineString", L((1, 2)))], pa.binary(), "WKB", ["Point", "LineString"])
    assert {r[0] for r in load_geoparquet(spark, wkb).select(G.st_geometry_type("geometry")).collect()} == {"ST_Point", "ST_LineString"}
    for bad in ("{", "[]", '{"columns": {"g": {}}}'):
        with pytest.raises(ValueError, match="Malformed `geo` metadata"):
            parsed(bad)
    none = write(tmp_path / "n.parquet", [b"x"], pa.binary(), "", [], geo="")
    assert load_geoparquet(spark, none).columns == ["col", "geometry"]


def test_nan_and_nothing(spark):
    df = spark.createDataFrame([(NAN, 5.0), (3.0, NAN), (NAN, NAN), (None, 1.0)], "x double, y double")
    p = G.point(F.col("x"), F.col("y"))
    assert tuple(df.select(G.st_extent(p)).first()[0]) == (3.0, 5.0, 3.0, 5.0)
    big = 1.7976931348623157e308
    assert tuple(df.where("false").select(G.st_extent(p)).first()[0]) == (big, big, -big, -big)
    assert tuple(df.where("false").select(G.st_extent(p, null_if_empty=True)).first()[0]) == (None,) * 4
    assert df.where("x = 3").select(G.st_as_text(G.st_envelope(p))).first()[0] == "POLYGON EMPTY"


def expected(x):
    return W._number(x)


def test_numbers(spark):
    values = [1e16, 9999999999999998.0, 1e-4, 9.9e-5, -0.0, 0.0, 12345678.9, 5e-4, -5e-4, 1e7, 1e15, 123456789012345.6, 1.5e-7, -2.5e20, 1e-300, 0.001, 100.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(F.expr(G.number_sql("x"))).collect()] == [expected(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e15, 1e15), min_size=1, max_size=50))
def test_numbers_property(spark, values):
    values = [v for v in values if v == 0 or abs(v) >= 1e-12]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    found = [r[0] for r in df.orderBy("i").select(F.expr(G.number_sql("x"))).collect()]
    assert [float(f) for f in found] == values


def test_sql_text(spark):
    text = "SELECT 'ST_Extent(x)', ST_Extent(g) -- ST_Extent(y)\nFROM t"
    out = expand(text)
    assert "'ST_Extent(x)'" in out and "-- ST_Extent(y)" in out and "AS `ST_Extent(g)`" in out
    assert "FILTER (WHERE a > (1))" in expand("SELECT st_extent(DISTINCT f(g)) FILTER (WHERE a > (1)) OVER w FROM t") and "(DISTINCT" not in expand("SELECT st_extent(DISTINCT g) AS e FROM t")
    G.register(spark)
    spark.range(5).select("id", G.point(F.col("id"), F.col("id") * 2).alias("g")).createOrReplaceTempView("pts")
    r = sql(spark, "SELECT id, ST_Extent(p.g) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS e FROM pts p ORDER BY id").collect()
    assert tuple(r[3][1]) == (2, 4, 3, 6)
    r = sql(spark, "WITH q AS (SELECT ST_Envelope(g) AS b FROM pts WHERE ST_GeometryType(g) = 'ST_Point') SELECT ST_Extent(q.b).xmax AS m, count(*) AS n FROM q").first()
    assert tuple(r) == (4.0, 5)
    one = sql(spark, "SELECT ST_Extent(g) FROM pts")
    assert one.columns == ["ST_Extent(g)"]
    spread = spark.table("pts").repartition(7)
    assert spread.select(G.st_extent("g")).first() == spark.table("pts").coalesce(1).select(G.st_extent("g")).first()


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    G.register(spark)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    found = windowed_extent(stream, "ts", G.point(F.col("value"), F.col("user_id")), "7 days", "1 day", ["event_type"])
    q = found.writeStream.outputMode("complete").format("memory").queryName("extents").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "7 days"), "event_type").agg(F.min("value").alias("xmin"), F.max("user_id").cast("double").alias("ymax"))
    want = {(r["window"]["start"], r["event_type"], r["xmin"], r["ymax"]) for r in batch.collect()}
    got = {(r["window_start"], r["event_type"], r["xmin"], r["ymax"]) for r in spark.table("extents").collect()}
    assert got == want and got


TEXTS = [
    "POINT (1.0 -2.5)", "POINT Z (1.0 2.0 3.0)", "POINT M (1.0 2.0 9.0)", "POINT ZM (1.0 2.0 3.0 9.0)", "POINT EMPTY", "LINESTRING (0.0 0.0,1.0 1e16)", "LINESTRING EMPTY",
    "POLYGON ((0.0 0.0,4.0 0.0,4.0 4.0,0.0 0.0),(1.0 1.0,2.0 1.0,2.0 2.0,1.0 1.0))", "MULTIPOINT ((1.0 2.0),EMPTY)", "MULTILINESTRING M ((0.0 0.0 1.0,1.0 1.0 2.0))",
    "MULTIPOLYGON (((0.0 0.0,1.0 0.0,1.0 1.0,0.0 0.0)),EMPTY)", "GEOMETRYCOLLECTION (POINT (1.0 2.0),GEOMETRYCOLLECTION (LINESTRING (0.0 0.0,1.0 1.0)),POLYGON EMPTY)", None,
]


def test_text_and_binary_round_trip(spark):
    from lodestrata.functions.wkb import from_wkb, from_wkt, to_wkb, wkb_geometry_type

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(1)
    binary = rows.select("i", "t", to_wkb(from_wkt("t")).alias("w"))
    out = binary.select("i", "t", G.st_as_text(from_wkb("w")).alias("back"), wkb_geometry_type("w").alias("kind")).collect()
    for r in out:
        assert r["back"] == r["t"]
        if r["t"]:
            name, tag = r["t"].split(" ")[0], r["t"].split(" ")[1]
            assert r["kind"].upper() == f"ST_{name}{tag if tag in ('Z', 'M', 'ZM') else ''}"


def test_points_are_decoded_together():
    import math
    import struct

    import pyarrow as pa

    from lodestrata.functions import wkb

    point = lambda x, y: b"\x01\x01\0\0\0" + struct.pack("<dd", x, y)
    rows = [point(1, 2), None, point(math.nan, math.nan), point(3, math.inf)]
    own = pa.array([b"skipped", *rows], pa.binary()).slice(1)
    found = wkb._points(own)
    assert found is not None and found.to_pylist() == [wkb.decoded(x) for x in rows]
    assert wkb._points(pa.array([b"\0\0\0\0\1" + struct.pack(">dd", 1, 2)])) is None and wkb._points(pa.array([], pa.binary())) is None


@pytest.mark.parametrize("bad", ["", "POINT", "POINT (1)", "POINT (1 2", "CIRCLE (1 2)", "POINT (1 2) 3", "POINT (a b)", "LINESTRING ((1 2))"])
def test_malformed_text(bad):
    from lodestrata.functions import wkb

    with pytest.raises(ValueError):
        wkb._Words(bad).whole()


def test_bounds_are_worked_out_once(spark, sf):
    from lodestrata.plans import catalog

    plan = catalog.queries()["envelope_linestring"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(array_remove") <= 2 and len(plan) < 20_000
    plan = catalog.queries()["extent_group"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "array(" not in plan


def test_sides_are_compiled_into_the_aggregate(spark, sf):
    from lodestrata.plans import catalog

    for name in ("extent_cube", "extent_grouping_sets"):
        assert "lambda" not in catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    rows = [*((t,) for t in TEXTS), ("POINT (nan 3)",), ("POINT (3 nan)",), ("LINESTRING (nan 1, 2 nan)",), ("MULTIPOLYGON EMPTY",)]
    g = spark.createDataFrame(rows, "t string").select("t", W.from_wkt("t").alias("g"))
    g.createOrReplaceTempView("sides")
    found = sql(spark, "SELECT t, ST_Bounds(g) AS b, named_struct('xmin', ST_XMin(g), 'ymin', ST_YMin(g), 'xmax', ST_XMax(g), 'ymax', ST_YMax(g)) AS s FROM sides").collect()
    assert len(found) == len(rows) and all(r["s"] == (r["b"] or (None,) * 4) for r in found)
    assert sql(spark, "SELECT ST_Extent(g) FROM sides").first()[0] == g.select(G.st_extent("g")).first()[0]
    with pytest.raises(Exception, match="no single type"):
        spark.range(1).select(G.st_extent(G.untyped(F.col("id"), "Mixed"))).collect()


def test_lines_go_together(spark, monkeypatch):
    line = "LINESTRING (1 2, 3 nan, 5 inf)"
    texts = [line, None, "LINESTRING EMPTY", "POINT (1 2)", "LINESTRING Z (1 2 3, 4 5 6)", "LINESTRING M (1 2 3, 4 5 6)", "POLYGON ((0 0, 1 1, 2 2, 0 0))", "LINESTRING (9 9)", "MULTILINESTRING ((0 0, 1 1), EMPTY)"]
    g = W._parse(pa.array(["POINT (0 0)", *texts]))
    one = lambda rows: [W.decoded(x) for x in rows]
    for part in (g.slice(1), g.slice(2, 1), g.slice(3, 1), g.slice(4), g.slice(0, 0)):
        w = W._encode(part)
        assert w.to_pylist() == [W.encoded(x) for x in part.to_pylist()]
        assert repr(W._decode(w).to_pylist()) == repr(one(w.to_pylist()))
    head = struct.pack(">BII", 0, 2, 1), struct.pack("<BII", 1, 2, 1)
    odd = pa.array([b"skipped", head[0] + struct.pack(">2d", 1, 2), head[1] + struct.pack("<2d", 1, 2) + b"more", None]).slice(1)
    assert W._decode(odd).to_pylist() == one(odd.to_pylist())
    for bad in (b"", b"\x01\x02", head[1], b"\x05junkjunkjunk"):
        with pytest.raises((ValueError, struct.error)):
            W._decode(pa.array([head[1] + bytes(16), bad]))
    gap = {"kind": "LineString", "dims": 2, "coords": [[[{"x": 1.0, "y": None, "z": None}]]], "wkt": None}
    with pytest.raises(struct.error):
        W._encode(pa.array([gap, W.decoded(head[1] + bytes(16))], W._TYPE))

    calls = []
    for name in ("encoded", "decoded"):
        own = getattr(W, name)
        monkeypatch.setattr(W, name, lambda x, own=own: (calls.append(x), own(x))[1])
    W._decode(W._encode(W._parse(pa.array([line] * 50 + ["POINT (1 2)"]))))
    assert len(calls) == 2

    heads = [struct.pack(f"{o}BI", o == "<", flags + code) for o in "<>" for code in range(1, 8) for flags in (0, 1000, 2000, 3000, 0x80000000, 0x40000000)]
    kinds = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, w binary").orderBy("i").select(W.wkb_geometry_type("w")).collect()]
    assert kinds == [f"ST_{k}{s}" for _ in "<>" for k in W.ALL for s in ("", "Z", "M", "ZM", "Z", "M")]
