"""The registered queries on the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.functions.wkb import from_wkb, from_wkt, to_wkb, wkb_geometry_type
from lodestrata.operators.extent import SIDES, extent, extent_over, extent_rollup, extent_where
from lodestrata.plans.sql import sql

LARGEST = "1.7976931348623157E308"
#: A unique order of an order's lines.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    G.register(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return _table(spark, sf_dir, "customer"), G.point(F.col("c_acctbal"), F.col("c_custkey"))


def _lineitem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return _table(spark, sf_dir, "lineitem"), G.point(F.col("l_extendedprice"), F.col("l_quantity"))


def extent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent(*_customer(spark, sf_dir))


def extent_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent(*_lineitem(spark, sf_dir), ["l_returnflag"])


def extent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, point = _lineitem(spark, sf_dir)
    return extent_where(df, point, F.col("l_discount") > 0.05, ["l_returnflag"])


def extent_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, point = _customer(spark, sf_dir)
    return extent(df.where(F.lit(False)), point)


def extent_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, point = _customer(spark, sf_dir)
    return extent(df, F.when(F.col("c_acctbal") >= 0, point))


def extent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    return extent_over(df, G.point(F.col("value"), F.col("user_id")), Window.partitionBy("event_type")).select("event_id", "event_type", *SIDES)


def extent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return extent(rows, G.point(F.col("o_totalprice"), F.col("c_acctbal")), ["c_mktsegment"])


def extent_rollup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent_rollup(*_lineitem(spark, sf_dir), ["l_returnflag", "l_linestatus"])


def astext_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "supplier")
    return df.select("s_suppkey", G.st_as_text(G.point(F.col("s_acctbal"), F.col("s_suppkey"))).alias("wkt"))


def astext_point_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "supplier")
    point = G.point(F.col("s_acctbal"), F.col("s_suppkey"), F.col("s_nationkey"))
    return df.select("s_suppkey", G.st_as_text(point).alias("wkt"), G.st_geometry_type(point).alias("kind"))


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and the vertices (l_quantity, l_extendedprice) of its lines, in order."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("lines"))
    return lines.select("l_orderkey", F.transform("lines", lambda r: G.vertex(r["l_quantity"], r["l_extendedprice"])).alias("vs"))


def astext_linestring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(spark, sf_dir).select("l_orderkey", G.st_as_text(G.line_string(F.col("vs"))).alias("wkt"))


def astext_multipoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(spark, sf_dir).select("l_orderkey", G.st_as_text(G.multi_point(F.col("vs"))).alias("wkt"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and the closed ring of its lines' box."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    box = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    corners = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    return box.select("l_orderkey", F.array(*(G.vertex(F.col(a), F.col(b)) for a, b in corners)).alias("ring"))


def astext_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("l_orderkey", G.st_as_text(G.polygon(F.array("ring"))).alias("wkt"))


def astext_multilinestring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("l_orderkey", G.st_as_text(G.multi_line_string(F.array("ring", "ring"))).alias("wkt"))


def astext_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("l_orderkey", G.st_as_text(G.multi_polygon(F.array(F.array("ring"), F.array("ring")))).alias("wkt"))


def envelope_linestring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(spark, sf_dir).select("l_orderkey", G.st_as_text(G.st_envelope(G.line_string(F.col("vs")))).alias("wkt"))


def envelope_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    pair = F.transform(F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1), lambda i: G.vertex(F.get("embedding", i * 2), F.get("embedding", i * 2 + 1)))
    bounds = G.st_bounds(G.st_envelope(G.line_string(pair)))
    return df.select("vec_id", bounds.alias("_b")).select("vec_id", "_b.*")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries of four kinds, with some NULL, from the suppliers."""
    df = _table(spark, sf_dir, "supplier")
    v = G.vertex(F.col("s_acctbal"), F.col("s_suppkey"))
    points = df.select(F.when(F.col("s_acctbal") >= 0, G.point(F.col("s_acctbal"), F.col("s_suppkey"))).alias("g"))
    lines = df.select(G.line_string(F.array(v, v)).alias("g"))
    rings = df.where("s_nationkey < 10").select(G.polygon(F.array(F.array(v, v, v, v))).alias("g"))
    solid = df.where("s_nationkey >= 20").select(G.point(F.col("s_acctbal"), F.col("s_suppkey"), F.lit(1.0)).alias("g"))
    return points.union(lines).union(rings).union(solid)


def geometrytype_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _mixed(spark, sf_dir).select(G.st_geometry_type("g").alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed(spark, sf_dir)
    return rows.where(G.st_geometry_type("g") == "ST_Point").select(G.st_as_text("g").alias("wkt"))


def sql_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text with an alias, a common table expression, nesting and the aggregate with FILTER."""
    df, point = _lineitem(spark, sf_dir)
    df.select("l_returnflag", "l_discount", point.alias("geometry")).createOrReplaceTempView("lodestrata_lines")
    found = sql(
        spark,
        """
        WITH t AS (SELECT l_returnflag AS flag, l_discount AS d, ST_Envelope(geometry) AS box FROM lodestrata_lines)
        SELECT flag, ST_Extent(a.box) FILTER (WHERE a.d > 0.05) AS e, count(DISTINCT ST_GeometryType(a.box)) AS kinds
        FROM t a GROUP BY flag HAVING ST_Extent(a.box).xmin < 1e9
        """,
    )
    return found.select("flag", "kinds", "e.*")


def wkb_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through well-known binary and back: kind from the header, text, envelope."""
    wkb = _vertices(spark, sf_dir).select("l_orderkey", to_wkb(G.line_string(F.col("vs"))).alias("wkb"))
    back = wkb.select("l_orderkey", wkb_geometry_type("wkb").alias("kind"), from_wkb("wkb").alias("g"))
    return back.select("l_orderkey", "kind", G.st_as_text("g").alias("wkt"), G.st_as_text(G.st_envelope("g")).alias("box"))


def wkb_point_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, point = _customer(spark, sf_dir)
    return extent(df.select("c_mktsegment", from_wkb(to_wkb(point)).alias("g")), F.col("g"), ["c_mktsegment"])


def wkt_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of points, read in SQL, back as text, kind and extent."""
    _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('POINT(', s_acctbal, ' ', s_suppkey, ')') AS t").createOrReplaceTempView("lodestrata_texts")
    return sql(spark, "SELECT s_suppkey, ST_AsText(g) AS wkt, ST_GeometryType(g) AS kind FROM (SELECT s_suppkey, ST_GeomFromText(t) AS g FROM lodestrata_texts)")


def wkt_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections and measured lines from text, through well-known binary."""
    rows = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('GEOMETRYCOLLECTION (POINT (', s_acctbal, ' 1), LINESTRING (0 0, ', s_suppkey, ' 2), MULTIPOINT ((1 1), EMPTY))') AS c", "concat('LINESTRING ZM (0 0 1 2, ', s_suppkey, ' 2 3 4)') AS m")
    g = lambda c: from_wkb(to_wkb(from_wkt(c)))
    rows = rows.select("s_suppkey", g("c").alias("c"), g("m").alias("m"))
    return rows.select("s_suppkey", G.st_as_text("c").alias("collection"), G.st_as_text("m").alias("measured"), G.st_geometry_type("c").alias("kind"), G.st_as_text(G.st_envelope("c")).alias("box"))


def extent_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, point = _lineitem(spark, sf_dir)
    df.select("l_returnflag", "l_linestatus", point.alias("geometry")).createOrReplaceTempView("lodestrata_cube")
    found = sql(spark, "SELECT l_returnflag, l_linestatus, ST_Extent(geometry) AS e FROM lodestrata_cube GROUP BY CUBE (l_returnflag, l_linestatus)")
    return found.select("l_returnflag", "l_linestatus", "e.*")


def extent_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, point = _lineitem(spark, sf_dir)
    df.select("l_returnflag", "l_linestatus", point.alias("geometry")).createOrReplaceTempView("lodestrata_sets")
    found = sql(spark, "SELECT l_returnflag, l_linestatus, ST_Extent(geometry) AS e FROM lodestrata_sets GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
    return found.select("l_returnflag", "l_linestatus", "e.*")


def _joined(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customer = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", G.point(F.col("c_acctbal"), F.col("c_custkey")).alias("g"))
        orders = _table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey")
        return extent(customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), how), F.col("g"), ["c_mktsegment"])

    return run


_QUERIES = {
    "wkb_line": wkb_line,
    "wkb_point_extent": wkb_point_extent,
    "wkt_parsed": wkt_parsed,
    "wkt_collections": wkt_collections,
    "extent_cube": extent_cube,
    "extent_grouping_sets": extent_grouping_sets,
    "extent_left_join": _joined("left"),
    "extent_full_join": _joined("full"),
    "extent_semi_join": _joined("left_semi"),
    "extent_anti_join": _joined("left_anti"),
    "extent_points": extent_points,
    "extent_group": extent_group,
    "extent_filter": extent_filter,
    "extent_empty": extent_empty,
    "extent_nullable": extent_nullable,
    "extent_window": extent_window,
    "extent_join": extent_join,
    "extent_rollup": extent_rollup_lines,
    "astext_point": astext_point,
    "astext_point_z": astext_point_z,
    "astext_linestring": astext_linestring,
    "astext_multipoint": astext_multipoint,
    "astext_polygon": astext_polygon,
    "astext_multilinestring": astext_multilinestring,
    "astext_multipolygon": astext_multipolygon,
    "envelope_linestring": envelope_linestring,
    "envelope_embedding": envelope_embedding,
    "geometrytype_mixed": geometrytype_mixed,
    "filter_type": filter_type,
    "sql_nested": sql_nested,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _bounds(x: str, y: str, suffix: str = "") -> str:
    side = lambda f, v, name, none: f"coalesce({f}({v}::DOUBLE){suffix}, {none}::DOUBLE) AS {name}"
    return ", ".join((side("min", x, "xmin", LARGEST), side("min", y, "ymin", LARGEST), side("max", x, "xmax", "-" + LARGEST), side("max", y, "ymax", "-" + LARGEST)))


_NUM = "{}::DOUBLE::VARCHAR"
_Q, _P = _NUM.format("l_quantity"), _NUM.format("l_extendedprice")
_ORDERED = f"ORDER BY {', '.join(LINE_ORDER)}"
_RING = "x0||' '||y0||','||x1||' '||y0||','||x1||' '||y1||','||x0||' '||y1||','||x0||' '||y0"
_BOX = "(SELECT l_orderkey, min(l_quantity)::DOUBLE::VARCHAR AS x0, min(l_extendedprice)::DOUBLE::VARCHAR AS y0, max(l_quantity)::DOUBLE::VARCHAR AS x1, max(l_extendedprice)::DOUBLE::VARCHAR AS y1 FROM lineitem GROUP BY l_orderkey)"
_KINDS = """(
  SELECT CASE WHEN s_acctbal >= 0 THEN 'ST_Point' END AS kind, s_acctbal, s_suppkey FROM supplier
  UNION ALL SELECT 'ST_LineString', s_acctbal, s_suppkey FROM supplier
  UNION ALL SELECT 'ST_Polygon', s_acctbal, s_suppkey FROM supplier WHERE s_nationkey < 10
  UNION ALL SELECT 'ST_PointZ', s_acctbal, s_suppkey FROM supplier WHERE s_nationkey >= 20)"""
_EVEN = "list_transform(range(0, len(embedding), 2), lambda i: embedding[i + 1]::DOUBLE)"
_ODD = "list_transform(range(1, len(embedding), 2), lambda i: embedding[i + 1]::DOUBLE)"


def oracle_sql() -> dict[str, str]:
    lines = _bounds("l_extendedprice", "l_quantity")
    of_customer = f"SELECT c_mktsegment, {_bounds('c_acctbal', 'c_custkey')} FROM customer"
    of_orders = "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey GROUP BY c_mktsegment"
    point, key = "s_acctbal::DOUBLE::VARCHAR", "s_suppkey::DOUBLE::VARCHAR"
    return {
        "wkb_line": f"SELECT l_orderkey, 'ST_LineString' AS kind, 'LINESTRING (' || string_agg({_Q} || ' ' || {_P}, ',' {_ORDERED}) || ')' AS wkt, any_value(box) AS box FROM lineitem JOIN (SELECT l_orderkey, 'POLYGON ((' || {_RING} || '))' AS box FROM {_BOX}) USING (l_orderkey) GROUP BY l_orderkey",
        "wkb_point_extent": of_customer + " GROUP BY c_mktsegment",
        "wkt_parsed": f"SELECT s_suppkey, 'POINT (' || {point} || ' ' || {key} || ')' AS wkt, 'ST_Point' AS kind FROM supplier",
        "wkt_collections": f"SELECT s_suppkey, 'GEOMETRYCOLLECTION (POINT (' || {point} || ' 1.0),LINESTRING (0.0 0.0,' || {key} || ' 2.0),MULTIPOINT ((1.0 1.0),EMPTY))' AS collection, 'LINESTRING ZM (0.0 0.0 1.0 2.0,' || {key} || ' 2.0 3.0 4.0)' AS measured, 'ST_GeometryCollection' AS kind, 'POLYGON ((' || x0 || ' 0.0,' || x1 || ' 0.0,' || x1 || ' 2.0,' || x0 || ' 2.0,' || x0 || ' 0.0))' AS box FROM (SELECT *, least(s_acctbal::DOUBLE, 0, 1)::DOUBLE::VARCHAR AS x0, greatest(s_acctbal::DOUBLE, s_suppkey::DOUBLE, 1)::DOUBLE::VARCHAR AS x1 FROM supplier)",
        "extent_cube": f"SELECT l_returnflag, l_linestatus, {lines} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "extent_grouping_sets": f"SELECT l_returnflag, l_linestatus, {lines} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
        "extent_left_join": f"{of_customer} LEFT JOIN {of_orders}",
        "extent_full_join": f"{of_customer} FULL JOIN {of_orders}",
        "extent_semi_join": f"{of_customer} SEMI JOIN {of_orders}",
        "extent_anti_join": f"{of_customer} ANTI JOIN {of_orders}",
        "extent_points": f"SELECT {_bounds('c_acctbal', 'c_custkey')} FROM customer",
        "extent_group": f"SELECT l_returnflag, {lines} FROM lineitem GROUP BY l_returnflag",
        "extent_filter": f"SELECT l_returnflag, {_bounds('l_extendedprice', 'l_quantity', ' FILTER (WHERE l_discount > 0.05)')} FROM lineitem GROUP BY l_returnflag",
        "extent_empty": f"SELECT {_bounds('c_acctbal', 'c_custkey')} FROM customer WHERE false",
        "extent_nullable": f"SELECT {_bounds('c_acctbal', 'c_custkey')} FROM customer WHERE c_acctbal >= 0",
        "extent_window": f"SELECT event_id, event_type, {_bounds('value', 'user_id', ' OVER (PARTITION BY event_type)')} FROM events",
        "extent_join": f"SELECT c_mktsegment, {_bounds('o_totalprice', 'c_acctbal')} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
        "extent_rollup": f"SELECT l_returnflag, l_linestatus, {lines} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "astext_point": "SELECT s_suppkey, 'POINT (' || s_acctbal::DOUBLE::VARCHAR || ' ' || s_suppkey::DOUBLE::VARCHAR || ')' AS wkt FROM supplier",
        "astext_point_z": "SELECT s_suppkey, 'POINT Z (' || s_acctbal::DOUBLE::VARCHAR || ' ' || s_suppkey::DOUBLE::VARCHAR || ' ' || s_nationkey::DOUBLE::VARCHAR || ')' AS wkt, 'ST_PointZ' AS kind FROM supplier",
        "astext_linestring": f"SELECT l_orderkey, 'LINESTRING (' || string_agg({_Q} || ' ' || {_P}, ',' {_ORDERED}) || ')' AS wkt FROM lineitem GROUP BY l_orderkey",
        "astext_multipoint": f"SELECT l_orderkey, 'MULTIPOINT (' || string_agg('(' || {_Q} || ' ' || {_P} || ')', ',' {_ORDERED}) || ')' AS wkt FROM lineitem GROUP BY l_orderkey",
        "astext_polygon": f"SELECT l_orderkey, 'POLYGON ((' || {_RING} || '))' AS wkt FROM {_BOX}",
        "astext_multilinestring": f"SELECT l_orderkey, 'MULTILINESTRING ((' || {_RING} || '),(' || {_RING} || '))' AS wkt FROM {_BOX}",
        "astext_multipolygon": f"SELECT l_orderkey, 'MULTIPOLYGON (((' || {_RING} || ')),((' || {_RING} || ')))' AS wkt FROM {_BOX}",
        "envelope_linestring": f"SELECT l_orderkey, 'POLYGON ((' || {_RING} || '))' AS wkt FROM {_BOX}",
        "envelope_embedding": f"SELECT vec_id, list_min({_EVEN}) AS xmin, list_min({_ODD}) AS ymin, list_max({_EVEN}) AS xmax, list_max({_ODD}) AS ymax FROM embeddings",
        "geometrytype_mixed": f"SELECT kind, count(*) AS n FROM {_KINDS} GROUP BY kind",
        "filter_type": f"SELECT 'POINT (' || s_acctbal::DOUBLE::VARCHAR || ' ' || s_suppkey::DOUBLE::VARCHAR || ')' AS wkt FROM {_KINDS} WHERE kind = 'ST_Point'",
        "sql_nested": f"SELECT l_returnflag AS flag, 1::BIGINT AS kinds, {_bounds('l_extendedprice', 'l_quantity', ' FILTER (WHERE l_discount > 0.05)')} FROM lineitem GROUP BY l_returnflag",
    }
