"""GeoParquet tables: data read by Spark, the ``geo`` key of the footers by the driver, geometries tagged in band."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import geometry as G
from lodestrata.functions.wkb import from_wkb

#: Levels of lists above the vertices of a native column.
DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


def _files(spark: SparkSession, path: str) -> list:
    """The Parquet files at ``path``, in any store that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(root)
    if not found:
        raise FileNotFoundError(path)
    out = []
    for status in found:
        if status.isFile():
            out.append(status.getPath())
            continue
        walk = fs.listFiles(status.getPath(), True)
        while walk.hasNext():
            p = walk.next().getPath()
            if p.getName().endswith(".parquet") and p.getName()[0] not in "._":
                out.append(p)
    return out


def _footer(spark: SparkSession, path) -> str | None:
    jvm = spark._jvm.org.apache.parquet.hadoop
    reader = jvm.ParquetFileReader.open(jvm.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
    try:
        return reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()


def parsed(geo: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Encoding and geometry types of each geometry column."""
    try:
        meta = json.loads(geo)
        return {name: (str(c["encoding"]), tuple(c["geometry_types"])) for name, c in meta["columns"].items()}
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"Malformed `geo` metadata: {e}") from e


def geo_columns(spark: SparkSession, path: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Encoding and types of each geometry column over all files; types that differ are united."""
    files = _files(spark, path)
    with ThreadPoolExecutor(16) as pool:
        metas = [parsed(g) for g in pool.map(lambda p: _footer(spark, p), files) if g is not None]
    out: dict[str, tuple[str, tuple[str, ...]]] = {}
    for meta in metas:
        for name, (encoding, types) in meta.items():
            had = out.get(name)
            if had and had[0].lower() != encoding.lower():
                raise ValueError(f"Malformed `geo` metadata: files disagree on the encoding of {name}: {had[0]}, {encoding}")
            out[name] = (encoding, types if had is None or had[1] == types else tuple(dict.fromkeys((*had[1], *types))))
    return out


def canonical(column: Column, dtype: T.DataType, encoding: str, types: tuple[str, ...]) -> Column:
    """The tagged geometry of a column, from its encoding and types."""
    if isinstance(dtype, T.BinaryType) and encoding.upper() == "WKB":
        return from_wkb(column)
    if len(types) != 1:
        return G.untyped(column, "Mixed" if types else "Unknown")
    kind, _, suffix = types[0].partition(" ")
    if kind not in DEPTH or suffix not in ("", "Z"):
        raise ValueError(f"no native layout for the geometry type {types[0]!r}")
    leaf, depth = dtype, 0
    while depth < DEPTH[kind] and isinstance(leaf, T.ArrayType):
        leaf, depth = leaf.elementType, depth + 1
    dims = 3 if suffix == "Z" else 2
    if depth == DEPTH[kind] and isinstance(leaf, T.StructType):
        own = lambda v: G.vertex(v["x"], v["y"], v["z"] if dims == 3 else None)
    elif depth == DEPTH[kind] and isinstance(leaf, T.ArrayType):
        own = lambda v: G.vertex(F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.get(v, F.lit(2)) if dims == 3 else None)
    else:
        raise ValueError(f"Unsupported data type {dtype.simpleString()} for {types[0]}")
    if kind == "Point":
        v = own(column)
        some = F.when(F.isnan(v["x"]) & F.isnan(v["y"]), F.array().cast(G.COORDS)).otherwise(F.array(F.array(F.array(v))).cast(G.COORDS))
        return G._geometry(kind, some, column.isNotNull(), dims)
    line = lambda vs: F.transform(F.coalesce(vs, F.array()), own)
    lines = lambda ls: F.transform(F.coalesce(ls, F.array()), line)
    if depth == 1:
        coords = F.array(F.array(line(column)))
    elif depth == 2:
        coords = F.array(lines(column))
    else:
        coords = F.transform(column, lines)
    return G._geometry(kind, coords, column.isNotNull(), dims)


def load_geoparquet(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """The table at ``path`` with its geometry columns tagged; also as a temporary view. Functions get registered."""
    G.register(spark)
    df = spark.read.parquet(path)
    for name, (encoding, types) in geo_columns(spark, path).items():
        if name in df.columns:
            df = df.withColumn(name, canonical(F.col(f"`{name}`"), df.schema[name].dataType, encoding, types))
    if view:
        df.createOrReplaceTempView(view)
    return df
