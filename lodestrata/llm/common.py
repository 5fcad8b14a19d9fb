"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a batch ends with the row that reaches either.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``, read by Spark alone, so that ``sf_dir`` may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Bounds the Arrow batches and lets workers started from now on import this package.

    On a cluster the package is shipped with ``--py-files``; locally the workers find it on disk.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset a local one, on local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "/tmp/lodestrata-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there.

    A written table rather than checkpoint(): what Spark infers about a checkpointed plan's columns goes on with
    it, and grows over the rounds of an iteration until planning takes minutes. The shuffles behind the table are of no
    more use, but the executors keep their files until the driver's JVM collects garbage: so it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``cut`` wrote. Nothing that is still to be computed may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back() -> None:
    """Gives memory that was freed back to the system: Python workers outlive their tasks and would keep it, idle or not."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def holds(packed: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether a bitmap (bytes as numbers) has the bit of each number, modulo its size."""
    place = numbers.astype(np.int64, copy=False) & (8 * len(packed) - 1)
    return (packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def bits_for(rows: int, most: int = 1 << 28) -> int:
    """Bits of a bitmap for so many rows: 16 a row, from 128 KB to 32 MB."""
    return 1 << max(20, min(most.bit_length() - 1, (16 * max(1, rows) - 1).bit_length()))


def _packed_bits(batches):
    import pandas as pd

    for rows in batches:
        parts = []
        for bits in rows["bits"]:
            own = np.zeros(8192, np.uint8)
            own[np.asarray(bits, np.int64)] = 1
            parts.append(np.packbits(own).tobytes())
        yield pd.DataFrame({"part": rows["part"], "packed": parts})


def bitmap(numbers: DataFrame, column, size: int) -> bytes:
    """A bitmap of ``size`` bits (a multiple of 8192) with the bit of each value of ``column``, modulo size, set.

    It names all values and perhaps others. The executors pack it, so the driver gets size / 8 bytes at most.
    """
    place = F.pmod(column, F.lit(size))
    parts = numbers.select((place / 8192).cast("int").alias("part"), (place % 8192).cast("int").alias("bit"))
    packed = parts.groupBy("part").agg(F.collect_set("bit").alias("bits")).mapInPandas(_packed_bits, "part int, packed binary")
    out = bytearray(size // 8)
    for r in packed.collect():
        out[r["part"] * 1024 : (r["part"] + 1) * 1024] = r["packed"]
    return bytes(out)
