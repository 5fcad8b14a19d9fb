"""Media columns: texts stored as lossless WebP files and read back as pixel arrays.

A payload, the text's UTF-8 bytes and zeros up to a positive multiple of 64, becomes rows of 16 ARGB pixels; each
byte is an 8-bit sample. Long payloads take several frames of one file. The files are decoded again, many frames
side by side, and digests and features come from the pixel arrays. One pass over the input: no shuffle, and memory
bounded by a group of documents. Files depend on the text alone.

Defined results: a null text counts as empty and is 64 zeros; null doc_ids and repeated rows are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import webp
from lodestrata.llm.common import python_ready, table

UNIT, GROUP_ROWS, GROUP_BYTES = 64, 2048, 16 << 20
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def samples_of(frames: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(f, "<u4").tobytes() for f in frames)


def feature_of(frames: list[np.ndarray]) -> str:
    """Width, height, and the sum and number of distinct values of each channel (blue, green, red, alpha)."""
    c = np.concatenate([np.ascontiguousarray(f, "<u4").reshape(-1) for f in frames]).view(np.uint8).reshape(-1, 4)
    stats = ",".join(f"{int(c[:, i].sum(dtype=np.int64))}/{np.count_nonzero(np.bincount(c[:, i], minlength=256))}" for i in range(4))
    return f"{frames[0].shape[1]}x{sum(f.shape[0] for f in frames)}:{stats}"


def _described(group: list[tuple]) -> pa.RecordBatch:
    lengths, files = [], []
    for _, text in group:
        n, payload = payload_of(text)
        lengths.append(n)
        files.append(webp.encode(payload))
    columns: list[list] = [[] for _ in range(8)]
    for (doc, _), n, file, frames in zip(group, lengths, files, webp.decode(files), strict=True):
        back = samples_of(frames)
        row = (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(frames))
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            group.append((doc, text))
            size += len(text)
            if len(group) >= GROUP_ROWS or size >= GROUP_BYTES:
                yield _described(group)
                group, size = [], 0
    yield _described(group)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = [webp.encode(payload_of(t)[1]) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "media"])


def _ready(docs: DataFrame) -> DataFrame:
    python_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the WebP file of each text."""
    return _ready(docs).mapInArrow(_files, "doc_id long, media binary")


def describe(docs: DataFrame) -> DataFrame:
    """Digests and features of each text's payload, read back from its stored form."""
    return _ready(docs).mapInArrow(_rows, SCHEMA)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(table(spark, sf_dir, "documents"))
