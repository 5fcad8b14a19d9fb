"""Secret scans over an incremental ledger of blobs.

Every historical version of a file is a row; its content address is the SHA-256 of its bytes. The ledger, a
Parquet table in a shared folder, holds a row for each pair of blob and rule version that has been scanned, with
the findings. A run scans only pairs that the ledger lacks, each distinct blob once, appends them, and joins the
findings back to all rows. Copies are aggregated before the shuffle, so a blob that a third of the rows share is
one scan; the join back is a plain equi-join on the content address, whose hot keys adaptive execution splits.

Built-in functions only. Base rules: ``assign``, ``access`` and ``hex``; further rules add kinds of their own.

Defined results: a null text counts as empty and has no findings; null doc_ids and repeated rows are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import shared_dir, table, text_or_empty
from lodestrata.llm.spans import SPAN, with_matches

RULE_VERSION = "2025-1"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, string that each match contains. Runs shorter than the least length cannot match at all.
RULES = [
    ("assign", ASSIGN, None),
    ("access", "AKIA[A-Z0-9]++", "AKIA"),
    ("hex", "[0-9a-f]{24,}+", None),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", "eyJ"),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
]
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<s:int,k:int,e:int>>"


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob and findings of each row of ``blobs`` (blob, text)."""
    for kind, pattern, inside in RULES:
        blobs = with_matches(blobs, kind, "text", pattern, inside)
    passing = {
        "assign": lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6,
        "access": lambda x: F.length(x["m"]) >= 20,
    }
    found = []
    for i, (kind, _, _) in enumerate(RULES):
        spans = F.filter(kind, passing[kind]) if kind in passing else F.col(kind)
        found.append(_of_kind(spans, i))
    return blobs.select("blob", F.array_sort(F.concat(*found)).alias("findings"))


def scan(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """``docs``' doc_id, blob and findings. ``ledger``: folder of the ledger, in a store that all executors reach;
    without one the run gets a new ledger in the shared folder."""
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))
    schema = f"blob string, rule_version string, findings {FINDINGS}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    known = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    unseen = rows
    if known:
        seen = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == rule_version).select("blob")
        unseen = rows.join(seen, "blob", "left_anti")
    blobs = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    scan_blobs(blobs).select("blob", F.lit(rule_version).alias("rule_version"), F.col("findings").cast(FINDINGS)).write.mode("append").parquet(ledger)
    scanned = spark.read.schema(schema).parquet(ledger).where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).groupBy("blob").agg(F.first("findings").alias("findings"))  # once, should two runs have scanned it
    out = rows.select("doc_id", "blob").join(scanned, "blob", "left")
    return out.select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(kind) for kind, _, _ in RULES))
    text = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    count = lambda i: F.size(F.filter("findings", lambda x: x["k"] == i)).cast("long")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(F.filter("findings", lambda x: x["k"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
