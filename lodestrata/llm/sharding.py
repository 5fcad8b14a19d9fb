"""Sharding by a hierarchical weighted hash tree.

A row's key descends region, rack and shard. At each level every child draws -ln(u) / weight, u from a hash of the
key and the child's path, and the least draw wins, so a child is taken in proportion to its weight and a weight
that changes moves rows only into or out of the subtrees it belongs to. A tree of n shards has a base of full
regions; each shard above the base opens a region of its own, so that one more shard is a new child of the root
and takes rows only into itself (law ``key``: doc_id and shard count decide).

Slots are numbers within a shard, gapless from 0. Equal rows are counted before they are shuffled; distinct rows
are numbered within hash buckets of a shard, and buckets get their base from sums over the bucket counts. So no
task holds a shard, and a doc_id that a third of the rows share is one counted row until it is expanded.

Defined results: a null text has size 1 and the crc32 of nothing; all null doc_ids share one shard; repeated rows
get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import table, text_or_empty

REGIONS, RACKS, SHARDS, BUCKETS = 2, 2, 4, 1024
#: Copies of a row that one task expands at a time.
COPIES = 10_000

Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, weights: dict[int, float] | None = None, regions: int = REGIONS, racks: int = RACKS) -> Tree:
    """Regions of racks of (shard, weight). The base holds the first 16 shards, or none where there are fewer, so that a
    tree of fewer does not grow into one of 16 by the law."""
    base = regions * racks * SHARDS
    weigh = lambda s: float((weights or {}).get(s, 1.0))
    per_rack, full = SHARDS, base if shards >= base else 0
    out: Tree = [[[(s, weigh(s)) for s in range((g * racks + k) * per_rack, (g * racks + k + 1) * per_rack)] for k in range(racks)] for g in range(regions)] if full else []
    return out + [[[(s, weigh(s))]] for s in range(full, shards)]


def draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of key and path."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{path}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _least(key: Column, children: list[tuple[str, float, int]]) -> Column:
    """The number of the child with the least draw; ties go to the lower number."""
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.array_min(F.array(*(F.struct(draw(key, path, weight).alias("draw"), F.lit(i).alias("child")) for path, weight, i in children)))["child"]


def _level(key: Column, parent: Column | None, groups: dict[int, list[tuple[str, float, int]]]) -> Column:
    """Among the children of the node that ``parent`` names, the one that ``key`` goes to."""
    if parent is None:
        return _least(key, groups[0])
    out = F.when(F.lit(False), F.lit(0))
    for node, children in groups.items():
        out = out.when(parent == node, _least(key, children))
    return out


def with_shard(rows: DataFrame, key: Column, nodes: Tree, name: str) -> DataFrame:
    """``rows`` with the shard that ``key`` descends to, a column a level. A node is named by its least shard."""
    regions, racks, leaves = [], {}, {}
    for region in nodes:
        own = []
        for rack in region:
            if found := [(f"shard{s}", w, s) for s, w in rack if w > 0]:
                leaves[rack[0][0]] = found
                own.append((f"rack{rack[0][0]}", sum(w for _, w, _ in found), rack[0][0]))
        if own:
            racks[region[0][0][0]] = own
            regions.append((f"region{region[0][0][0]}", sum(w for _, w, _ in own), region[0][0][0]))
    if not regions:
        raise ValueError("no shard has a weight above 0")
    rows = rows.withColumn("_region", _level(key, None, {0: regions}))
    rows = rows.withColumn("_rack", _level(key, F.col("_region"), racks))
    return rows.withColumn(name, _level(key, F.col("_rack"), leaves).cast("int")).drop("_region", "_rack")


def shards(docs: DataFrame, count: int = 16, weights: dict[int, float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A row for each of ``docs``: its size, crc, shard among ``count``, slot, and shard with one more."""
    if count < REGIONS * RACKS * SHARDS:
        raise ValueError(f"the law holds from {REGIONS * RACKS * SHARDS} shards on")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = with_shard(with_shard(rows, key, tree(count, weights), "shard"), key, tree(count + 1, weights), "grown_shard")
    rows = rows.withColumn("bucket", (F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", "size", "text_crc32")), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    placed = placed.join(bases, (F.col("shard") == F.col("of_shard")) & (F.col("bucket") == F.col("of_bucket")))
    placed = placed.withColumn("start", F.col("base") + F.col("first"))
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    slots = lambda start, copies: F.explode(F.sequence(start, start + copies - 1)).alias("slot")
    few = placed.where(F.col("copies") <= COPIES).select(*columns, slots(F.col("start"), F.col("copies")), "grown_shard")
    # a row that stands for many is expanded by many tasks
    many = placed.where(F.col("copies") > COPIES).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("doc_id", "size", "text_crc32", "at")
    return few.union(many.select(*columns, slots(F.col("start") + F.col("at"), F.least(F.col("copies") - F.col("at"), F.lit(COPIES))), "grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
