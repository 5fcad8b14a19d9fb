"""N-gram Jaccard join in metric space.

Texts with equal sets of word shingles form a class, which stands for its rows from then on. Classes link when
their Jaccard distance is at most the bound (100 * common >= percent * union).

Pivots are documents. Two classes within the bound share at least ``depth`` of the first shingles of their sets, in
one global order (shingles frequent in a sample of documents come last, the rest go by hash; any order gives
the same links). Classes without such a shingle are further than the bound from all others and leave at once. Of all classes
that hold a shingle among their first the one of least signature is its pivot, and a class enters the regions of the
pivots of its shingles: as the same few documents lead nearly all shingles of a group of copies, these are few. Regions are
cut by size as well: sets further apart in size than the bound allows do not meet.

Regions join recursively and exactly. Inside a region documents far from each other become its pivots, the distance of
every member to each of them is taken, and a member belongs to the Voronoi region of the nearest. By the triangle
inequality a member y can link to one that belongs to p only if d(y, p) <= d(y, own) + 2 * bound, so it is replicated
to the regions inside that window, where it meets those that belong there. Members already connected don't meet
again. Parts of at most ``LEAF`` members, and those that no pivot divides as all distances are alike, meet member by
member. A region of over ``MEMBERS`` members (or ``WEIGHT`` shingles) is not held by a task: pivots drawn from it
divide it over the cluster in the same way, and link its members, turn by turn; of what they can't divide, members outside
the largest component meet all others in blocks. Only links that connect two components are passed on.

Lists of over ``LIMIT`` classes are left out for a class that has fewer than ``depth`` of them: it shares another shingle with
whatever it links to.

Words are hashed as bytes and shingles from these, to 64 bits: two different shingles of a pair, or two sets of the
corpus, fall together with a chance of about 2**-64 a pair. Broadcast are the list of frequent shingles (at most
``FREQUENT`` numbers) and bitmaps of at most 32 MB; no group is gathered in a task, and copies cost one row a task.

Defined results: a null text counts as empty; an empty set links with nothing, its component is its own doc_id;
rows with equal sets (not empty) are linked, repeated doc_ids too; a null doc_id is kept and never names a
component, unless it has none other; an empty table gives no rows; other columns are ignored by ``join`` and kept by
``one_of_each``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import bitmap, bits_for, cut, drop, holds, python_ready, table
from lodestrata.llm.components import components
from lodestrata.llm.shingles import Shingler, signature

WORDS, PERCENT = 4, 85
DEPTH, DEEPER, LIMIT = 8, 40, 2000
#: Members and shingles of a region that one task holds.
MEMBERS, WEIGHT = 2048, 1 << 22
#: Pivots of a larger region, turns in which pivots are drawn, and replicas a member on average that count as undivided.
PIVOTS, TURNS, SPREAD = 16, 4, 4.0
#: Pivots of a region inside a task, and members that meet one by one.
NEAR, LEAF = 8, 48
#: One document in so many is looked at for frequent shingles; a shingle in so many of these is frequent.
SAMPLE, SEEN, FREQUENT = 32, 3, 100_000
#: Classes that a task remembers having passed on.
REMEMBERED = 1_000_000


def _least_common(n, percent: int):
    """The least common part of a set of ``n`` with a set it links to."""
    return -(-percent * n // 100)


def _depth(n, percent: int):
    """How many of its first shingles a class of ``n`` shares at least with whatever it links to."""
    least = _least_common(n, percent)  # grows with it, by less: so does the larger of two linked classes share its depth
    return max(1, min(DEPTH + least // DEEPER, least // 4))


# ---------------------------------------------------------------- inside a region


class Region:
    """Members (sets of hashes, ascending) of a region that a task holds, and which of them are connected."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.percent, self.bound, self.labels = percent, 1 - percent / 100, labels
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        distinct, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)
        self.links: list[tuple[int, int]] = []

    def possible(self) -> np.ndarray:
        """The members that share one of their first shingles, in the order of how rare they are here."""
        n = len(self.sizes)
        of = np.repeat(np.arange(n), self.sizes)
        often = np.bincount(self.flat, minlength=len(self.mark))
        order = np.lexsort((self.flat, often[self.flat], of))
        first = self.sizes - (self.percent * self.sizes + 99) // 100 + 1
        keep = np.arange(len(order)) - np.repeat(self.starts, self.sizes) < np.repeat(first, self.sizes)
        own, member = self.flat[order][keep], of[keep]
        return np.unique(member[np.bincount(own, minlength=len(self.mark))[own] > 1])

    def parts(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of the members, one after the other, and where each begins."""
        sizes = self.sizes[members]
        at = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[members] - at, sizes) + np.arange(sizes.sum())], at

    def common(self, one: int, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = self.flat[self.starts[one] : self.ends[one]]
        self.mark[own] = True
        out = np.add.reduceat(self.mark[flat], at, dtype=np.int64)
        self.mark[own] = False
        return out

    def connect(self, one: int, members: np.ndarray, common: np.ndarray) -> None:
        near = members[100 * common >= self.percent * (self.sizes[members] + self.sizes[one] - common)]
        labels = self.labels
        for other in near.tolist():
            if labels[other] != labels[one]:
                self.links.append((one, other))
                labels[labels == labels[other]] = labels[one]

    def solve(self, members: np.ndarray, home: np.ndarray) -> None:
        """Connects each member that is at home here with all members it links to."""
        if len(members) < 2 or not home.any() or (self.labels[members] == self.labels[members[0]]).all():
            return
        flat, at = self.parts(members)
        if len(members) <= LEAF:
            self.meet(members, home, flat, at)
            return
        far, pivot, distances = np.full(len(members), np.inf), 0, []
        for _ in range(NEAR):  # each the furthest from those before
            common = self.common(members[pivot], flat, at)
            self.connect(members[pivot], members, common)
            distance = 1 - common / (self.sizes[members] + self.sizes[members[pivot]] - common)
            distances.append(distance)
            far = np.minimum(far, distance)
            pivot = int(np.argmax(far))
            if not far[pivot]:
                break
        away = np.array(distances)
        own = np.argmin(away, 0)
        inside = away <= far + 2 * self.bound + 1e-9
        if inside.sum() > SPREAD * len(members) or inside.sum(1).max() > 0.9 * len(members):
            self.meet(members, home, flat, at)
            return
        for p in range(len(away)):
            self.solve(members[inside[p]], (home & (own == p))[inside[p]])

    def meet(self, members: np.ndarray, home: np.ndarray, flat: np.ndarray, at: np.ndarray) -> None:
        for i in np.flatnonzero(home).tolist():
            one = members[i]
            if (self.labels[members] != self.labels[one]).any():
                self.connect(one, members, self.common(one, flat, at))


def region_links(sets: list[np.ndarray], home: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that connect the members at home with what they link to, given equal ``labels`` of
    connected members; as many as components merge."""
    region = Region(sets, np.unique(labels, return_inverse=True)[1].reshape(-1), percent)
    members = region.possible()
    region.solve(members, home[members])
    return region.links


def _linked(percent: int):
    """Links of each region. Rows (region, sig, home, label, s) come sorted by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def links() -> list[tuple[int, int]]:
            sigs, rows = list(held), list(held.values())
            if len(sigs) < 2:
                return []
            found = region_links([r[2] for r in rows], np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), percent)
            return [(sigs[a], sigs[b]) for a, b in found]

        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for rows in batches:
            out = []
            for i, (region, sig, home, label) in enumerate(zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True)):
                if region != last:
                    out += links()
                    last, held = region, {}
                before = held.get(sig)
                held[sig] = (home or bool(before and before[0]), label, np.frombuffer(rows.column(4)[i].as_buffer(), np.uint64))
            yield emit(out)
        yield emit(links())

    return run


def _located(percent: int):
    """Of each member the pivot it belongs to, those inside its window and those it links to. Rows: region, sig, s, pivots."""
    bound = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets = None, np.zeros(0, np.int64), []
        longs = pa.list_(pa.int64())
        for rows in batches:
            out = []
            for i, (region, sig) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                if region != last:
                    pivots = rows.column(3)[i].as_py()
                    last, names, sets = region, np.array([p["q"] for p in pivots]), [np.frombuffer(p["s"], np.uint64) for p in pivots]
                own = np.frombuffer(rows.column(2)[i].as_buffer(), np.uint64)
                common = np.array([(q[np.minimum(np.searchsorted(q, own), len(q) - 1)] == own).sum() for q in sets])
                union = np.array([len(q) for q in sets]) + len(own) - common
                away = 1 - common / union
                near = names[(100 * common >= percent * union) & (names != sig)]
                out.append((region, sig, int(names[np.argmin(away)]), names[away <= away.min() + 2 * bound + 1e-9].tolist(), near.tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), longs, longs), strict=True)], names=["region", "sig", "own", "inside", "near"])

    return run


# ---------------------------------------------------------------- passes over the texts


def _sets(words: int):
    """doc_id, signature and size of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for rows in batches:
            sets = shingle.sets(rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "sig", "n"])

    return run


def _classes(rows: pa.RecordBatch, shingle: Shingler, seen: set) -> Iterator[tuple[int, np.ndarray]]:
    """Signature and set of the texts of a batch; equal sets of one task come once."""
    for s in shingle.sets(rows.column(0).to_pylist()):
        if len(s) and (sig := signature(s)) not in seen:
            if len(seen) < REMEMBERED:
                seen.add(sig)
            yield sig, s


def _sampled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(words), set()
        for rows in batches:
            found = [np.zeros(0, np.int64), *(s.view(np.int64) for _, s in _classes(rows, shingle, seen))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["h"])

    return run


def _first(s: np.ndarray, percent: int, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, given the frequent ones and how frequent they are."""
    n = len(s)
    first = n - _least_common(n, percent) + _depth(n, percent)
    if len(common) and first < n:
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        weight = np.where(common[at] == s, rank[at], 0)
        if weight.any():
            s = s[np.lexsort((s, weight))]
    return s[:first].view(np.int64)


def _posted(words: int, percent: int, frequent):
    """Each class's signature with each of its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(words), set()
        for rows in batches:
            firsts, sigs = [np.zeros(0, np.int64)], []
            for sig, s in _classes(rows, shingle, seen):
                firsts.append(_first(s, percent, *frequent.value))
                sigs.append(sig)
            each = [len(p) for p in firsts[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts), pa.int64()), pa.array(np.repeat(np.array(sigs, np.int64), each), pa.int64())], names=["h", "sig"])

    return run


def _meeting(words: int, percent: int, frequent, shared):
    """The classes that may share ``depth`` of their first shingles: signature, size, depth and these shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, packed = Shingler(words), set(), np.frombuffer(shared.value, np.uint8)
        for rows in batches:
            out = []
            for sig, s in _classes(rows, shingle, seen):
                first = _first(s, percent, *frequent.value)
                first, depth = first[holds(packed, first)], _depth(len(s), percent)
                if len(first) >= depth:
                    out.append((sig, len(s), depth, first))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sig", "n", "depth", "first"])

    return run


def _whole(words: int, wanted):
    """Signature and set of the classes whose signature the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, packed = Shingler(words), set(), np.frombuffer(wanted.value, np.uint8)
        for rows in batches:
            own = list(_classes(rows, shingle, seen))
            hit = holds(packed, np.array([sig for sig, _ in own], np.int64))
            own = [x for x, h in zip(own, hit.tolist(), strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array([sig for sig, _ in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary())], names=["sig", "s"])

    return run


# ---------------------------------------------------------------- the join


def _bitmap(numbers: DataFrame, name: str):
    """A broadcast bitmap of the values of a column, of bounded size."""
    size = bits_for(numbers.count())
    return numbers.sparkSession.sparkContext.broadcast(bitmap(numbers, F.col(name).bitwiseAND(F.lit(size - 1)), size))


def _sized(cells: DataFrame, percent: int) -> DataFrame:
    """Regions (region, sig, n, home) of ``cells`` (pivot, sig, n, asked, met) by size as well. A class is at home in its
    own class of sizes and replicated to the next; those further away can't link. Classes that no longer share as many of
    their first shingles with others as a link would leave. A class stays out of the regions that it owes the fewest of these
    shingles, under half of what a link shares in all: as both sides leave out under half, a shared one is left."""
    step = math.log(100 / percent) * (1 + 1e-9)  # linked sizes differ by less than a step
    size = F.floor(F.log(F.col("n")) / step)
    rows = cells.withColumn("size", size).withColumn("at", F.explode(F.array("size", F.col("size") + 1)))
    rows = cut(rows.select(F.xxhash64("pivot", "at").alias("region"), "pivot", "sig", "n", "asked", "met", (F.col("at") == F.col("size")).alias("home")))

    def alive(rows: DataFrame) -> DataFrame:
        some = rows.groupBy("region").agg(F.count("*").alias("m"), F.count_if("home").alias("h")).where("m > 1 and h > 0")
        return rows.join(some.select("region"), "region", "left_semi")

    every, rows = rows, cut(alive(rows))
    drop(every)
    own = Window.partitionBy("sig")  # as many rows as a class has first shingles at most
    live = rows.select("sig", "asked", "pivot", "met").distinct().withColumn("all_met", F.sum("met").over(own)).where("all_met >= asked")
    up_to = F.sum("met").over(own.orderBy("met", "pivot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    live = live.withColumn("up_to", up_to).where(2 * F.col("up_to") > F.col("asked") - 1)
    out = cut(alive(rows.join(live.select("sig", "pivot"), ["sig", "pivot"], "left_semi")).select("region", "sig", "n", "home"))
    drop(rows)
    return out


def _blocks(cells: DataFrame, large: DataFrame) -> DataFrame:
    """Regions as pairs of blocks that a task holds: members at home in one block against all of another."""
    own = cells.join(large.select("region", "m", "w", "h"), "region")
    ratio = F.greatest(F.col("m") / MEMBERS, F.col("w") / WEIGHT)
    own = own.withColumn("all_blocks", F.ceil(ratio)).withColumn("home_blocks", F.ceil(ratio * F.col("h") / F.col("m")))
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.greatest(F.col(c), F.lit(1)) - 1)
    dealt = lambda c: F.pmod(F.xxhash64("sig"), F.greatest(F.col(c), F.lit(1)))
    columns = ["region", "sig", "n"]
    everyone = own.select(*columns, F.explode(count("home_blocks")).alias("i"), dealt("all_blocks").alias("j"), F.lit(False).alias("home"))
    homes = own.where("home").select(*columns, dealt("home_blocks").alias("i"), F.explode(count("all_blocks")).alias("j"), F.lit(True).alias("home"))
    return everyone.union(homes).select(F.xxhash64("region", "i", "j").alias("region"), "sig", "n", "home")


def _links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the classes of ``cells`` (region, sig, n, home), within regions."""
    edges, labels, ready = None, None, []
    for turn in range(TURNS + 1):
        sizes = cells.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.count_if("home").alias("h")).where("m > 1 and h > 0")
        large = cut(sizes.where((F.col("m") > MEMBERS) | (F.col("w") > WEIGHT) & (F.col("m") > 2)))
        some = large.limit(1).count() > 0
        ready.append(cells.join(large.select("region"), "region", "left_anti").join(sizes.select("region"), "region", "left_semi") if some else cells.join(sizes.select("region"), "region", "left_semi"))
        if not some:
            break
        cells = cut(cells.join(large.select("region"), "region", "left_semi"))
        if turn == TURNS:
            ready.append(_blocks(cells, large))
            break
        # pivots drawn from each region link its members and divide it
        drawn = cells.join(large.select("region", "m"), "region").where(F.pmod(F.xxhash64("sig", F.lit(turn)), F.col("m")) < PIVOTS)
        pivots = drawn.join(sets, "sig").groupBy("region").agg(F.collect_list(F.struct(F.col("sig").alias("q"), "s")).alias("pivots"))  # some PIVOTS
        at = cells.select("region", "sig").join(sets, "sig").join(pivots, "region").select("region", "sig", "s", "pivots")
        at = cut(at.mapInArrow(_located(percent), "region long, sig long, own long, inside array<long>, near array<long>"))
        near = at.select(F.col("sig").alias("a"), F.explode("near").alias("b"))
        known, edges = edges, cut(near if edges is None else edges.union(near))
        if known is not None:
            drop(known)
        labels = components(edges)
        split = at.groupBy("region").agg(F.avg(F.size("inside")).alias("spread")).where(F.col("spread") <= SPREAD).select("region", F.lit(True).alias("split"))
        placed = cells.join(at.select("region", "sig", "own", "inside"), ["region", "sig"], "left").join(split, "region", "left")
        kept = placed.where("split is null").select("region", "sig", "n")
        parts = placed.where("split").select("region", "sig", "n", "home", "own", F.explode("inside").alias("q"))
        parts = parts.select(F.xxhash64("region", "q").alias("region"), "sig", "n", (F.col("home") & (F.col("own") == F.col("q"))).alias("home"))
        # what a region's largest component holds need not meet itself, and nothing else needs it as its home
        marked = kept.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        most = marked.groupBy("region", "label").agg(F.count("*").alias("k")).groupBy("region").agg(F.max(F.struct("k", "label")).alias("most"))
        kept = marked.join(most, "region").select("region", "sig", "n", (F.col("label") != F.col("most.label")).alias("home"))
        cells = cut(kept.union(parts))
        drop(at)
    cells = ready[0]
    for more in ready[1:]:
        cells = cells.union(more)
    if labels is None:
        cells = cells.withColumn("label", F.col("sig"))
    else:
        cells = cells.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    whole = cells.join(sets, "sig").select("region", "sig", "home", "label", "s").repartition("region").sortWithinPartitions("region")
    found = whole.mapInArrow(_linked(percent), "a long, b long")
    return cut(found if edges is None else edges.union(found))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig, n) of every row, and (node, label) of every class that links to another."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select("text")
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(_sampled(words), "h long")
    top = sampled.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    found = sorted((r["h"] % (1 << 64), r["n"]) for r in top)
    frequent = spark.sparkContext.broadcast((np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.int64)))

    # the first shingles of two or more classes, each with its pivot: the class of least signature
    posted = texts.mapInArrow(_posted(words, percent, frequent), "h long, sig long")
    shared = posted.groupBy("h").agg(F.min("sig").alias("pivot"), F.max("sig").alias("other"), F.count("*").alias("members"))
    shared = cut(shared.where("pivot < other").select("h", "pivot", (F.col("members") > LIMIT).alias("over")))
    own = texts.mapInArrow(_meeting(words, percent, frequent, _bitmap(shared, "h")), "sig long, n long, depth int, first array<long>")
    own = own.groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "depth", "first")))
    held = own.select("sig", "n", "depth", F.explode("first").alias("h")).join(shared, "h")
    over = lambda yes: F.collect_list(F.when(F.col("over") == yes, F.col("pivot")))  # noqa: E731  as many as first shingles at most
    held = held.groupBy("sig", "n", "depth").agg(F.count("*").alias("met"), F.count_if("over").alias("q"), over(False).alias("few"), over(True).alias("many"))
    all_ = F.col("q") >= F.col("depth")
    pivots = F.when(all_, F.concat("few", "many")).otherwise(F.col("few"))
    asked = F.col("depth") - F.when(all_, 0).otherwise(F.col("q"))  # of the shingles that a link shares, these lead to regions
    cells = held.where("met >= depth").select("sig", "n", asked.alias("asked"), F.explode(pivots).alias("pivot")).groupBy("sig", "n", "asked", "pivot").agg(F.count("*").alias("met"))
    cells = _sized(cells, percent)
    drop(shared)
    sets = texts.mapInArrow(_whole(words, _bitmap(cells.select("sig").distinct(), "sig")), "sig long, s binary")
    sets = cut(sets.groupBy("sig").agg(F.first("s").alias("s")))
    links = _links(cells, sets, percent)
    drop(cells, sets)
    labels = components(links)
    drop(links)
    return rows.mapInArrow(_sets(words), "doc_id long, sig long, n long"), labels


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (the least doc_id with an equal set) and component_id of every row."""
    rows, labels = classes(docs, words, percent)
    rows = cut(rows)
    named = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    named = cut(named.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "class_id", F.coalesce("label", "sig").alias("label")))
    least = cut(named.groupBy("label").agg(F.min("class_id").alias("component_id")))
    final = cut(named.join(least, "label").select("sig", "class_id", "component_id"))
    out = rows.join(final, "sig", "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _with_sets(words: int, text_at: int, wanted):
    """Each row with its set's signature, and whether the bitmap holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, packed = Shingler(words), np.frombuffer(wanted.value, np.uint8)
        for rows in batches:
            sets = shingle.sets([text or "" for text in rows.column(0).field(text_at).to_pylist()])
            sigs = np.array([signature(s) for s in sets], np.int64)
            hits = holds(packed, sigs) & np.array([len(s) > 0 for s in sets], bool)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sigs, pa.int64()), pa.array(hits, pa.bool_())], names=["was", "sig", "hit"])

    return run


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one row of each group of linked rows: one with the least doc_id. Rows without a
    word all stay. Only rows of groups (and the few that the bitmap can't tell from them) are shuffled."""
    columns = docs.columns
    found, labels = classes(docs, words, percent)
    least = found.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    least = least.join(labels.withColumnRenamed("node", "sig"), "sig", "left").where("label is not null or copies > 1")
    least = cut(least.withColumn("label", F.coalesce("label", "sig")).drop("copies"))
    first = cut(least.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("best")))
    decided = cut(least.join(first, "label").select("sig", (F.col("sig") == F.col("best.sig")).alias("chosen"), F.col("best.doc_id").alias("best")))
    held = docs.select(F.struct(*columns).alias("was"))
    schema = held.withColumns({"sig": F.lit(0).cast("long"), "hit": F.lit(True)}).schema
    rows = held.mapInArrow(_with_sets(words, columns.index("text"), _bitmap(decided, "sig")), schema)
    grouped = rows.where("hit").join(decided, "sig", "left")
    grouped = grouped.where(F.col("chosen").isNull() | (F.col("chosen") & F.col("was.doc_id").cast("long").eqNullSafe(F.col("best"))))
    alone = F.when(F.col("chosen").isNull(), F.monotonically_increasing_id())
    kept = grouped.withColumn("alone", alone).groupBy("sig", "alone").agg(F.first("was").alias("was")).select("was")
    out = rows.where(~F.col("hit")).select("was").union(kept)
    return out.select(*(F.col("was")[c].alias(c) for c in columns))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
