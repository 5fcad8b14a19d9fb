"""Exact top-k inner-product search by dual cover trees.

Candidates are dealt into blocks by the nearest of a few pivots, each with its centre and covering radius, and a large block
into parts by a hash. A query first looks in the part of its own block; with the worst score of its k best so far it
then asks only blocks whose centre and radius leave room for as much. Candidates are shipped once a pass; a task
builds the cover tree of one part (each level splits a node's points into groups around separated centres of half
the radius, with the true covering radius kept) and visits it together with the cover tree of each batch of
queries that comes, pairs of nodes the most promising first. A pair is left out when the centres' inner product
plus what the covering radii can add is below the worst k-th score of the queries in the group. Parts' best lists are
merged by rank. A task holds one part and one batch of queries. Equal vectors are one point, of which a query needs
the first k + 1 rows by id, its own being one at most.

On vectors without structure (random directions of one length) no bound can leave anything out, and each query meets each part.

Scores are exact: coordinates are integers, and where sums could pass 2**53 they are taken in whole numbers, one pair after
the other and without bounds. A score beyond 64 bits is given as the nearest 64-bit number.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor does a null
vec_id; vectors of different lengths count as padded with zeros; repeated query rows of one vec_id count once
(the least vector), and a candidate that shares the query's vec_id is its own row; candidate rows equal in vec_id and
vector count once (OP9_SQL ranks each), rows of one vec_id with other vectors each; ties go to the smaller vec_id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, python_ready, table

K, EVERY, SCALE = 5, 50, 256.0
#: Candidates of a part, pivots at most, and points of a leaf.
PART, PIVOTS, LEAF = 4096, 512, 64
SCHEMA = "query_id long, vec_id long, score long"


class Node:
    """A cover-tree node: centre, true covering radius, and children or the points of a leaf."""

    __slots__ = ("centre", "children", "norm", "points", "radius")

    def __init__(self, points: np.ndarray, x: np.ndarray, leaf: int):
        self.centre = x[points[0]]
        far = np.sqrt(((x[points] - self.centre) ** 2).sum(1))
        self.radius, self.norm = float(far.max()), float(np.sqrt((self.centre**2).sum()))
        self.points, self.children = points, []
        if len(points) <= leaf or self.radius == 0:
            return
        reach, rest, groups = self.radius / 2, points, []
        far = far.copy()
        while len(rest):  # the first point left is over half the radius from all centres before it
            near = far <= reach if not groups else np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(1)) <= reach
            near[0] = True
            groups.append(rest[near])
            rest = rest[~near]
            far = far[~near]
        single = [g for g in groups if len(g) == 1]
        self.children = [Node(g, x, leaf) for g in groups if len(g) > 1]
        if single:  # lone points stand together in leaves
            lone = np.concatenate(single)
            self.children += [Node(lone[i : i + leaf], x, leaf) for i in range(0, len(lone), leaf)]


def _matrix(vectors, width: int) -> np.ndarray:
    """The vectors as rows of scaled coordinates, short ones filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.floor(SCALE * out)


class Candidates:
    """Candidate rows (``x`` and their ids), equal vectors as one point, in a cover tree unless sums may pass 2**53."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF):
        self.k, self.leaf = k, leaf
        self.points, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        order = np.lexsort((ids, inverse))
        point, vec_id, place = inverse[order], ids[order], np.arange(len(order))
        fresh = np.concatenate([[True], (point[1:] != point[:-1]) | (vec_id[1:] != vec_id[:-1])])
        few = place - np.maximum.accumulate(np.where(fresh, place, 0)) < k  # the first k rows of an id
        point, vec_id = point[few], vec_id[few]
        starts = np.searchsorted(point, np.arange(len(self.points)))
        self.least = [vec_id[a:b][: 2 * k].tolist() for a, b in zip(starts, [*starts[1:], len(point)], strict=True)]
        self.most = float(np.abs(x).max(initial=0))
        self.tree: Node | None = None

    def find(self, q: np.ndarray, own: np.ndarray, worst: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each row of ``q`` (its id in ``own``) the (score, id) of its ``k`` best; those below ``worst`` may be missing."""
        k, points = self.k, self.points
        best: list[list[tuple[int, int]]] = [[] for _ in q]
        if not len(q):
            return best
        worst = np.full(len(q), -np.inf) if worst is None else worst.copy()

        def offer(i: int, score: int, point: int) -> None:
            mine = own[i]
            found = best[i] + [(-score, vec) for vec in self.least[point] if vec != mine]
            best[i] = sorted(found)[:k]
            if len(best[i]) == k:
                worst[i] = max(worst[i], -float(best[i][-1][0]))

        if float(np.abs(q).max(initial=0)) * self.most * max(1, q.shape[1]) >= 2.0**52:  # whole numbers of any size
            exact = [[int(v) for v in row] for row in points]
            for i, row in enumerate([[int(v) for v in r] for r in q]):
                for p, other in enumerate(exact):
                    offer(i, sum(a * b for a, b in zip(row, other, strict=True)), p)
            return [[(-s, v) for s, v in b] for b in best]

        def visit(a: Node, b: Node, most: float) -> None:
            if most < worst[a.points].min():
                return
            if not a.children and not b.children:
                scores = q[a.points] @ points[b.points].T
                for r, c in zip(*np.nonzero(scores >= worst[a.points][:, None]), strict=True):
                    i = a.points[r]
                    if scores[r, c] >= worst[i]:
                        offer(i, int(scores[r, c]), b.points[c])
                return
            if b.children and (not a.children or b.radius >= a.radius):
                pairs = [(bound(a, child), a, child) for child in b.children]
            else:
                pairs = [(bound(child, b), child, b) for child in a.children]
            for m, left, right in sorted(pairs, key=lambda p: -p[0]):
                visit(left, right, m)

        if self.tree is None:
            self.tree = Node(np.arange(len(points)), points, self.leaf)
        queries = Node(np.arange(len(q)), q, self.leaf)
        visit(queries, self.tree, bound(queries, self.tree))
        return [[(-s, v) for s, v in b] for b in best]


def bound(a: Node, b: Node) -> float:
    """The highest inner product of a point of ``a`` with one of ``b``."""
    most = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return most + 1e-6 + 1e-9 * (a.norm + a.radius) * (b.norm + b.radius)


def search(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF) -> list[list[tuple[int, int]]]:
    """For each row of ``q`` (its id in ``own``) the (score, id) of its ``k`` best rows of ``x``."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    return Candidates(x, ids, k, leaf).find(q, own) if len(x) else [[] for _ in q]


class Pivots:
    """The centres of the blocks. Without ``trees`` (coordinates too large for exact doubles) nothing is known of distances."""

    def __init__(self, vectors: list, width: int, trees: bool):
        self.x, self.width, self.trees = _matrix(vectors, width), width, trees
        self.squares = (self.x**2).sum(1) if trees else np.zeros(len(self.x))

    def nearest(self, v: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and distance to its centre of each row."""
        if not self.trees:
            return seeds % max(1, len(self.x)), np.zeros(len(v))
        block = np.argmin(self.squares - 2 * (v @ self.x.T), 1)
        return block, np.sqrt(((v - self.x[block]) ** 2).sum(1))


def _placed(pivots):
    """Rows (vec_id, v) with their block and distance to its centre."""

    def run(batches):
        own = pivots.value
        for rows in batches:
            v = _matrix(rows["v"], own.width)
            block, far = own.nearest(v, rows["vec_id"].to_numpy() % (1 << 31))
            yield rows.assign(block=block.astype("int32"), far=far)

    return run


def _asking(pivots, radii: dict[int, tuple[float, int]], first: bool):
    """The parts of blocks that each query (vec_id, v, block, worst) has to ask: first one of its own block, then the rest of those
    that have room for its worst score."""

    def run(batches):
        own = pivots.value
        blocks = sorted(radii)
        far, parts = np.array([radii[b][0] for b in blocks]), [radii[b][1] for b in blocks]
        centres = own.x[blocks]
        norms = np.sqrt((centres**2).sum(1)) if own.trees else np.zeros(len(blocks))
        for rows in batches:
            out = []
            v = _matrix(rows["v"], own.width)
            if not first and own.trees:
                length = np.sqrt((v**2).sum(1))[:, None]
                room = v @ centres.T + length * far + 1e-6 + 1e-9 * length * (norms + far) >= rows["worst"].to_numpy()[:, None]
            for i, (q, home, worst) in enumerate(zip(rows["vec_id"], rows["block"], rows["worst"], strict=True)):
                mine = (int(home), q % radii[home][1])
                if first:
                    out.append((*mine, i, worst))
                else:
                    some = np.flatnonzero(room[i]).tolist() if own.trees else range(len(blocks))
                    out += [(blocks[b], part, i, worst) for b in some for part in range(parts[b]) if (blocks[b], part) != mine]
            at = [x[2] for x in out]
            yield pd.DataFrame({"block": [x[0] for x in out], "part": [x[1] for x in out], "side": 1, "vec_id": rows["vec_id"].to_numpy()[at], "v": rows["v"].to_numpy()[at], "worst": [x[3] for x in out]})

    return run


def _searched(k: int, leaf: int, width: int):
    """The best of each part for each query that asks it. Rows come sorted by block and part, candidates first."""

    def run(batches):
        last, held, built = None, [], None
        limit = 2**63 - 1
        for rows in batches:
            out = []
            for key, some in rows.groupby(["block", "part", "side"], sort=False):
                if key[:2] != last:
                    last, held, built = key[:2], [], None
                if key[2] == 0:
                    held.append((_matrix(some["v"], width), some["vec_id"].to_numpy()))
                    continue
                if not held:
                    continue
                if built is None:
                    built = Candidates(np.concatenate([x for x, _ in held]), np.concatenate([i for _, i in held]), k, leaf)
                own = some["vec_id"].to_numpy()
                for query, best in zip(own, built.find(_matrix(some["v"], width), own, some["worst"].to_numpy()), strict=True):
                    out += [(query, vec, max(-limit - 1, min(limit, score))) for score, vec in best]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, part: int = PART, pivots: int = PIVOTS, leaf: int = LEAF) -> DataFrame:
    """The ``k`` best others for each row of ``vectors`` (vec_id, embedding) whose id ``every`` divides."""
    spark = vectors.sparkSession
    python_ready(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    width, trees = max(1, r["width"] or 1), (SCALE * (r["most"] or 0.0) + 1) ** 2 * max(1, r["width"] or 1) < 2.0**52
    few = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    others = rows.distinct().withColumn("place", few).where(F.col("place") <= k + 1).drop("place")
    count = max(1, min(pivots, -(-r["n"] * 4 // part)))
    chosen = others.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(count).collect()  # ``pivots`` rows at most
    centres = spark.sparkContext.broadcast(Pivots([x["v"] for x in chosen] or [[]], width, trees))
    placed = cut(others.mapInPandas(_placed(centres), "vec_id long, v array<double>, block int, far double"))
    radii = {x["block"]: (x["far"], -(-x["n"] // part)) for x in placed.groupBy("block").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(_placed(centres), "vec_id long, v array<double>, block int, far double")
    queries = cut(queries.drop("far"))
    parts = F.create_map(*(F.lit(x) for b, (_, n) in radii.items() for x in (b, n))) if radii else F.create_map(F.lit(0), F.lit(1))
    schema = "block int, part int, side int, vec_id long, v array<double>, worst double"
    candidates = placed.select("block", F.pmod(F.xxhash64("vec_id", "v"), parts[F.col("block")].cast("long")).cast("int").alias("part"), F.lit(0).alias("side"), "vec_id", "v", F.lit(0.0).alias("worst"))

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        asked = asked.select("vec_id", "v", "block", "worst").mapInPandas(_asking(centres, radii, first), schema)
        both = candidates.union(asked).repartition("block", "part").sortWithinPartitions("block", "part", "side")
        return both.mapInPandas(_searched(k, leaf, width), SCHEMA)

    none = F.lit(float("-inf"))
    found = cut(searched(queries.where(F.col("block").isin(list(radii))).withColumn("worst", none), True))
    worst = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
    again = queries.join(worst, "vec_id", "left").withColumn("worst", F.coalesce("least", none) if trees else none)
    both = found.union(searched(again, False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank"::INTEGER AS "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
