"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary text, share one backoff: the word counts of all documents. Below its pairs a
class counts a word by the distinct words before it, and both have discounts from their counts of counts. A text's
score is a logistic function of the difference of its log-likelihoods under both models, divided by its number of
words. Every word and pair of these texts has counts of its own in the classes, however rare. They weigh
L^2 / (L^2 + ``SOFT``^2), L being the log-likelihood ratio of the numbers of documents that hold it in the classes, and
the shared backoff has the rest, so that rare expressions are smoothed and none is left out; a word that no counted
text holds has the shared share in both classes, which cancels.

Labels come only from rows whose crc32(doc_id as text) modulo ``FOLDS`` is not 0; of these, the last remainder sets
the two numbers of the logistic function, and the rest are counted: all rows of either, none sampled. The shared backoff counts the words of all documents. A model of up to ``BROADCAST`` words and pairs is
broadcast. Of a larger one what each pair adds to a difference is written to the shared folder, in parts by hash, and tasks read the
parts once for about ``AT_ONCE`` words of the texts that they hold; no text is moved. Where Arrow can't open that folder's store,
texts are dealt into groups of about ``GROUP`` bytes, each group asks for its distinct words and pairs once, each part of the
tables answers with what it holds, and the answers meet the group's texts. Words and pairs are named by 64-bit hashes.

Defined results: a null text counts as empty, and an empty text gets the score of difference 0; a null doc_id counts
as held out; repeated rows are scored each on its own; label rows without a toxic value are left out, and of several
for one document the higher counts; without counted texts of both classes no text has evidence and all get the share of
toxic labels, at most ``PRIOR``; without calibration rows of both classes that share is the score of difference 0; an
empty table gives no rows; other columns are ignored by the query and kept by ``scored``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import bitmap, bits_for, cut, drop, given_back, holds, python_ready, table
from lodestrata.llm.shingles import mixed

FOLDS, SOFT = 5, 30.0
#: Entries of a broadcast model, ids of labels that are broadcast, and the highest score without evidence.
BROADCAST, MARKED, PRIOR = 1_000_000, 1_000_000, 0.45
#: Labelled bytes of a part of the pairs, about, words of the texts that meet the tables at once, and pairs that are worked out at once.
COUNTED, AT_ONCE, SOME = 4 << 20, 1_200_000, 1 << 17
#: Characters that are scored at a time.
PORTION = 1 << 19
#: Bytes of text of a group, entries of a part of the tables, about, and words of a batch of their statistics.
GROUP, PART, STATED = 32 << 20, 1 << 17, 1 << 14
#: Differences a word below this are taken as they are by the logistic function, larger ones by their logarithm.
UNIT = 1e-3
#: Words that a task holds before it passes their counts on, distinct ones whose hashes it knows, and the longest of these.
HELD, KNOWN, LONGEST = 400_000, 200_000, 40
#: Stands before the first word of a text.
START = 0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return _words(text.lower())


class Hashes(dict):
    """The hash of each word, never that of START; kept while they are few."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word) or 1
        if len(word) <= LONGEST:
            if len(self) > KNOWN:
                self.clear()
            self[word] = h
        return h

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, START before each text's own, and the number of words of each text."""
        flat: list[int] = []
        lengths = []
        for text in texts:
            words = words_of(text or "")
            flat.append(START)
            flat.extend(map(self.__getitem__, words))
            lengths.append(len(words))
        return np.array(flat, np.uint64), np.array(lengths, np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _FACTOR + second)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64), pa.int64())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of the texts, passed on whenever many are held."""
    hashes, held, n = Hashes(), [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(keys), pa.array(counts, pa.int64())], names=["word", "n"])

    for rows in batches:
        flat, _ = hashes.of(rows.column(0).to_pylist())
        held.append(flat[flat != START])
        n += len(flat)
        if n > HELD:
            yield flush()
            held, n = [], 0
    yield flush()


#: Columns of packed pairs: both words, and numbers (n) and texts (d) that hold them among toxic (1) and other (0) texts. Where ``second``
#: is ALONE they are those of the word ``first``.
PAIRS = np.dtype([("first", "<u8"), ("second", "<u8"), ("n1", "<u4"), ("n0", "<u4"), ("d1", "<u4"), ("d0", "<u4")])
ALONE = (1 << 64) - 1
_codec = pa.Codec("zstd", compression_level=1)


def packed_pairs(rows: np.ndarray) -> bytes:
    """A column after the other, compressed; sorted by the first word, which makes that column small."""
    rows = rows[np.argsort(rows["first"], kind="stable")]
    raw = b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in PAIRS.names)
    return len(rows).to_bytes(8, "little") + (_codec.compress(raw, asbytes=True) if raw else b"")


def opened_pairs(packed: bytes) -> np.ndarray:
    out = np.zeros(int.from_bytes(packed[:8], "little"), PAIRS)
    if len(out):
        raw, at = _codec.decompress(packed[8:], PAIRS.itemsize * len(out), asbytes=True), 0
        for n in PAIRS.names:
            out[n] = np.frombuffer(raw, PAIRS[n], len(out), at)
            at += PAIRS[n].itemsize * len(out)
    return out


def summed_pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order, and the rows of equal keys as one."""
    key = pair_keys(rows["first"], rows["second"])
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    out = rows[at]
    for n in PAIRS.names[2:]:
        out[n] = np.add.reduceat(rows[n], at) if len(at) else 0
    return key[at], out


def _part_edges(bits: int) -> np.ndarray:
    return np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)


def _class_counts(bits: int):
    """Packed pairs of labelled texts, words alone among them, by part of their keys; passed on whenever many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(), [], 0

        def flush() -> pa.RecordBatch:
            key, rows = summed_pairs(np.concatenate([np.zeros(0, PAIRS), *held]))
            held.clear()
            parts = [packed_pairs(x) if len(x) else None for x in np.split(rows, np.searchsorted(key, _part_edges(bits)))]
            del key, rows
            given_back()
            own = [i for i, x in enumerate(parts) if x]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([parts[i] for i in own], pa.binary())], names=["part", "packed"])

        def hold(of: np.ndarray, toxic: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            key = pair_keys(first, second)
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(key) else np.zeros(0, np.int64)
            rows, times, toxic = np.zeros(len(at), PAIRS), np.diff(np.append(at, len(key))), toxic[of[at]]
            rows["first"], rows["second"] = first[order[at]], second[order[at]]
            for c, use in (("1", toxic), ("0", ~toxic)):
                rows[f"n{c}"], rows[f"d{c}"] = np.where(use, times, 0), use
            held.append(rows)

        for batch in batches:
            flat, lengths = hashes.of(batch.column(0).to_pylist())
            toxic, of, at = np.array(batch.column(1).to_pylist(), bool), np.repeat(np.arange(len(lengths)), lengths + 1), np.flatnonzero(flat != START)
            hold(of[at], toxic, flat[at - 1], flat[at])
            hold(of, toxic, flat, np.full(len(flat), ALONE, np.uint64))
            n += len(flat)
            if n > HELD:
                yield flush()
                n = 0
        yield flush()

    return run


TIMES = [f"e{c}{i}" for c in (1, 0) for i in (1, 2, 3, 4)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of packed pairs a part, with its number of pairs and how many of them stand there once to four times. Rows come sorted by part."""
    last, held = None, []

    def emit() -> pa.RecordBatch:
        _, rows = summed_pairs(np.concatenate(held))
        own = rows[rows["second"] != ALONE]
        numbers = [len(own), *(int((own[f"n{e[1]}"] == int(e[2])).sum()) for e in TIMES)]
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([x], pa.int64()) for x in numbers), pa.array([packed_pairs(rows)], pa.binary())], names=["part", "rows", *TIMES, "packed"])

    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last is not None and part != last:
                yield emit()
                held = []
            last = part
            held.append(opened_pairs(packed))
    if held:
        yield emit()
    held = []
    given_back()


#: Of a word: texts that hold it (d), distinct words before it (n), and, as a context, its count (t) and pairs counted once, twice and more often.
STATS = ["d1", "d0", "n1", "n0", "t1", "t0", *(f"c{c}{i}" for c in (1, 0) for i in (1, 2, 3))]


def _word_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STATS of the words of each row of packed pairs."""
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            rows = opened_pairs(packed)
            alone, own = rows[rows["second"] == ALONE], rows[rows["second"] != ALONE]
            words = np.unique(np.concatenate([rows["first"], own["second"]]))
            at = {n: np.searchsorted(words, x) for n, x in (("alone", alone["first"]), ("first", own["first"]), ("second", own["second"]))}
            total = lambda n, weights: np.bincount(at[n], weights, len(words)).astype(np.int64)  # noqa: B023, E731
            out = {}
            for c in "10":
                n = own[f"n{c}"]
                out[f"d{c}"], out[f"n{c}"], out[f"t{c}"] = total("alone", alone[f"d{c}"]), total("second", n > 0), total("first", n)
                for i in (1, 2, 3):
                    out[f"c{c}{i}"] = total("first", n >= 3 if i == 3 else n == i)
            for a in range(0, len(words), STATED):
                own = slice(a, a + STATED)
                yield pa.RecordBatch.from_arrays([_signed(words[own]), *(pa.array(out[n][own], pa.int64()) for n in STATS)], names=["word", *STATS])
        given_back()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of packed rows with their keys."""
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            rows = opened_pairs(packed)
            rows = rows[rows["second"] != ALONE]
            columns = [_signed(pair_keys(rows["first"], rows["second"])), *(pa.array(rows[n].astype(np.int64), pa.int64()) for n in PAIRS.names[2:])]
            yield from pa.Table.from_arrays(columns, names=["key", *PAIRS.names[2:]]).to_batches(1 << 16)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (max(1, n) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.3, 0.4, 0.5], [0, 0.95, 1.9, 2.9]).tolist()


def _discount(n, by: list[float]):
    return F.when(n >= 3, by[3]).when(n == 2, by[2]).when(n == 1, by[1]).otherwise(0.0)


def _spread(counts: DataFrame) -> tuple[dict, list[list[float]]]:
    """Sums of n1 and n0 with what their discounts leave over (rest1, rest0), and the discounts of each."""
    classes = ("n1", "n0")
    r = counts.agg(*(F.sum(c).alias(c) for c in classes), *(F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in classes for i in range(1, 5)), *(F.count_if(F.col(c) >= 3).alias(f"{c}_more") for c in classes)).first().asDict()
    by = [_discounts(*(r[f"{c}_{i}"] for i in range(1, 5))) for c in classes]
    for c, d in zip(classes, by, strict=True):
        r[f"rest{c[1]}"] = d[1] * r[f"{c}_1"] + d[2] * r[f"{c}_2"] + d[3] * r[f"{c}_more"]
    return r, by


def weights(rows: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """``_weight`` of packed pairs."""
    d1, d0 = rows["d1"].astype(np.float64), rows["d0"].astype(np.float64)
    share, n = all1 / (all1 + all0), d1 + d0
    term = lambda k, expected: np.where(k > 0, k * np.log(np.where(k > 0, k, 1) / np.where(expected > 0, expected, 1)), 0.0)
    evidence = 2 * (term(d1, n * share) + term(d0, n * (1 - share)) + term(all1 - d1, (all1 + all0 - n) * share) + term(all0 - d0, (all1 + all0 - n) * (1 - share)))
    square = np.maximum(evidence, 0.0) ** 2
    return square / (square + SOFT**2)


def _weight(all1: float, all0: float):
    """What the counts of an expression weigh against the backoff, by the numbers of texts that hold it (d1, d0)."""
    share, n, d1, d0 = all1 / (all1 + all0), F.col("d1") + F.col("d0"), F.col("d1"), F.col("d0")
    term = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    evidence = 2 * (term(d1, n * share) + term(d0, n * (1 - share)) + term(all1 - d1, (all1 + all0 - n) * share) + term(all0 - d0, (all1 + all0 - n) * (1 - share)))
    square = F.pow(F.greatest(evidence, F.lit(0.0)), 2)
    return square / (square + SOFT**2)


class Model:
    """``pairs``: key, counts in toxic and ordinary texts, and their weight (g). ``words``: of each word its probability
    in both classes (p1, p0) and, as a context, its count (t1, t0) and what is left for the backoff (b1, b0). ``by``:
    discounts of pairs. ``packed``: the pairs, a row for each of 2^``parted`` parts; ``texts``: numbers of texts of both classes."""

    def __init__(self, pairs: DataFrame, words: DataFrame, by: list[list[float]], entries: int, packed: DataFrame, texts: tuple[float, float], parted: int):
        self.pairs, self.words, self.by, self.entries, self.packed, self.texts, self.parted = pairs, words, by, entries, packed, texts, parted
        self.bits = max(1, (entries // PART).bit_length())

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and pairs by ascending key; only for models of bounded size."""
        out = []
        for kind, rows in ((WORD, self.words.withColumnRenamed("word", "key")), (PAIR, self.pairs)):
            found = rows.select(*(F.col(n).cast("long" if n == "key" else "float") for n in kind.names)).toArrow()
            table = np.zeros(len(found), kind)
            for name in kind.names:
                column = found.column(name).to_numpy()
                table[name] = column.view(np.uint64) if name == "key" else column
            out.append(table[np.argsort(table["key"])])
        return out[0], out[1]


def calibrated(rows: DataFrame) -> tuple[float, float] | None:
    """Offset and slope of a logistic fit of the classes on the difference, by Newton steps with a small ridge, over all rows
    (difference, toxic); none where a class is missing. Each step is one sum over the rows."""
    bend, toxic = F.signum("difference") * F.log1p(F.abs("difference") / UNIT), F.col("toxic")
    r = rows.agg(F.min("toxic"), F.max("toxic"), F.stddev_pop(bend)).first()
    if (r[0], r[1]) != (0, 1):
        return None
    scale = max(float(r[2]), 1e-9)
    x, b = bend / scale, np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.least(float(b[0]) + float(b[1]) * x, F.lit(30.0)), F.lit(-30.0))))
        w = p * (1 - p)
        g0, g1, h0, h1, h2 = rows.agg(F.sum(toxic - p), F.sum(x * (toxic - p)), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()
        step = np.linalg.solve(np.array([[h0, h1], [h1, h2]]) + 1e-2 * np.eye(2), np.array([g0, g1]) - 1e-2 * b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(max(b[1], 0.0) / scale)


def _remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and fold of the labels that may be learned from."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return marked.withColumn("fold", _remainder(F.col("doc_id"))).where("fold <> 0")


def _marked(wanted):
    """The rows (doc_id, text) whose id the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(wanted.value, np.uint8)
        for rows in batches:
            yield rows.filter(pa.array(holds(packed, rows.column(0).to_numpy(zero_copy_only=False)).tolist(), pa.bool_()))

    return run


def fit(docs: DataFrame, marked: DataFrame) -> Model | None:
    """The model from ``docs`` (doc_id, text) and ``marked``; none where a class is missing."""
    if marked.select("toxic").distinct().count() < 2:
        return None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    learned = marked.where(F.col("fold") < FOLDS - 1).select("doc_id", "toxic")
    if (many := learned.count()) <= MARKED:
        labelled = rows.join(F.broadcast(learned), "doc_id")
    else:  # only texts that may have a label are moved
        bits = docs.sparkSession.sparkContext.broadcast(bitmap(learned, F.col("doc_id"), bits_for(many)))
        labelled = rows.where("doc_id is not null").mapInArrow(_marked(bits), rows.schema).join(learned, "doc_id")
    size = rows.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(learned) if many <= MARKED else learned, "doc_id").agg(F.sum("n")).first()[0] or 0
    bits = (size // COUNTED).bit_length()
    counted = labelled.select("text", "toxic").mapInArrow(_class_counts(bits), "part int, packed binary")
    merged = counted.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(_merged, "part int, rows long, " + ", ".join(f"{n} long" for n in TIMES) + ", packed binary")
    packed = cut(merged)
    stats = cut(packed.select("packed").mapInArrow(_word_stats, "word long, " + ", ".join(f"{n} long" for n in STATS)).groupBy("word").agg(*(F.sum(n).alias(n) for n in STATS)))
    texts = stats.where(F.col("word") == START).first()
    if texts is None or not texts["d1"] or not texts["d0"]:
        return None
    own = stats.where(F.col("word") != START)
    times = packed.agg(F.sum("rows").alias("rows"), *(F.sum(n).alias(n) for n in TIMES)).first()
    by = [_discounts(*(times[f"e{c}{i}"] or 0 for i in (1, 2, 3, 4))) for c in (1, 0)]
    whole, word_by = _spread(own)
    weight = _weight(float(texts["d1"]), float(texts["d0"]))
    everywhere = cut(rows.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = float(everywhere.agg(F.sum("n")).first()[0] or 1)
    shared = everywhere.select("word", (F.col("n") / total).alias("base"))
    left = {f"g{c}": sum(by[1 - c][i] * F.col(f"c{c}{i}") for i in (1, 2, 3)) for c in (1, 0)}
    words = stats.withColumns(left).withColumn("w", weight).join(shared, "word", "left")

    def probability(c: int):
        of_class, n = float(whole[f"n{c}"] or 1), F.col(f"n{c}")
        rest = min(1.0, whole[f"rest{c}"] / of_class) if whole[f"rest{c}"] else 1.0
        smooth = (n - _discount(n, word_by[1 - c])) / of_class + rest * F.col("base")
        return F.coalesce(F.when(F.col("word") != START, F.col("w") * smooth + (1 - F.col("w")) * F.col("base")), F.lit(1.0)).cast("float").alias(f"p{c}")

    t = lambda c: F.greatest(F.coalesce(f"t{c}", F.lit(0)), F.lit(1)).cast("float").alias(f"t{c}")
    b = lambda c: F.when(F.col(f"t{c}") > 0, F.col(f"g{c}") / F.col(f"t{c}")).otherwise(1.0).cast("float").alias(f"b{c}")
    words = cut(words.select("word", *(f(c) for f in (probability, t, b) for c in (1, 0))))
    pairs = packed.select("packed").mapInArrow(_opened, "key long, n1 long, n0 long, d1 long, d0 long").select("key", "n1", "n0", weight.alias("g"))
    return Model(pairs, words, by, int(times["rows"] or 0) + words.count(), packed, (float(texts["d1"]), float(texts["d0"])), bits)


# ---------------------------------------------------------------- texts meet the tables

WORD = np.dtype([("key", "<u8"), ("p1", "<f4"), ("p0", "<f4"), ("t1", "<f4"), ("t0", "<f4"), ("b1", "<f4"), ("b0", "<f4")])
PAIR = np.dtype([("key", "<u8"), ("n1", "<f4"), ("n0", "<f4"), ("g", "<f4")])
ENTRY = "part int, kind int, key long, n1 float, n0 float, g float, p1 float, p0 float, t1 float, t0 float, b1 float, b0 float, grp long, words binary, pairs binary"


def _packed(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _asked(bits: int):
    """Of each group the distinct words and pairs, by part. Rows (grp, text) come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        last, held = None, []

        def ask() -> pa.RecordBatch:
            sets = [np.unique(np.concatenate(x)) for x in zip(*held, strict=True)]
            edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            split = [np.split(x, np.searchsorted(x, edges)) for x in sets]
            return _packed([(last, i, w.tobytes(), p.tobytes()) for i, (w, p) in enumerate(zip(*split, strict=True)) if len(w) or len(p)], ("grp", "part", "words", "pairs"))

        for rows in batches:
            groups = np.array(rows.column(0).to_pylist(), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if last is not None and groups[a] != last:
                    yield ask()
                    held = []
                last = int(groups[a])
                flat, _ = hashes.of(list(dict.fromkeys(rows.column(1).slice(a, b - a).to_pylist())))
                at = np.flatnonzero(flat != START)
                held.append((np.unique(flat), np.unique(pair_keys(flat[at - 1], flat[at]))))
        if held:
            yield ask()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the tables hold of what is asked. Rows (ENTRY) come sorted by part, and entries before questions."""
    last, tables, parts = None, [], ([], [])

    def found(table: np.ndarray, raw: bytes) -> bytes:
        keys = np.frombuffer(raw, np.uint64)
        if not len(table):
            return b""
        at = np.minimum(np.searchsorted(table["key"], keys), len(table) - 1)
        return table[at[table["key"][at] == keys]].tobytes()

    for rows in batches:
        part, kind = (np.array(rows.column(i).to_pylist(), np.int64) for i in (0, 1))
        order = part * 4 + kind
        cuts = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if part[a] != last:
                last, tables, parts = part[a], [], ([], [])
            own = rows.slice(a, b - a)
            if kind[a] < 2:
                into = np.zeros(b - a, (PAIR, WORD)[kind[a]])
                for name in into.dtype.names:
                    column = own.column(own.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                    into[name] = column.view(np.uint64) if name == "key" else column
                parts[kind[a]].append(into)
                continue
            if not tables:
                tables = [np.concatenate([np.zeros(0, t), *p]) for t, p in zip((PAIR, WORD), parts, strict=True)]
                tables = [t[np.argsort(t["key"])] for t in tables]
            out = [(g, int(last), found(tables[1], w), found(tables[0], p)) for g, w, p in zip(*(own.column(own.schema.get_field_index(n)).to_pylist() for n in ("grp", "words", "pairs")), strict=True)]
            yield _packed(out, ("grp", "part", "words", "pairs"))


_UNKNOWN, _UNPAIRED = np.zeros(1, WORD), np.zeros(1, PAIR)
for _name in WORD.names[1:]:
    _UNKNOWN[_name] = 1


def _lookup(table: np.ndarray, keys: np.ndarray, absent: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.repeat(absent, len(keys))
    at = np.minimum(np.searchsorted(table["key"], keys), len(table) - 1)
    out = table[at]
    out[table["key"][at] != keys] = absent[0]
    return out


_space = re.compile(r"\s").search


def _portions(texts: list[str]) -> Iterator[tuple[list[int], list[str], bool]]:
    """Some texts at a time, or a piece of a long one (cut before white space; whether it goes on), and which they are."""
    some, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > PORTION:
            at = 0
            while at < len(text):
                end = _space(text, at + PORTION) if at + PORTION < len(text) else None
                end = end.start() if end else len(text)
                yield [i], [text[at:end]], at > 0
                at = end
            continue
        some.append(i)
        size += len(text)
        if size > PORTION:
            yield some, [texts[j] for j in some], False
            some, size = [], 0
    if some:
        yield some, [texts[j] for j in some], False


def _read(texts: list[str], hashes: Hashes) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """By portions: which texts, their numbers of words, the hashes of all words with what stands before each text, and the words' places."""
    before = START
    for which, some, goes_on in _portions(texts):
        flat, lengths = hashes.of(some)
        first = np.cumsum(lengths + 1) - lengths - 1
        at = np.delete(np.arange(len(flat)), first)
        if goes_on:
            flat[0] = before
        before = int(flat[-1]) if len(flat) else START
        yield which, lengths, flat, at


def differences_of(texts: list[str], hashes: Hashes, words: np.ndarray, pairs: np.ndarray, by: list[list[float]]) -> np.ndarray:
    """Toxic less ordinary log-likelihood of each text, a word."""
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for which, lengths, flat, at in _read(texts, hashes):
        distinct, of = np.unique(flat, return_inverse=True)
        word = _lookup(words, distinct, _UNKNOWN)[of.reshape(-1)]
        distinct, of = np.unique(pair_keys(flat[at - 1], flat[at]), return_inverse=True)
        pair = _lookup(pairs, distinct, _UNPAIRED)[of.reshape(-1)]
        alone, more = _summands(word[at - 1], word[at], pair, by)
        sums[which] += np.bincount(np.repeat(np.arange(len(which)), lengths), alone + more, len(which))
        counts[which] += lengths
    return sums / np.maximum(counts, 1)


def _summands(context: np.ndarray, word: np.ndarray, pair: np.ndarray, by: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """What words add to the difference by themselves (rows WORD), and what their pairs with the words before (PAIR) add to that."""
    own, log = [], []
    for c in (1, 0):
        n = pair[f"n{c}"].astype(np.float64)
        part = np.maximum(n - np.array(by[1 - c])[np.minimum(n, 3).astype(int)], 0) / context[f"t{c}"]
        own.append(word[f"p{c}"].astype(np.float64))
        log.append(np.log(part + context[f"b{c}"] * own[-1]))
    alone = np.log(own[0]) - np.log(own[1])
    return alone, pair["g"] * (log[0] - log[1] - alone)


# ---------------------------------------------------------------- texts read the tables in the shared folder
#
# A table is one row (part, keys, entries) for each part of the keys. Tasks that have their distinct keys read it row by row.


def _files(df: DataFrame) -> list[str] | None:
    """The files of a table, if they are in a store that Arrow opens as well as Spark."""
    import pyarrow.fs

    files = sorted(df.inputFiles())
    try:
        for f in files[:1]:
            store, path = pyarrow.fs.FileSystem.from_uri(_uri(f))
            if store.get_file_info(path).type != pyarrow.fs.FileType.File:
                return None
    except (pa.ArrowException, OSError):
        return None
    return files


def _uri(file: str) -> str:
    return re.sub("^file:/+", "file:///", file)


def _fetched(files: list[str], bits: int, keys: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """The entries of ascending keys, or ``absent``."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    out = np.repeat(absent, len(keys))
    edges = np.concatenate([[0], np.searchsorted(keys, _part_edges(bits)), [len(keys)]])
    for f in files:
        store, path = pyarrow.fs.FileSystem.from_uri(_uri(f))
        with store.open_input_file(path) as source:
            for rows in pq.ParquetFile(source).iter_batches(1, columns=["part", "keys", "entries"]):
                part = rows.column(0)[0].as_py()
                a, b = edges[part], edges[part + 1]
                if a < b and len(table_keys := np.frombuffer(rows.column(1)[0].as_buffer(), np.uint64)):
                    at = np.minimum(np.searchsorted(table_keys, keys[a:b]), len(table_keys) - 1)
                    hit = np.flatnonzero(table_keys[at] == keys[a:b])
                    out[a + hit] = np.frombuffer(rows.column(2)[0].as_buffer(), absent.dtype)[at[hit]]
    given_back()
    return out


TABLE = "part int, keys binary, entries binary"


def _row(part: int, keys: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([entries.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "entries"])


def _word_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, WORD) come sorted by part."""
    last, held = None, []

    def emit() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["key"])]
        return _row(last, np.ascontiguousarray(rows["key"]), rows)

    for batch in batches:
        parts = batch.column(0).to_numpy()
        into = np.zeros(len(parts), WORD)
        for i, name in enumerate(WORD.names, 1):
            column = batch.column(i).to_numpy()
            into[name] = column.view(np.uint64) if name == "key" else column
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if last is not None and parts[a] != last:
                    yield emit()
                    held = []
                last = int(parts[a])
                held.append(into[a:b])
    if held:
        yield emit()


def _pair_table(files: list[str], bits: int, by: list[list[float]], texts: tuple[float, float]):
    """What each pair of the packed rows (part, packed) adds to a difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = opened_pairs(packed)
                rows = rows[rows["second"] != ALONE]
                names = np.unique(np.concatenate([rows["first"], rows["second"]]))
                words = _fetched(files, bits, names, _UNKNOWN)
                key, more = pair_keys(rows["first"], rows["second"]), np.zeros(len(rows), np.float32)
                for a in range(0, len(rows), SOME):
                    own = rows[a : a + SOME]
                    pair = np.zeros(len(own), PAIR)
                    pair["n1"], pair["n0"], pair["g"] = own["n1"], own["n0"], weights(own, *texts)
                    more[a : a + SOME] = _summands(words[np.searchsorted(names, own["first"])], words[np.searchsorted(names, own["second"])], pair, by)[1]
                del rows, names, words
                order = np.argsort(key)
                key, more = key[order], more[order]
                given_back()
                yield _row(part, key, more)

    return run


def _by_reading(words: list[str], word_bits: int, pairs: list[str], pair_bits: int):
    """Rows (was, text) with their difference; the tables are read once for about ``AT_ONCE`` words of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        held: list[tuple] = []

        def known(i: int, files: list[str], bits: int, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[i][0] for _, some in held for _, _, *x in some)]))
            return keys, _fetched(files, bits, keys, absent)

        def flush() -> Iterator[pa.RecordBatch]:
            names, entries = known(0, words, word_bits, _UNKNOWN)
            alone = np.log(entries["p1"].astype(np.float64)) - np.log(entries["p0"].astype(np.float64))
            del entries
            keys, more = known(1, pairs, pair_bits, np.zeros(1, np.float32))
            for was, some in held:
                sums, counts = np.zeros(len(was)), np.zeros(len(was), np.int64)
                for which, lengths, (w, of_w), (k, of_k) in some:
                    out = alone[np.searchsorted(names, w)][of_w] + more[np.searchsorted(keys, k)][of_k]
                    sums[which] += np.bincount(np.repeat(np.arange(len(which)), lengths), out, len(which))
                    counts[which] += lengths
                yield pa.RecordBatch.from_arrays([was, pa.array(sums / np.maximum(counts, 1), pa.float64())], names=["was", "difference"])
            held.clear()
            given_back()

        n = 0
        for rows in batches:
            some = []
            for which, lengths, flat, at in _read(rows.column(1).to_pylist(), hashes):
                found = [np.unique(x, return_inverse=True) for x in (flat[at], pair_keys(flat[at - 1], flat[at]))]
                some.append((which, lengths, *((x, of.reshape(-1).astype(np.int32)) for x, of in found)))
                n += len(at)
            held.append((rows.column(0), some))
            if n > AT_ONCE:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    return run


def by_reading(own: DataFrame, model: Model) -> DataFrame | None:
    """Rows (was, text) of ``own`` with their difference, without moving a text; none if the shared folder is in a store that Arrow does not open."""
    bits = (model.words.count() // PART).bit_length()
    part = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    by_part = model.words.select(part.alias("part"), F.col("word").alias("key"), *WORD.names[1:]).repartition(1 << bits, "part").sortWithinPartitions("part")
    words = cut(by_part.mapInArrow(_word_table, TABLE))
    word_files = _files(words)
    if word_files is None:
        return None
    pairs = cut(model.packed.select("part", "packed").repartition(1 << model.parted, "part").mapInArrow(_pair_table(word_files, bits, model.by, model.texts), TABLE))
    schema = own.select("was", F.lit(0.0).alias("difference")).schema
    found = cut(own.mapInArrow(_by_reading(word_files, bits, _files(pairs), model.parted), schema))
    drop(pairs, words, model.packed)
    return found


def _where_they_lie(by: list[list[float]], model):
    """Rows (was, text) with their difference, by a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for rows in batches:
            out = differences_of(rows.column(1).to_pylist(), hashes, *model.value, by)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.float64())], names=["was", "difference"])

    return run


def _differences(by: list[list[float]], columns: list[str], place: int):
    """The rows with ``_difference``. Rows (grp, part, words, pairs, _was) come sorted by group, answers before texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        last, held, tables = None, ([], []), []

        for rows in batches:
            groups, parts = (np.array(rows.column(i).to_pylist(), np.int64) for i in (0, 1))
            order = groups * 2 + (parts < 0)
            cuts = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), len(order)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if groups[a] != last:
                    last, held, tables = groups[a], ([], []), []
                if parts[a] >= 0:
                    for i in (0, 1):
                        held[i].extend(rows.column(2 + i).slice(a, b - a).to_pylist())
                    continue
                if not tables:  # parts come in order, so the keys ascend
                    tables = [np.frombuffer(b"".join(x), t) for x, t in zip(held, (WORD, PAIR), strict=True)]
                    held = ([], [])
                was = rows.column(4).slice(a, b - a)
                fields = was.flatten()
                out = differences_of(fields[place].to_pylist(), hashes, tables[0], tables[1], by)
                yield pa.RecordBatch.from_arrays([*fields, pa.array(out, pa.float64())], names=[*columns, "_difference"])

    return run


def differences(docs: DataFrame, model: Model, group: int = GROUP) -> DataFrame:
    """``docs``, all columns, with ``_difference``: toxic less ordinary log-likelihood, a word."""
    columns = docs.columns
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, bits = max(1, -(-size // group)), model.bits
    dealt = docs.select(F.pmod(F.xxhash64(*columns), F.lit(n).cast("long")).alias("grp"), F.struct(*columns).alias("_was"))
    asked = dealt.select("grp", F.col("_was.text").alias("text")).repartition("grp").sortWithinPartitions("grp").mapInArrow(_asked(bits), "grp long, part int, words binary, pairs binary")
    part = lambda key: F.shiftrightunsigned(key, 64 - bits).cast("int").alias("part")
    names = [x.split()[0] for x in ENTRY.split(", ")]
    types = dict(x.split() for x in ENTRY.split(", "))

    def entries(rows: DataFrame, kind: int) -> DataFrame:
        own = {"kind": F.lit(kind)} | {c: F.col(c) for c in rows.columns if c in types}
        return rows.select(*(own.get(c, F.lit(None)).cast(types[c]).alias(c) for c in names))

    tables = entries(model.pairs.withColumn("part", part("key")), 0).union(entries(model.words.withColumnRenamed("word", "key").withColumn("part", part("key")), 1)).union(entries(asked, 2))
    answers = tables.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_answered, "grp long, part int, words binary, pairs binary")
    was = dealt.schema["_was"].dataType
    texts = dealt.select("grp", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("pairs"), "_was")
    both = answers.withColumn("_was", F.lit(None).cast(was)).union(texts).repartition("grp").sortWithinPartitions("grp", F.col("part") < 0, "part")
    schema = docs.withColumn("_difference", F.lit(0.0)).schema
    return both.mapInArrow(_differences(model.by, columns, columns.index("text")), schema)


def scored(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, name: str = "_score") -> DataFrame:
    """The columns ``keep`` (or all) of ``docs`` (doc_id, text and others) with a score from 0 to 1 in column ``name``, which they
    must not have; learned from ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    python_ready(spark)
    keep = keep or docs.columns
    if name in keep:
        raise ValueError(f"there is a column {name} already")
    marked = cut(marks(labels))
    share = min(PRIOR, float(marked.agg(F.avg("toxic")).first()[0] or 0.0))
    own = docs.select(F.struct(*keep).alias("was"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    model = fit(own.select("doc_id", "text"), marked)
    if model is None:
        return own.select("was.*", F.lit(share).alias(name))
    if model.entries <= BROADCAST:
        schema = own.select("was", F.lit(0.0).alias("difference")).schema
        found = own.select("was", "text").mapInArrow(_where_they_lie(model.by, spark.sparkContext.broadcast(model.arrays())), schema)
        found = cut(found)
    elif (found := by_reading(own.select("was", "text"), model)) is None:
        found = cut(differences(own.select("was", "text"), model).select("was", F.col("_difference").alias("difference")))
    held = marked.where(F.col("fold") == FOLDS - 1).select(F.col("doc_id").alias("_of"), "toxic")
    held = cut(found.select(F.col("was.doc_id").cast("long").alias("_of"), "difference").join(held, "_of").select("difference", "toxic"))
    offset, slope = calibrated(held) or (float(np.log(max(share, 1e-6) / (1 - share))), 1.0)
    x = F.col("difference")
    z = offset + slope * F.signum(x) * F.log1p(F.abs(x) / UNIT)
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return found.select("was.*", (1 / (1 + F.exp(-z))).alias(name))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return rows.select("doc_id", (_remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
