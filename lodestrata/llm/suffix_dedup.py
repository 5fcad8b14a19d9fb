"""Suffix-array dedup: removes every byte covered by a string of ``size`` bytes that also starts anywhere else.

The collection is cut into parts that can be built apart. Each window of ``size`` bytes names one of its own k-grams,
its anchor: the least by (frequent or not, hash), the leftmost among equals. Equal windows have equal anchors at
the same offset, so only places with the same anchor can match, and an anchor that occurs once matches nothing.
What remains are segments (the windows that share one anchor occurrence), grouped by anchor; equal segments are one.

A group's segments are aligned at their anchor and its sorted suffixes are built column-wise: each round
inserts one symbol of every segment in front of the last ones, which permutes the segments by a stable sort of the
Burrows-Wheeler column, and updates the common prefixes of neighbours (one more than the least between them if
their symbols agree, else none). As matching windows stand at the same column, the order kept is that of the
column's own suffixes. A window is repeated if a neighbour in the order shares ``size`` symbols. The columns
of a batch are read one after the other; a batch holds at most ``BATCH`` + ``LARGE`` segments, so they stay in memory
instead of external files.

Anchors are counted over all documents; a bitmap of bounded size tells the later passes which occur again (it may
name too many, never too few). Texts that are equal as a whole are one until the end. A group of over ``LARGE``
segments is never held: its windows are counted by a 128-bit hash, in sums that any task can begin, once the stretches of
windows (``STRETCHES`` of a segment) whose common bytes stand in no other segment are left out.
Nothing is gathered by document but its own removed places.

Defined results: a null text counts as empty; texts under ``size`` bytes are left as they are; null doc_ids and
repeated rows are kept; an empty table gives no rows; the operator keeps other columns, the query ignores them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import bitmap, bits_for, cut, holds, python_ready, table
from lodestrata.llm.shingles import mixed

SIZE, GRAM = 400, 32
#: One document in so many is looked at for frequent anchors; so many sightings make one frequent.
SAMPLE, SEEN, FREQUENT = 32, 6, 100_000
#: Segments at which a batch ends with the group, segments above which a group's windows are counted, and stretches.
BATCH, LARGE, STRETCHES = 6000, 20_000, 8
MOST_BITS = 28
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each run of ``GRAM`` bytes (a power of two), by doubling."""
    h, size, factor = raw.astype(np.uint64) + np.uint64(1), 1, _FACTOR
    while size < GRAM:
        h = h[: len(h) - size] + h[size:] * factor
        size *= 2
        with np.errstate(over="ignore"):
            factor = factor * factor
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Anchors:
    """Anchors of the windows of many texts at once, given the ascending hashes of frequent k-grams."""

    def __init__(self, size: int, frequent: np.ndarray):
        if size < 2 * GRAM:
            raise ValueError(f"windows need {2 * GRAM} bytes or more")
        self.size, self.span, self.frequent = size, size - GRAM + 1, frequent
        self.bits = np.uint64(4 if self.span >= 256 else 3)

    def candidates(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all places of the joined texts, the places that may be anchors (one in 8 or 16 by hash, and all
        where a window would have none), and where each text starts."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
        valid = np.ones(len(h), bool)  # not across two texts
        over = (ends[:, None] - np.arange(1, GRAM)).reshape(-1)
        valid[over[over < len(h)]] = False
        chosen = (h >> (np.uint64(64) - self.bits) == 0) & valid
        edge = np.sort(np.concatenate([np.flatnonzero(chosen), starts - 1, ends - GRAM + 1]))
        for g in np.flatnonzero(np.diff(edge) > self.span):
            chosen[edge[g] + 1 : edge[g + 1]] = valid[edge[g] + 1 : edge[g + 1]]
        return h, np.flatnonzero(chosen), starts

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, hash and place of each anchor, and the first and last window that names it. All texts have ``size`` bytes."""
        h, at, starts = self.candidates(texts)
        of = np.searchsorted(starts, at, side="right") - 1
        own = h[at]
        rank = mixed(own) >> np.uint64(2)
        rank |= (own >> (np.uint64(64) - self.bits) != 0).astype(np.uint64) << np.uint64(63)
        if len(self.frequent):
            near = np.minimum(np.searchsorted(self.frequent, own), len(self.frequent) - 1)
            rank |= (self.frequent[near] == own).astype(np.uint64) << np.uint64(62)
        apart = 2 * self.span  # between the places of two texts
        wide = at + of * apart
        before, after = self._nearest(wide, rank, -1), self._nearest(wide, rank, 1)
        shift = starts[of] + of * apart
        lengths = np.array([len(t) for t in texts], np.int64)[of]
        first = np.maximum(np.maximum(before + 1, wide - self.span + 1) - shift, 0)
        last = np.minimum(np.minimum(after - self.span, wide) - shift, lengths - self.size)
        keep = first <= last
        return of[keep], own[keep], (at - starts[of])[keep], first[keep], last[keep]

    def batches(self, texts) -> Iterator[list[bytes]]:
        """The distinct texts of ``size`` bytes or more, some megabytes at a time."""
        held, total = [], 0
        for text in dict.fromkeys(texts):
            raw = text.encode()
            if len(raw) >= self.size:
                held.append(raw)
                total += len(raw)
                if total > 2 << 20:
                    yield held
                    held, total = [], 0
        if held:
            yield held

    def _nearest(self, at: np.ndarray, rank: np.ndarray, way: int) -> np.ndarray:
        """The nearest place to the left that ranks no higher, or to the right that ranks lower, within a window."""
        m = len(at)
        out = at + way * 2 * self.span
        left = np.arange(m)
        step = 0
        while len(left):
            step += 1
            j = left + way * step
            inside = (j >= 0) & (j < m)
            left, j = left[inside], j[inside]
            inside = np.abs(at[j] - at[left]) <= self.span
            left, j = left[inside], j[inside]
            hit = rank[j] <= rank[left] if way < 0 else rank[j] < rank[left]
            out[left[hit]] = at[j[hit]]
            left = left[~hit]
        return out


# ---------------------------------------------------------------- column-wise construction


def repeated(rows: list[bytes], anchor: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """For each segment and window (by its start, counted from ``span - 1`` places before the anchor) whether another
    segment of its group has the same window. ``anchor``: its place in the segment; ``group``: ascending numbers."""
    span, m = size - GRAM + 1, len(rows)
    width = span - 1 + size
    columns = np.full((m, width), 256, np.uint16)
    for i, row in enumerate(rows):
        start = span - 1 - int(anchor[i])
        columns[i, start : start + len(row)] = np.frombuffer(row, np.uint8)
    columns = np.ascontiguousarray(columns.T)  # a column after the other
    out = np.zeros((span, m), bool)
    order, group = np.arange(m), group.astype(np.int64)
    common = np.zeros(m, np.int32)  # of a suffix with the one before it in the order
    first = np.concatenate([[True], group[1:] != group[:-1]])
    levels = max(1, int(np.diff(np.append(np.flatnonzero(first), m)).max(initial=1))).bit_length()
    key = group * 512
    for c in range(width - 1, -1, -1):
        symbols = columns[c][order]
        moved = np.argsort(key + symbols, kind="stable")  # old places in the new order
        now = symbols[moved]
        # the least common prefix between two old places: a table of minima over powers of two
        same = np.zeros(m, bool)
        same[1:] = (now[1:] == now[:-1]) & ~first[1:] & (now[1:] != 256)
        at = np.flatnonzero(same)
        fresh = np.zeros(m, np.int32)
        if len(at):
            lo, hi = moved[at - 1] + 1, moved[at]
            length = hi - lo + 1
            level = np.frexp(length.astype(np.float64))[1] - 1
            least, result = common, np.empty(len(at), np.int32)
            for k in range(levels):
                use = np.flatnonzero(level == k)
                if len(use):
                    result[use] = np.minimum(least[lo[use]], least[hi[use] - (1 << k) + 1])
                if k + 1 < levels:
                    half = 1 << k
                    if half >= m:
                        break
                    least = np.concatenate([np.minimum(least[:-half], least[half:]), least[-half:]])
            fresh[at] = np.minimum(result + 1, size)
        order, common = order[moved], fresh
        if c < span:
            long_ = common >= size
            if long_.any():
                hit = long_.copy()
                hit[:-1] |= long_[1:]
                out[c, order[hit]] = True
    return out.T


def ranges_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags, ends exclusive."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


# ---------------------------------------------------------------- passes over the documents


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sampled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(size, np.zeros(0, np.uint64))
        for rows in batches:
            found = [np.zeros(0, np.int64)]
            for texts in anchors.batches(rows.column(0).to_pylist()):
                h, at, starts = anchors.candidates(texts)
                of = np.searchsorted(starts, at, side="right")
                pairs = np.unique(np.stack([of.astype(np.uint64), h[at]], 1), axis=0)  # once a text
                found.append(_signed(np.ascontiguousarray(pairs[:, 1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["h"])

    return run


def _counted(size: int, frequent):
    """How often each anchor occurs, batch by batch. Equal texts of a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(size, frequent.value)
        for rows in batches:
            found = [np.zeros(0, np.uint64)]
            for texts in anchors.batches(rows.column(0).to_pylist()):
                found.append(anchors(texts)[1])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h), pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

    return run


def _key(segment: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(segment)


def _segments(size: int, frequent, again, with_bytes: bool):
    """Segments at anchors that the bitmap holds: their bytes and number, equal ones of a batch as one, or their
    places, by text and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, packed = Anchors(size, frequent.value), np.frombuffer(again.value, np.uint8)
        for rows in batches:
            held: dict[tuple, int] = {}
            places: list[tuple] = []
            for texts in anchors.batches(rows.column(0).to_pylist()):
                of, h, at, first, last = anchors(texts)
                keep = holds(packed, _signed(h))
                digests: dict[int, str] = {}
                for d, x, p, a, b in zip(of[keep].tolist(), _signed(h[keep]).tolist(), at[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                    segment = texts[d][a : b + size]
                    if with_bytes:
                        held[x, p - a, segment] = held.get((x, p - a, segment), 0) + 1
                    else:
                        if d not in digests:
                            digests[d] = hashlib.sha256(texts[d]).hexdigest()
                        places.append((x, _key(segment), digests[d], a))
            if with_bytes:
                columns = [[k[0] for k in held], [k[1] for k in held], [k[2] for k in held], list(held.values())]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "anchor", "segment", "n"])
            else:
                columns = list(zip(*places, strict=True)) or [[]] * 4
                kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "key", "digest", "start"])

    return run


def _built(size: int):
    """Repeated windows of each segment, as ranges of starts from the segment's own. Rows come sorted by group and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = size - GRAM + 1

        def emit(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "key", "low", "high"])

        def build(groups: list[list[list]]) -> pa.RecordBatch:
            found, rows, anchor, number, of = [], [], [], [], []
            for i, g in enumerate(groups):
                for h, place, segment, n in g:
                    if n > 1:
                        found.append((h, _key(segment), 0, len(segment) - size + 1))
                if len(g) > 1:
                    for h, place, segment, n in g:
                        rows.append(segment)
                        anchor.append(place)
                        number.append(i)
                        of.append((h, n))
            if rows:
                flags = repeated(rows, np.array(anchor), np.array(number), size)
                for i in np.flatnonzero(flags.any(axis=1)).tolist():
                    if of[i][1] == 1:
                        start = span - 1 - anchor[i]
                        found += [(of[i][0], _key(rows[i]), a - start, b - start) for a, b in ranges_of(flags[i])]
            return emit(found)

        groups: list[list[list]] = []
        last, held = None, 0
        for batch in batches:
            for key, h, place, segment, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != last:
                    if held >= BATCH:
                        yield build(groups)
                        groups, held = [], 0
                    groups.append([])
                    last = key
                own = groups[-1]
                if own and own[-1][2] == segment and own[-1][1] == place:
                    own[-1][3] += n
                else:
                    own.append([h, place, segment, n])
                    held += 1
        yield build(groups)

    return run


def _stretches(segment: bytes, anchor: int, h: int, size: int) -> Iterator[tuple[int, int, int]]:
    """A hash of the bytes that all windows of a stretch share, and the first and last of its windows in the segment."""
    import xxhash

    span = size - GRAM + 1
    least, most = anchor - (len(segment) - size), anchor  # of the windows' distances to the anchor
    for j in range(STRETCHES):
        low, high = -(-j * span // STRETCHES), -(-(j + 1) * span // STRETCHES) - 1
        if max(low, least) <= min(high, most):
            x = xxhash.xxh3_64_intdigest(segment[anchor - low : anchor + size - high], seed=(h + j) % (1 << 64))
            yield x, anchor - min(high, most), anchor - max(low, least)


def _shared(size: int):
    """How often the common bytes of each stretch stand there. Rows are (h, anchor, segment, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held: dict[int, int] = {}
            for h, anchor, segment, n in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                for x, _, _ in _stretches(segment, anchor, h, size):
                    held[x] = held.get(x, 0) + n
            yield pa.RecordBatch.from_arrays([_signed_array(list(held)), pa.array(list(held.values()), pa.int64())], names=["x", "n"])

    return run


def _signed_array(h: list[int]) -> pa.Array:
    return pa.array(_signed(np.array(h, np.uint64)), pa.int64())


def _windows(size: int, live):
    """Hash of each window in the stretches that the bitmap holds, with its segment and start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(live.value, np.uint8)
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for rows in batches:
            for h, anchor, segment, n in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                own = list(_stretches(segment, anchor, h, size))
                hit = holds(packed, np.array([x for x, _, _ in own], np.uint64)).tolist()
                starts = [i for (_, a, b), yes in zip(own, hit, strict=True) if yes for i in range(a, b + 1)]
                if starts:
                    m = len(starts)
                    columns = [[_key(segment[i : i + size]) for i in starts], [h] * m, [_key(segment)] * m, starts, [n] * m]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["window", "h", "key", "at", "n"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of the starts of each segment. Rows are (h, key, starts)."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
    for rows in batches:
        out = []
        for h, key, starts in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
            flags = np.zeros(max(starts) + 1, bool)
            flags[starts] = True
            out += [(h, key, a, b) for a, b in ranges_of(flags)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "key", "low", "high"])


def counted_ranges(segments: DataFrame, size: int) -> DataFrame:
    """What ``_built`` finds, for groups of any size: nothing but single segments and sums is held."""
    spark = segments.sparkSession
    segments = cut(segments.groupBy("h", "anchor", "segment").agg(F.sum("n").alias("n")))
    shared = segments.mapInArrow(_shared(size), "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))
    live = cut(shared.where("n > 1").select("x"))
    bits = spark.sparkContext.broadcast(bitmap(live, F.col("x").bitwiseAND(F.lit((1 << MOST_BITS) - 1)), bits_for(live.count())))
    windows = segments.mapInArrow(_windows(size, bits), "window binary, h long, key binary, at int, n long")
    again = windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    starts = windows.join(again, "window").groupBy("h", "key").agg(F.collect_set("at").alias("starts"))  # under ``size`` each
    return starts.mapInArrow(_runs, "h long, key binary, low int, high int")


def _kept(size: int):
    """What is left of each text (digest, text, ranges of repeated windows): numbers, digest and removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for digest, text, spans in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                raw = _raw(text)
                gone = np.zeros(len(raw) + 1, np.int32)
                for s in spans:
                    gone[s["low"]] += 1
                    gone[s["high"] - 1 + size] -= 1
                mask = np.cumsum(gone[:-1]) > 0
                removed = ranges_of(mask)
                out.append((digest, int(mask.sum()), len(removed), hashlib.sha256(raw[~mask].tobytes()).hexdigest(), [{"low": a, "high": b} for a, b in removed]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def _named(wanted):
    """Text and digest of the rows whose digest the bitmap holds; equal texts of a batch come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(wanted.value, np.uint8)
        for rows in batches:
            texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in rows.column(0).to_pylist()}
            hit = holds(packed, np.array([int(d[:14], 16) for d in texts], np.int64)).tolist()
            own = {d: t for (d, t), yes in zip(texts.items(), hit, strict=True) if yes}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.string())], names=["digest", "text"])

    return run


def removed_spans(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``digest`` (SHA-256 of the text) and ``n_bytes``, and for each digest that loses bytes: n_removed,
    n_spans, kept_sha256 and the removed byte ranges (none listed where a whole text goes)."""
    spark = docs.sparkSession
    python_ready(spark)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text")).where(F.octet_length("text") >= size)
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(_sampled(size), "h long")
    top = sampled.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["h"] % (1 << 64) for r in top], np.uint64)))

    counts = texts.mapInArrow(_counted(size, frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    again = cut(counts.where("n > 1"))
    bits = spark.sparkContext.broadcast(bitmap(again, F.col("h").bitwiseAND(F.lit((1 << MOST_BITS) - 1)), bits_for(again.count())))
    segments = texts.mapInArrow(_segments(size, frequent, bits, True), "h long, anchor int, segment binary, n long")
    many = cut(again.where(F.col("n") > LARGE).select("h"))
    some = many.limit(1).count() > 0
    small = segments.join(many, "h", "left_anti") if some else segments
    grouped = small.select(F.col("h").alias("key"), "h", "anchor", "segment", "n")
    ranges = grouped.repartition("key").sortWithinPartitions("key", "anchor", "segment").mapInArrow(_built(size), "h long, key binary, low int, high int")
    if some:
        ranges = ranges.union(counted_ranges(segments.join(many, "h", "left_semi"), size))
    ranges = cut(ranges.distinct())
    places = texts.mapInArrow(_segments(size, frequent, bits, False), "h long, key binary, digest string, start long")
    spans = places.join(ranges, ["h", "key"]).select("digest", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    spans = spans.distinct().groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    rows = docs.withColumns({"digest": F.sha2(text, 256), "n_bytes": F.octet_length(text).cast("long")})
    short = cut(rows.select("digest", "n_bytes").groupBy("digest").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")))
    several = short.where((F.col("copies") > 1) & (F.col("n_bytes") >= size))
    empty = "array<struct<low:bigint,high:bigint>>"
    whole = several.select("digest", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high"))).cast(empty).alias("removed"))
    spans = cut(spans.join(several.select("digest"), "digest", "left_anti"))
    wanted = spark.sparkContext.broadcast(bitmap(spans, F.conv(F.substring("digest", 1, 14), 16, 10).cast("long"), bits_for(spans.count())))
    named = texts.mapInArrow(_named(wanted), "digest string, text string")
    parts = named.groupBy("digest").agg(F.first("text").alias("text")).join(spans, "digest").select("digest", "text", "spans")
    partly = parts.mapInArrow(_kept(size), f"digest string, n_removed long, n_spans long, kept_sha256 string, removed {empty}")
    return rows, cut(partly.union(whole))


def dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs``, all columns, with the repeated bytes of ``text`` cut out; characters that lose a byte go as a whole."""
    columns = docs.columns
    rows, results = removed_spans(docs.withColumn("_was", F.struct(*columns)).select("_was", "text"), size)
    joined = rows.join(results.select("digest", "removed"), "digest", "left")
    schema = docs.schema
    place = columns.index("text")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            was, removed = batch.column(0), batch.column(1).to_pylist()
            texts = was.field(place).to_pylist()
            out = [t if t is None or not r else _without(t, r) for t, r in zip(texts, removed, strict=True)]
            arrays = [pa.array(out, pa.string()) if i == place else was.field(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.select("_was", "removed").mapInArrow(run, schema)


def _without(text: str, removed: list[dict]) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    gone = np.zeros(len(raw), bool)
    for r in removed:
        gone[r["low"] : r["high"]] = True
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.repeat(np.logical_or.reduceat(gone, starts), np.diff(np.append(starts, len(raw)))) if len(starts) else gone
    return raw[~whole].tobytes().decode()


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, results = removed_spans(docs)
    out = rows.select("doc_id", "digest", "n_bytes").join(results.drop("removed"), "digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"))
