"""Byte-level BPE: encoding and decoding by a given rank file.

Tier one: a minimal perfect hash over the vocabulary (hash and displace, 50 thousand entries) resolves a
pre-token that is a token itself. Tier two: any other pre-token is merged by a heap of (rank, position) over a
linked list of its bytes, in O(n log n), always the lowest rank and, among equals, the leftmost.

A split at a single space between two other characters never changes the pre-tokens, so a task remembers the ids
of what stands between spaces, and looks each such word up once a batch; texts with other runs of white space at a space
are split by the pattern as a whole.

The work is one pass over the input: no shuffle, and memory bounded by a batch and the remembered words.

Defined results: a null text counts as empty; the empty text has no ids, and the digests are those of the empty
string; null doc_ids and repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import python_ready, table

#: Words whose ids a task remembers at most, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: Bits of a place in a pre-token.
PLACE = 40
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys take the slots 0 to n - 1."""

    def __init__(self, keys: list[bytes]):
        import xxhash

        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        digest = [xxhash.xxh3_128_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(digest):
            members[h % self.buckets].append(i)
        self.shift, self.keys, taken = [0] * self.buckets, [b""] * n, bytearray(n)
        self.index = [0] * n
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if not own:
                break
            if len(own) == 1:  # any free slot will do; kept as a negative number
                while taken[free]:
                    free += 1
                slots, self.shift[b] = [free], -free - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(digest[i], d) for i in own]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for i, s in zip(own, slots, strict=True):
                taken[s], self.keys[s], self.index[s] = 1, keys[i], i

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 32) + d * (h >> 80) + d * (d + 1) // 2) % self.n

    def get(self, key: bytes) -> int:
        """The number of ``key`` among the keys given, or -1."""
        import xxhash

        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.index[slot] if self.keys[slot] == key else -1


class Codec:
    """Ids of pre-tokens and back. ``tokens``: the bytes of each rank, in order."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.hash, self.ranks = tokens, PerfectHash(tokens), {t: i for i, t in enumerate(tokens)}
        self.two = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]  # of pairs of bytes

    @classmethod
    def read(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            ranks = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
        if [r for r, _ in ranks] != list(range(len(ranks))):
            raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
        return cls([t for _, t in ranks])

    def word(self, piece: bytes) -> list[int]:
        whole = self.hash.get(piece)
        return [whole] if whole >= 0 else self.merged(piece)

    def merged(self, piece: bytes) -> list[int]:
        """The heap holds rank and start, in one number, of neighbours whose joined bytes are a token."""
        n, rank_of, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        two = self.two
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of a part and the next one, or -1
        pair.append(-1)
        heap = [rank << PLACE | a for a, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            a = top & (1 << PLACE) - 1
            if pair[a] != top >> PLACE:
                continue  # one of the two parts has been merged meanwhile
            b = end[a]
            stop = end[a] = end[b]
            pair[a] = pair[b] = -1
            if stop < n:
                before[stop] = a
                rank = pair[a] = rank_of(piece[a : end[stop]], -1)
                if rank >= 0:
                    push(heap, rank << PLACE | a)
            left = before[a]
            if left >= 0:
                rank = pair[left] = rank_of(piece[left:stop], -1)
                if rank >= 0:
                    push(heap, rank << PLACE | left)
        ids, a = [], 0
        while a < n:
            if (rank := rank_of(piece[a : end[a]])) is None:
                raise ValueError(f"no rank for the byte {piece[a]}")
            ids.append(rank)
            a = end[a]
        return ids


class Known(dict):
    """What ``learn`` gives for a word; of long words nothing is remembered. Past ``REMEMBERED`` words only those of the
    last round and the one before are kept, so that frequent words stay."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.before = learn, {}

    def __missing__(self, word: str):
        found = self.before.get(word, self)
        if found is self:
            found = self.learn(word)
        if len(word) <= LONGEST:
            self[word] = found
        return found

    def bound(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


class Encoder:
    def __init__(self, codec: Codec, pattern: str):
        import regex

        self.codec, self.split = codec, regex.compile(pattern).findall
        self.parts: dict[str, bytes] = {}  # of pre-tokens
        self.known = Known(self._learn)  # of a space and a word

    def _part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            found = array("i", self.codec.word(piece.encode())).tobytes()
            if len(piece) <= LONGEST:
                self.parts[piece] = found
        return found

    def span(self, text: str) -> bytes:
        """Ids of ``text``, packed."""
        return b"".join(map(self._part, self.split(text)))

    def _learn(self, word: str) -> bytes | None:
        """Ids of a space and ``word``; None where the split at that space may matter."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return self.span(" " + word)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each text begin and end.

        Each word between spaces is looked up once a batch; its ids then go to all its places together.
        """
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.known.bound()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        lists = pc.split_pattern(texts, " ")
        edge = np.asarray(lists.offsets).astype(np.int64)
        heads, edge = edge[:-1] - edge[0], edge[1:] - edge[0]
        words = lists.flatten().dictionary_encode()
        at = np.asarray(words.indices).astype(np.int64)
        first = np.zeros(len(at), bool)
        first[heads] = True
        names, used = words.dictionary.to_pylist(), np.zeros(len(words.dictionary), bool)
        used[at[~first]] = True
        found = [self.known[w] if yes else b"" for w, yes in zip(names, used.tolist(), strict=True)]
        unsure = np.array([x is None for x in found], bool)[at]
        begins = [names[w] for w in at[heads].tolist()]
        unsure[heads] = [w[-1:].isspace() for w in begins]
        apart = np.logical_or.reduceat(unsure, heads)  # texts that are split as a whole
        at[heads] = len(found) + np.arange(len(heads))  # what a text starts with, or all of it
        spans = [self.span(texts[i].as_py() if whole else w) for i, (whole, w) in enumerate(zip(apart.tolist(), begins, strict=True))]
        keep = first | ~np.repeat(apart, edge - heads)
        packed = [x or b"" for x in found] + spans
        sizes = np.array([len(x) >> 2 for x in packed], np.int64)
        starts = np.cumsum(sizes) - sizes
        count = np.where(keep, sizes[at], 0)
        ends = np.cumsum(count)
        place = np.repeat(starts[at] - (ends - count), count) + np.arange(ends[-1])
        return np.frombuffer(b"".join(packed), np.int32)[place], np.concatenate([[0], ends[edge - 1]])


class Bytes:
    """Byte strings by number, laid out one after the other for many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.strings = pa.array(strings, pa.large_binary())

    def __call__(self, numbers: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The strings of ``numbers``, joined, and where each begins, with the end."""
        out = self.strings.take(pa.array(numbers))
        return memoryview(out.buffers()[2] or b""), np.frombuffer(out.buffers()[1], np.int64, len(numbers) + 1) if len(numbers) else np.zeros(1, np.int64)


_last: list = []


def _encoder(codec: Codec, pattern: str) -> Encoder:
    """The encoder that the tasks of a Python worker use one after the other, with the words it remembers."""
    if not _last or _last[0] is not codec or _last[1] != pattern:
        _last[:] = [codec, pattern, Encoder(codec, pattern)]
    return _last[2]


def _digests(shipped, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        numbers, tokens = Bytes([b"%d " % i for i in range(len(shipped.value.tokens))]), Bytes(shipped.value.tokens)
        sha = hashlib.sha256
        for rows in batches:
            ids, edge = encoder(rows.column(1))
            joined, at = numbers(ids)
            a = [sha(joined[i : max(i, j - 1)]).hexdigest() for i, j in zip(at[edge[:-1]].tolist(), at[edge[1:]].tolist(), strict=True)]
            raw, at = tokens(ids)
            b = [sha(raw[i:j]).hexdigest() for i, j in zip(at[edge[:-1]].tolist(), at[edge[1:]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(edge)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(shipped, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        for rows in batches:
            ids, edge = encoder(rows.column(1))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return run


def _texts(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Bytes(shipped.value.tokens)
        for rows in batches:
            ids = [x or [] for x in rows.column(1).to_pylist()]
            edge = np.cumsum([0, *map(len, ids)])
            raw, at = tokens(np.array([i for x in ids for i in x], np.int32))
            out = [bytes(raw[i:j]) for i, j in zip(at[edge[:-1]].tolist(), at[edge[1:]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    python_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _ship(docs: DataFrame, path: str):
    """The codec as a broadcast: its size is that of the rank file, whatever the data."""
    return docs.sparkSession.sparkContext.broadcast(Codec.read(path))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every text."""
    return _rows(docs).mapInArrow(_ids(_ship(docs, path), pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of every row of ids."""
    python_ready(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_texts(_ship(encoded, path)), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts and digests of the ids of every text and of what they decode to, in one pass."""
    return _rows(docs).mapInArrow(_digests(_ship(docs, path), pattern), SCHEMA)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
