"""Packing by multiway differencing.

``pack`` tokenises whole texts and lays the ids into sequences of at most ``capacity`` tokens. A document's
full windows become sequences of their own; the rest of each document is cut into items of at most
``max_item`` tokens, and the items of a block are split into k windows by Karmarkar-Karp multiway
differencing: the two partial partitions with the largest imbalance are merged, the largest windows of one on
the smallest of the other, until one partition is left. Its windows are nearly equal; k starts at the least
possible count and rises whenever a window exceeds the capacity.

Blocks are cut within input partitions, so nothing is shuffled and a lost task is simply run again.
Memory of a task: one block.

Defined results: a null text counts as empty; an empty text is one piece, the end id alone; a null doc_id is
kept as null; repeated rows are packed each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import python_ready, table

CAPACITY, MAX_ITEM, BLOCK_ITEMS, END_ID = 4096, 1024, 768, 2
#: Words whose ids a task remembers at most, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Splits items 0.. of the given sizes into ``k`` nearly equal windows (lists of items)."""
    n = len(sizes)
    if k == 1:
        return [list(range(n))]
    left, right = [-1] * n, [-1] * n  # a node joins two others; the first n are the items
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        sums, of_b = a + b[::-1], of_b[::-1]
        nodes = np.where(of_a < 0, of_b, of_a)
        both = np.flatnonzero((of_a >= 0) & (of_b >= 0))
        if len(both):
            nodes[both] = np.arange(len(left), len(left) + len(both))
            left.extend(of_a[both].tolist())
            right.extend(of_b[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, nodes))
        serial += 1
    windows = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x], right[x])
        windows.append(sorted(items))
    return windows


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """``differencing`` with the least window count found whose windows all fit."""
    sizes_of = np.asarray(sizes, np.int64)
    k = max(1, -(-int(sizes_of.sum()) // capacity))
    while True:
        windows = differencing(sizes, k)
        over = sum(max(0, int(sizes_of[w].sum()) - capacity) for w in windows)
        if not over:
            return [w for w in windows if w]
        k += max(1, over // capacity)


class Known(dict):
    """What ``learn`` gives for a word; of long words nothing is remembered. Past ``REMEMBERED`` words only those of the
    last round and the one before are kept, so that frequent words stay."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.before = learn, {}

    def __missing__(self, word: str):
        found = self.before.get(word, self)
        if found is self:
            found = b"" if not word else self.learn(word)
        if len(word) <= LONGEST:
            self[word] = found
        return found

    def bound(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


class WordIds:
    """Ids of texts, as the tokenizers library gives them for the file at ``path``.

    Every match of the tokenizer's own split lies between spaces, so ids are kept per word. Plain words of Latin
    letters, digits and marks go through the same merges in tiktoken's faster core; all others, and all words if the
    file is of another make, through the library itself.

    In the core a byte that UTF-8 lacks stands for the end of a word and is merged first. The core joins two parts
    whenever their joined bytes are a token, the library only as listed; both agree, because a span whose edges
    no earlier merge has crossed is split just as the token alone would be, and there is one merge for each token.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Known(self._learn)
        self.core, self.ids = self._core(path)
        self.plain = regex.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    @classmethod
    def _core(cls, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        known_split = [x.get("pattern", {}).get("Regex") for x in steps] == ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", None]
        if not known_split or model.get("end_of_word_suffix") != "</w>" or model.get("ignore_merges"):
            return None, None
        # The usual printable stand-ins of bytes: printable Latin-1 stands for itself, the rest is moved up.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}

        def raw(token: str) -> bytes:
            end = token.endswith("</w>") and token != "</w>"
            return bytes(byte_of[c] for c in (token[:-4] if end else token)) + (cls.END if end else b"")

        vocab = model["vocab"]
        single = sorted((c for c in byte_of if c in vocab), key=byte_of.get)
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [(bytes([b]), vocab.get(c)) for c, b in sorted(byte_of.items(), key=lambda x: x[1])]
        order += [(raw(c + "</w>"), vocab.get(c + "</w>")) for c in single]
        order += [(raw(a + b), vocab[a + b]) for a, b in merged]
        ranks = {}
        for token, _ in order:
            if token in ranks:
                return None, None
            ranks[token] = len(ranks)
        encoding = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        return encoding._core_bpe.encode_single_piece, [b"" if i is None else np.asarray([i], "<u4").tobytes() for _, i in order]

    def _by_core(self, word: str) -> bytes:
        return b"".join([b"".join(map(self.ids.__getitem__, self.core(part.encode() + self.END))) for part in self.split(word)])

    def _learn(self, word: str) -> bytes:
        if self.core and self.plain(word) and "<|" not in word:
            return self._by_core(word.lower())
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for text in texts:
            self.known.bound()
            out.append(b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" "))))
        return out


_last: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """The encoder that the tasks of a Python worker use one after the other, with the words it remembers."""
    if path not in _last:
        _last.clear()
        _last[path] = WordIds(path)
    return _last[path]


def _pieces(path: str, capacity: int, max_item: int, block_items: int, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sequence, out = _word_ids(path), TaskContext.get().partitionId() << 33, []
        items: list[tuple] = []  # doc_id, start, length, crc, doc_tokens

        def emit(block: list[tuple]) -> None:
            nonlocal sequence
            for window in windows_of([x[2] for x in block], capacity):
                offset = 0
                for i in window:
                    out.append((*block[i], sequence, offset))
                    offset += block[i][2]
                sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for rows in batches:
            docs, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for doc, ids in zip(docs, ids_of(texts), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                while at < n:
                    length = capacity if n - at >= capacity else min(max_item, n - at)
                    piece = (doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n)
                    if length == capacity:
                        out.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        items.append(piece)
                    at += length
            while len(items) >= 2 * block_items:
                emit(items[:block_items])
                del items[:block_items]
            yield batch()
            out.clear()
        if items:
            emit(items)
        yield batch()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, max_item: int = MAX_ITEM, block_items: int = BLOCK_ITEMS, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) laid into sequences; ``tokenizer`` is a file of the tokenizers library."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, max_item, block_items, end_id), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
