"""The opN queries against plain readings of their contracts, on hard rows and on the test data."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hard_rows import CLASHES, CLASHING, HARD
from oracle import check

from lodestrata.llm import registry

Q = registry.queries()


def rows(spark, name, folder):
    return [r.asDict() for r in Q[name](spark, folder).collect()]


def texts(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.fixture(params=["hard", "data"])
def folder(request, spark, sf, documents):
    return documents([(*r, *CLASHES) for r in HARD], CLASHING) if request.param == "hard" else sf


def same(found, want):
    assert Counter(found) == Counter(want)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_packing(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = Counter((d, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 2])) for d, t in texts(spark, folder))
    found = rows(spark, "op1_packing", folder)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found)
    starts = Counter()
    for (doc, ids), copies in whole.items():
        raw = np.array(ids, "<u4")
        own = sorted({p for p in pieces if p[0] == doc and p[4] == len(ids) and zlib.crc32(raw[p[1] : p[1] + p[2]].tobytes()) == p[3]}, key=lambda p: p[1])
        at = 0
        for p in own:
            assert p[1] == at
            at += p[2]
            starts[p] += copies
        assert at == len(ids)
    assert starts == pieces
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // 4096) * 1.2 + 2


def test_suffix_dedup(spark, folder):
    own = [(d, t.encode()) for d, t in texts(spark, folder)]
    seen = Counter(t[a : a + 400] for _, t in own for a in range(len(t) - 399))
    want = []
    for d, t in own:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - 399):
            if seen[t[a : a + 400]] > 1:
                gone[a : a + 400] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    same([tuple(r.values()) for r in rows(spark, "op2_suffix_dedup", folder)], want)


def shingle_sets(own, k):
    out = []
    for _, t in own:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def groups(own, sets, percent):
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(own))]


def test_ngram_join(spark, folder):
    own = texts(spark, folder)
    sets = shingle_sets(own, 4)
    root = groups(own, sets, 85)
    least = {}
    for (d, _), r in zip(own, root, strict=True):
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    want = [(d, len(s), least[r]) for (d, _), s, r in zip(own, sets, root, strict=True)]
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(spark, "op3_ngram_join", folder)], want)


def test_sharding(spark, folder):
    found = rows(spark, "op4_sharding", folder)
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], [(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts(spark, folder)])
    slots = defaultdict(list)
    for r in found:
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in _by(found, "doc_id", "shard").values())


def _by(found, key, value):
    out = defaultdict(set)
    for r in found:
        out[r[key]].add(r[value])
    return out


def luhn(d):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(k, *s) for k, found in (("email", email), ("ip", ip), ("card", card), ("phone", phone)) for s in found]


def secrets(t):
    pattern = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(pattern, t, re.A) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op5_pii", personal, ("email", "ip", "card", "phone")), ("op7_secret_scan", secrets, ("assign", "access", "hex"))])
def test_spans(spark, folder, documents, name, plain, kinds):
    found = rows(spark, name, folder)
    want = [(d, *(sum(s[0] == k for s in plain(t)) for k in kinds), digest(plain(t))) for d, t in texts(spark, folder)]
    same([(r["doc_id"], *(r[f"n_{k}"] for k in kinds), r["base_sha256"]) for r in found], want)
    for r in found:
        assert digest([tuple(s.split(":")) for s in r["spans"].split(",") if s.split(":")[0] in kinds]) == r["base_sha256"]


TRICKY = ["a@b.com_x@y.org a@b.c.d@e.f", "1.1.1.1.2.2.2.2 256.1.1.1 000001.2.3.4 1.2.3.4.5", "1 " * 20_000, "1" * 30_000, "🙂 4111 1111 1111 1111 x +49 (0)30 123-4567 é", "Token == 'abcdefg' API_KEY:\"a1b2c3d4\" SECRET = =abcdef password=abc", "deadbeef" * 4 + "g" + "a" * 23, "%%%@x.y.z.", "+1234567890123456 +12 345 678 9 +1((("]


@pytest.mark.parametrize(("name", "plain"), [("op5_pii", personal), ("op7_secret_scan", secrets)])
def test_tricky_spans(spark, documents, name, plain):
    folder = documents(list(enumerate(TRICKY)))
    same([(r["doc_id"], r["base_sha256"]) for r in rows(spark, name, folder)], [(d, digest(plain(t))) for d, t in texts(spark, folder)])


def test_byte_bpe(spark, folder):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(d, len(ids := library.encode_ordinary(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for d, t in texts(spark, folder)]
    same([tuple(r.values()) for r in rows(spark, "op8_byte_bpe", folder)], want)


def test_topk(spark, sf):
    check(spark, sf, Q["op9_topk"], registry.oracle_sql()["op9_topk"])


def test_topk_hard(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (100, [nan, 1.0]), (5, [inf, 0.0]), (None, [9.0, 9.0]), (6, []), (7, [-1.0, 0.004]), (2, [1.0, 2.0]), (150, [1e9, 1e9])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = [tuple(r) for r in Q["op9_topk"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    clean = sorted({(i, tuple(v)) for i, v in vectors if i is not None and v is not None and all(x is not None and abs(x) < inf for x in v)})
    want = []
    for q, v in clean:
        if q % 50 == 0:
            scores = [(-sum(int(np.floor(256 * float(np.float32(a)))) * int(np.floor(256 * float(np.float32(b)))) for a, b in zip(v, w, strict=False)), i) for i, w in clean if i != q]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert found == want


def test_media(spark, folder):
    found = rows(spark, "op10_media", folder)
    want = []
    for d, t in texts(spark, folder):
        raw = t.encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    keys = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    same([tuple(r[k] for k in keys) for r in found], want)
    assert all(len(x) == 1 for x in _by(found, "payload_sha256", "media_sha256").values())


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, tmp_path, name):
    for table, columns in (("documents", "doc_id long, text string"), ("labels", "doc_id long, toxic int"), ("embeddings", "vec_id long, embedding array<float>")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert Q[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, Q[name], registry.oracle_sql()[name])
