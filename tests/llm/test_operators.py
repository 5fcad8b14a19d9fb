"""Operators apart from their queries: general forms, models, formats, the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hard_rows import CLASHES, CLASHING, HARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import byte_bpe, media, ngram_join, packing, pii, secret_scan, sharding, suffix_dedup, topk, toxicity, webp
from lodestrata.llm.common import cut, shared_dir
from lodestrata.llm.components import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 12))
def test_differencing_keeps_items(sizes, k):
    windows = packing.differencing(sizes, k)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    fit = packing.windows_of(sizes, 1000)
    assert sorted(i for w in fit for i in w) == list(range(len(sizes))) and max(sum(sizes[i] for i in w) for w in fit) <= 1000


def test_differencing_balances():
    random.seed(1)
    sizes = [random.randint(100, 1000) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 50)]
    assert max(sums) - min(sums) < 20


def test_words_as_the_library():
    import public_tokenizers

    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert own.core
    vocabulary = list(own.tokenizer.get_vocab())
    random.seed(2)
    words = vocabulary + [v.replace("</w>", "") for v in vocabulary] + ["".join(random.choice("abcdefghijklmnoprstuvzéß'0.,-") for _ in range(random.randint(1, 24))) for _ in range(20_000)]
    words += ["ΑΣ", "İx", "<|endoftext|>", "áb", "a\x1cb", "日本", "\xad"]
    for w, got in zip(words, own(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == own.tokenizer.encode(w, add_special_tokens=False).ids, w


def test_perfect_hash():
    keys = [hashlib.md5(str(i).encode()).digest()[: 1 + i % 9 + 2] for i in range(3000)]
    keys = sorted(set(keys))
    h = byte_bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(len(keys)))
    assert h.get(b"no such key") == -1


def test_encode_and_decode(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    back = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t in HARD)


def test_tree_moves_only_into_the_new_shard(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    grown = sharding.with_shard(sharding.with_shard(keys, F.col("k"), sharding.tree(20), "a"), F.col("k"), sharding.tree(21), "b")
    moved = grown.where("a <> b").select("b").distinct().collect()
    assert [r[0] for r in moved] == [20]
    heavy = sharding.with_shard(keys, F.col("k"), sharding.tree(4, {0: 3.0}), "s").groupBy("s").count().collect()
    counts = {r["s"]: r["count"] for r in heavy}
    assert 1700 < counts[0] < 2300 and len(counts) == 4


def test_shards_refuse_counts_without_the_law(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        sharding.shards(docs, 15)


def test_votes_and_reliability():
    good = {1 + 3 * 1 + 9 * 1: 300.0, 2 * 27 + 9 * 2: 300.0, 1 + 27 * 2: 5.0, 0: 50.0}
    chance, rates, share = pii.estimate(good)
    assert chance[1 + 3 + 9] > 0.9 and chance[2 * 27 + 18] < 0.1 and 0.3 < share < 0.7
    assert all(a >= b for a, b in rates)


def test_redaction(spark):
    rows = [(*r, *CLASHES) for r in HARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + CLASHING)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(HARD)
    text = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert text[10].startswith("[EMAIL] [PHONE], [CARD], [IP] password") and text[1] is None and text[2] == ""


def test_ledger_scans_only_new_pairs(spark, documents):
    folder = documents([(1, "password=abcdef"), (2, "password=abcdef"), (3, "clean")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ledger = f"{shared_dir(spark)}/test-{random.random()}"
    assert sorted((r["doc_id"], len(r["findings"])) for r in secret_scan.scan(docs, ledger).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert spark.read.parquet(ledger).count() == 2
    more = docs.union(spark.createDataFrame([(4, "token: xyzxyz"), (5, "clean")], docs.schema))
    assert sorted((r["doc_id"], len(r["findings"])) for r in secret_scan.scan(more, ledger).collect()) == [(1, 1), (2, 1), (3, 0), (4, 1), (5, 0)]
    assert spark.read.parquet(ledger).count() == 3
    secret_scan.scan(more, ledger, "next").collect()
    assert spark.read.parquet(ledger).count() == 6


def test_other_secrets(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.abc", "ghp_" + "a" * 36]
    found = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[f["k"] for f in r["findings"]] for r in sorted(found, key=lambda r: r["doc_id"])] == [[3], [4], [5, 2]]


def test_whole_names_are_candidates(spark):
    names = ["Frau Schäfer", "Herr Müller", "Mme Éloise", "Mr. John Smith", "Dr O'Brien-Łukasz", "Sra Mun\u0303oz Ibáñez", "Mr Bartholomewfitzgeraldson"]
    docs = spark.createDataFrame([(i, f"so {n} went, 'and {n}' too", n) for i, n in enumerate(names)], "doc_id long, text string, name string")
    for r in pii.with_candidates(docs).collect():
        assert [r["text"][c["s"] : c["e"]] for c in r["candidates"]] == [r["name"]] * 2
    everything = {("", 0): 1.0}
    assert [r["added"] for r in pii.find(docs.where("doc_id = 0"), everything).collect()][0][0]["e"] == len("so Frau Schäfer")


def test_toxicity_on_held_out_rows(spark, documents, tmp_path):
    random.seed(3)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(500)]
    rows, labels = [], []
    for i in range(1200):
        own = random.choices(words, k=random.randint(20, 200))
        if toxic := i % 4 == 0:
            own += random.choices(["zounds", "blaggard", "knave"], k=4)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    folder = documents(rows)
    spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    truth = dict(labels)
    found = [r for r in toxicity.op6_toxicity(spark, folder).collect() if r["held_out"]]
    assert len(found) > 150 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_counts_rare_expressions(spark):
    # each word stands in one or two texts, far under any threshold of evidence
    rows = [(i, f"common w{chr(97 + i % 26)}{chr(97 + i // 26)}x common tail") for i in range(200)] + [(1000, "common wbax common tail"), (1001, "common never common tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(i, int(i % 2 == 0), 1) for i in range(200)], "doc_id long, toxic int, fold int")
    model = toxicity.fit(docs, marked)
    keys = {r["key"] % (1 << 64): (r["n1"], r["n0"]) for r in model.pairs.collect()}
    hashes, want = toxicity.Hashes(), {}
    for i, text in rows[:200]:
        ws = ["", *toxicity.words_of(text)]
        for v, w in zip(ws, ws[1:], strict=False):
            ids = [np.array([hashes[x] if x else toxicity.START], np.uint64) for x in (v, w)]
            own = want.setdefault(int(toxicity.pair_keys(*ids)[0]), [0, 0])
            own[i % 2] += 1
    assert keys == {k: tuple(v) for k, v in want.items()}
    found = {r["doc_id"]: r["_difference"] for group in (1 << 20, 500) for r in toxicity.differences(docs, model, group).collect()}
    assert len(found) == len(rows) and all((found[i] > found[1001]) == (i % 2 == 0) for i in range(200))
    assert abs(found[1000] - found[1]) < 1e-9


def test_toxicity_counts_words_by_what_stands_before_them(spark):
    texts = [f"{v} zig" for v in "abcdef"] + ["a zag"] * 6 + ["other words"] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = spark.createDataFrame([(i, int(i < 12), 1) for i in range(len(texts))], "doc_id long, toxic int, fold int")
    found = {r["word"] % (1 << 64): r["p1"] for r in toxicity.fit(docs, marked).words.collect()}
    hashes = toxicity.Hashes()
    assert found[hashes["zig"]] > 1.01 * found[hashes["zag"]]  # equal numbers of words and texts


def test_toxicity_counts_all_labelled_texts(spark):
    # 11 MB of either class, each text with a word of its own
    texts = [f"own{chr(97 + i % 26)}{chr(97 + i // 26)} " + "common words " * 28_000 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    marked = spark.createDataFrame([(i, i % 2, 1 + i % 3) for i in range(60)], "doc_id long, toxic int, fold int")
    keys = {r["key"] % (1 << 64): (r["n1"], r["n0"]) for r in toxicity.fit(docs, marked).pairs.collect()}
    hashes = toxicity.Hashes()
    for i, text in enumerate(texts):
        pair = [np.array([h], np.uint64) for h in (toxicity.START, hashes[text.split()[0]])]
        assert keys[int(toxicity.pair_keys(*pair)[0])] == (i % 2, 1 - i % 2)


def test_toxicity_passes_on_small_batches():
    n = 100_000
    rows = np.zeros(n, toxicity.PAIRS)
    rows["first"], rows["second"], rows["n1"] = np.arange(1, n + 1), np.arange(2, n + 2), 1
    batch = toxicity.pa.RecordBatch.from_arrays([toxicity.pa.array([toxicity.packed_pairs(rows)], toxicity.pa.binary())], names=["packed"])
    out = list(toxicity._word_stats(iter([batch])))
    assert max(x.nbytes for x in out) <= 2 << 20  # a batch takes as much of the executor's JVM again
    words = np.concatenate([x.column(0).to_numpy() for x in out])
    assert words.tolist() == list(range(1, n + 2))
    assert sum(x.column(x.schema.get_field_index("t1")).to_numpy().sum() for x in out) == n


def test_toxicity_is_calibrated_on_all_rows(spark):
    rng = np.random.default_rng(5)
    difference, toxic = rng.normal(size=45_000) * 0.01, rng.integers(0, 2, 45_000)
    difference[44_000:] += 0.05 * toxic[44_000:]  # where a part of the rows would not look
    rows = spark.createDataFrame([(float(d), int(t)) for d, t in zip(difference, toxic, strict=True)], "difference double, toxic int")
    offset, slope = toxicity.calibrated(rows)
    x = np.sign(difference) * np.log1p(np.abs(difference) / toxicity.UNIT)
    off = toxic - 1 / (1 + np.exp(-(offset + slope * x)))
    assert slope > 0 and abs(off.sum()) < 0.1 and abs((off * x).sum()) < 0.1  # the gradient over all of them, but for the ridge
    assert toxicity.calibrated(rows.where("toxic = 0")) is None


def test_toxicity_on_hard_rows(spark, documents):
    folder = documents([(*r, *CLASHES) for r in HARD], CLASHING)
    spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = toxicity.op6_toxicity(spark, folder).collect()
    assert len(found) == len(HARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_sf_held_out_accuracy(spark, sf):
    # few labels at this size; the larger tables are in the README
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in toxicity.op6_toxicity(spark, sf).collect() if r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in found]) > 0.8


def test_cover_tree_search_equals_brute_force():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(700, 8)) * 50)
    x[300:400] = x[3]
    q, ids = x[::20], np.arange(700) * 3
    got = topk.search(q, x, ids[::20], ids, 5, leaf=16)
    for row, mine, best in zip(q, ids[::20], got, strict=True):
        want = sorted((-int(s), int(i)) for s, i in zip(x @ row, ids, strict=True) if i != mine)[:5]
        assert [(-s, i) for s, i in best] == want


def test_topk_loses_no_row_to_repeated_ones(spark, tmp_path):
    equal, other = [1.0, 2.0], [1.0, 1.0]
    tables = {
        "many": [(100, equal), *[(7, equal)] * 10, (8, equal), (9, equal), (50, other)],
        "few": [(100, equal), *[(7, equal)] * 2, (3, other), (3, other), (3, [0.5, 1.25]), (50, equal)],
        "own": [(150, other), (151, equal), (151, [3.0, 1.0]), (7, equal), (8, equal), (9, equal)],
    }
    for name, rows in tables.items():
        folder = tmp_path / name
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(folder / "embeddings.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT DISTINCT * FROM '{folder}/embeddings.parquet/*.parquet'")
        found = [tuple(r) for r in topk.op9_topk(spark, str(folder)).orderBy("query_id", "rank").collect()]
        assert found == sorted(con.execute(topk.OP9_SQL).fetchall())
    # the query's own rows, more than k of them, hide no others
    x = np.array([equal] * 16)
    ids = np.array([7] * 8 + [5] * 2 + [8, 9, 9, 9, 9, 9])
    assert topk.search(x[:1], x, np.array([5]), ids, 5) == [[(5, 7)] * 5]
    assert topk.search(x[:1], x, np.array([7]), ids, 5) == [[(5, 5), (5, 5), (5, 8), (5, 9), (5, 9)]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (100, 102), (103, 102), (7, 7)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 104))


def test_one_of_each(spark):
    rows = [(*r, *CLASHES) for r in HARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + CLASHING)
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def near_copies(number, words, changed, seed=6):
    random.seed(seed)
    base = [f"w{random.randint(0, 400)}" for _ in range(words)]
    rows = []
    for i in range(number):
        own = list(base)
        for _ in range(random.randint(*changed)):
            own[random.randrange(words)] = f"x{random.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    return rows


def plain_components(texts, k, percent):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if label[i] != label[j] and 100 * both >= percent * (len(a) + len(b) - both):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


@pytest.mark.parametrize("values", [{}, {"LIMIT": 10, "LEAF": 2}, {"MEMBERS": 8, "LIMIT": 1}, {"MEMBERS": 5, "TURNS": 1, "PIVOTS": 2}, {"MEMBERS": 6, "TURNS": 0}, {"MEMBERS": 8, "SPREAD": 100.0, "LEAF": 2}, {"WEIGHT": 300, "LIMIT": 1}])
def test_large_regions(spark, monkeypatch, values):
    """The links of a plain reading, also where regions count as too large for a task or lists as too long."""
    rows = near_copies(60, 60, (0, 3)) + [(100 + i, t) for i, t in near_copies(60, 60, (0, 9), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = plain_components([t for _, t in rows], 4, 85)
    for name, value in values.items():
        monkeypatch.setattr(ngram_join, name, value)
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.join(docs).collect()) == sorted((d, rows[x][0]) for (d, _), x in zip(rows, label, strict=True))


@pytest.mark.parametrize(("leaf", "spread"), [(48, 4.0), (2, 4.0), (2, 100.0)])
def test_voronoi_regions(monkeypatch, leaf, spread):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "SPREAD", spread)
    rng = np.random.default_rng(5)
    for turn in range(30):
        centres = [rng.choice(4000, rng.integers(5, 60), replace=False) for _ in range(5)]
        sets = []
        for _ in range(80):
            own = set(centres[rng.integers(5)].tolist())
            sets.append(np.array(sorted({x for x in own if rng.random() > 0.08} | set(rng.integers(0, 4000, rng.integers(0, 4)).tolist()) or {1}), np.uint64))
        label = list(range(80))
        for i in range(80):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    label = [label[j] if x == label[i] else x for x in label]
        found = list(range(80))
        for i, j in ngram_join.region_links(sets, np.ones(80, bool), np.arange(80), 80):
            found = [found[j] if x == found[i] else x for x in found]
        same = lambda ls: [[a == b for b in ls] for a in ls]
        assert same(found) == same(label), turn


def test_a_region_without_links(spark):
    """Thousands of members that share two thirds with each other and link with none: no pair of them becomes a row."""
    random.seed(8)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"o{random.randint(0, 10**6)}" for _ in range(30))) for i in range(5000)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5000 and all(r["component_id"] == r["doc_id"] for r in found)


def test_words_that_share_nothing(spark):
    rows = []
    for n, size in ((0, 1024), (2, 2048)):  # Thue-Morse words and their complements, which sums modulo 2**64 confuse
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        rows += [(n, word), (n + 1, word.translate(str.maketrans("ab", "ba")))]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["component_id"] for r in found) == [0, 1, 2, 3]


def test_dedup_keeps_characters(spark):
    passage = "é passage that stands twice " * 20
    rows = [(i, t, *CLASHES) for i, t in enumerate([f"first ü{passage}end", f"second é{passage}é", None, "", "short"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + CLASHING)
    out = suffix_dedup.dedup(docs, 200)
    assert out.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[2] is None and text[3] == "" and text[4] == "short" and "passage" not in text[0] and text[0].startswith("first ")


def test_columnwise_order_on_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", 3)
    monkeypatch.setattr(suffix_dedup, "BATCH", 4)
    random.seed(7)
    shared = "".join(random.choice("abc ") for _ in range(500))
    texts = ["".join(random.choice("abc ") for _ in range(random.randint(0, 300))) + shared[random.randint(0, 60) :] + str(i) * 30 for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, found = suffix_dedup.removed_spans(docs)
    got = {r["digest"]: r["n_removed"] for r in found.collect()}
    windows = [t[a : a + 400] for t in texts for a in range(len(t) - 399)]
    for t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 399):
            if windows.count(t[a : a + 400]) > 1:
                gone[a : a + 400] = True
        assert got.get(hashlib.sha256(t.encode()).hexdigest(), 0) == int(gone.sum())


def test_no_task_holds_a_group_over_the_bound(spark, monkeypatch):
    built = suffix_dedup._built

    def bounded(size):
        def run(batches):
            held = {}
            for rows in batches:
                for key in rows.column(0).to_pylist():
                    held[key] = held.get(key, 0) + 1
                    assert held[key] <= 3
                yield from build(iter([rows]))

        build = built(size)
        return run

    monkeypatch.setattr(suffix_dedup, "LARGE", 3)
    monkeypatch.setattr(suffix_dedup, "_built", bounded)
    random.seed(8)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = word(400)  # with other bytes before and after it in each text
    texts = [word(400 + i) + chr(65 + i) + passage + chr(65 + i) + word(300) for i in range(30)] + [word(900) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    _, found = suffix_dedup.removed_spans(docs)
    got = {r["digest"]: [tuple(x) for x in r["removed"]] for r in found.collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): [(401 + i, 801 + i)] for i, t in enumerate(texts[:30])}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=5))
def test_webp_round_trip(payloads):
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    files = [webp.encode(p, rows=8) for p in payloads]
    assert [media.samples_of(x) for x in webp.decode(files)] == payloads


class Stream(webp.Writer):
    """Hand-made VP8L streams."""

    def __init__(self, width, height):
        super().__init__()
        self.put(0x2F, 8), self.put(width - 1, 14), self.put(height - 1, 14), self.put(1, 1), self.put(0, 3)

    def flat(self, extra=0, distance=0):
        """Codes of 8 bits for each literal; with ``extra`` more green symbols a 9-bit code."""
        green = np.zeros(280 + extra, np.int64)
        if extra or distance:
            green[:] = webp.code_lengths(np.ones(280 + extra, np.int64), 15)
        else:
            green[:256] = 8
        webp._put_code(self, green)
        for _ in range(3):
            webp._put_code(self, np.full(256, 8))
        far = np.zeros(40, np.int64)
        far[distance] = 1
        webp._put_code(self, far)
        self.green = (webp.canonical(green).tolist(), green.tolist())
        self.byte = webp.canonical(np.full(256, 8)).tolist()
        return self

    def pixel(self, argb):
        a, r, g, b = argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255
        self.symbol(g)
        for v in (r, b, a):
            self.put(self.byte[v], 8)

    def symbol(self, s):
        self.put(self.green[0][s], self.green[1][s])

    def file(self):
        return b"RIFF\0\0\0\xffWEBP" + webp._chunk(b"VP8L", self.value.to_bytes(-(-self.at // 8), "little"))


def decoded(stream):
    return webp.decode([stream.file()])[0][0]


def pixels(n, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def test_colour_cache_and_back_references():
    own = pixels(4)
    s = Stream(4, 3)
    s.put(0, 1), s.put(1, 1), s.put(4, 4), s.put(0, 1)  # no transform, a cache of 4 bits, one group
    s.flat(extra=16, distance=0)
    for p in own.tolist():
        s.pixel(p)
    place = int(own[3]) * webp.CACHE_FACTOR % (1 << 32) >> 28
    s.symbol(280 + place)
    s.symbol(256 + 6), s.put(0, 2)  # a length of 9 to 12 at the near distance 1: the pixel above
    got = decoded_or_bad(s)
    assert got is None  # it would reach beyond the image
    s = Stream(4, 3)
    s.put(0, 1), s.put(1, 1), s.put(4, 4), s.put(0, 1)
    s.flat(extra=16, distance=0)
    for p in own.tolist():
        s.pixel(p)
    s.symbol(280 + place)
    s.symbol(256 + 4), s.put(0, 1)  # 5 pixels
    s.symbol(256 + 1)  # 2 pixels
    want = [*own, own[3]]
    for _ in range(7):
        want.append(want[-4])
    assert decoded(s).reshape(-1).tolist() == [int(x) for x in want]


def decoded_or_bad(s):
    try:
        return decoded(s)
    except webp.Bad:
        return None


def put_image(s, values, main):
    s.put(0, 1)
    if main:
        s.put(0, 1)
    s.flat()
    for p in np.asarray(values).reshape(-1).tolist():
        s.pixel(p)


def neighbours(out, y, x, w):
    return out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], out[y - 1, x + 1] if x + 1 < w else out[y, 0]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    w, h = 7, 5
    image = webp._channels(pixels(w * h, mode).reshape(h, w))
    rest = image.copy()
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = np.array([0, 0, 0, 255]) if x == 0 else image[0, x - 1]
            elif x == 0:
                guess = image[y - 1, 0]
            else:
                guess = webp.predicted(mode, *neighbours(image, y, x, w))
            rest[y, x] = image[y, x] - guess & 255
    s = Stream(w, h)
    s.put(1, 1), s.put(webp.PREDICTOR, 2), s.put(0, 3)
    put_image(s, np.full((2, 2), mode << 8), False)
    s.put(0, 1)
    put_image(s, webp._pixels(rest), True)
    assert (decoded(s) == webp._pixels(image)).all()


def test_cross_colour_and_subtract_green():
    w, h = 6, 3
    image = webp._channels(pixels(w * h, 9).reshape(h, w))
    signed = lambda v: (int(v) & 255 ^ 128) - 128
    to_red, to_blue, red_blue = 37, 200, 91
    rest = image.copy()
    for y in range(h):
        for x in range(w):
            b, g, r, _ = image[y, x]
            rest[y, x, 2] = r - (signed(to_red) * signed(g) >> 5) & 255
            rest[y, x, 0] = b - (signed(to_blue) * signed(g) >> 5) - (signed(red_blue) * signed(r) >> 5) & 255
    rest[..., 0] = rest[..., 0] - rest[..., 1] & 255
    rest[..., 2] = rest[..., 2] - rest[..., 1] & 255
    s = Stream(w, h)
    s.put(1, 1), s.put(webp.CROSS_COLOUR, 2), s.put(0, 3)
    put_image(s, np.full((1, 2), 255 << 24 | red_blue << 16 | to_blue << 8 | to_red), False)
    s.put(1, 1), s.put(webp.SUBTRACT_GREEN, 2), s.put(0, 1)
    put_image(s, webp._pixels(rest), True)
    assert (decoded(s) == webp._pixels(image)).all()


@pytest.mark.parametrize("colours", [2, 3, 9, 40])
def test_palette(colours):
    w, h = 11, 4
    palette = pixels(colours, colours)
    index = np.random.default_rng(1).integers(0, colours, (h, w))
    bits = webp.bundle_bits(colours)
    packed = np.zeros((h, -(-w // (1 << bits))), np.uint32)
    for y in range(h):
        for x in range(w):
            packed[y, x >> bits] |= int(index[y, x]) << 8 + (x & (1 << bits) - 1) * (8 >> bits)
    c = webp._channels(palette)
    s = Stream(w, h)
    s.put(1, 1), s.put(webp.PALETTE, 2), s.put(colours - 1, 8)
    put_image(s, webp._pixels(np.diff(c, axis=0, prepend=0)), False)
    s.put(0, 1)
    put_image(s, packed, True)
    assert (decoded(s) == palette[index]).all()


def test_several_groups_of_codes():
    w, h = 8, 8
    image = pixels(w * h, 3).reshape(h, w)
    s = Stream(w, h)
    s.put(0, 1), s.put(0, 1), s.put(1, 1), s.put(0, 3)  # no transform, no cache, blocks of 4
    groups = np.array([[0, 1], [1, 0]]) << 8
    put_image(s, groups, False)
    s.flat()
    s.flat()
    for p in image.reshape(-1).tolist():
        s.pixel(p)
    assert (decoded(s) == image).all()


@pytest.mark.parametrize("bad", [b"", b"RIFF....WEBP", b"RIFF\xff\0\0\0WEBPVP8L\x04\0\0\0abcd", webp.encode(bytes(range(64)) * 40)[:-300]])
def test_damaged_files(bad):
    with pytest.raises((webp.Bad, IndexError)):
        webp.decode([bad])


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
        assert docs.columns == columns and 0.7 * before < docs.count() <= before
        before = docs.count()
    assert docs.where("text like '%@mail%.example.com%'").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.parametrize("toxic", [[1] * 8, [0] * 8, [1] + [0] * 7])
def test_no_evidence_keeps_documents(spark, documents, toxic):
    """Labels of one class, or too few for calibration: harmless documents stay, and columns of any name."""
    clash = "_score double, score double, score_ double, _difference double, _was string, was string, difference int, fold int"
    folder = documents([(*r, 0.7, 0.6, 0.5, 0.4, "w", "x", 3, 4) for r in HARD], clash)
    spark.createDataFrame([(i, t) for i, t in enumerate(toxic, 4)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.toxicity(spark, docs, folder)
    kept = out.collect()
    assert out.columns == docs.columns
    assert all("one" in (r[1] or "") for r in map(tuple, HARD) if r not in [tuple(k)[:2] for k in kept])  # the word of the only toxic row
    assert {tuple(r)[2:] for r in out.collect()} == {(0.7, 0.6, 0.5, 0.4, "w", "x", 3, 4)}


def test_broadcast_and_table_models_agree(spark, monkeypatch):
    random.seed(12)
    rows = [(i, " ".join(random.choices(["a", "b", "c", "zounds" if i % 3 == 0 else "d", "é"], k=random.randint(0, 30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(250)], "doc_id long, toxic int")
    one = {r["doc_id"]: r["_score"] for r in toxicity.scored(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST", 0)
    two = {r["doc_id"]: r["_score"] for r in toxicity.scored(docs, labels).collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-6 for i in one)


def test_tables_in_many_parts_agree(spark, monkeypatch):
    """Packed parts that texts read, parts that texts are moved to, and a broadcast model give the same scores."""
    random.seed(14)
    rows = [(i, " ".join(random.choices([*"abcdefgh", "zounds" if i % 3 == 0 else "i", "é"], k=random.randint(0, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, toxic int")
    scores = lambda: {r["doc_id"]: r["_score"] for r in toxicity.scored(docs, labels).collect()}
    found = [scores()]
    for name, value in (("BROADCAST", 0), ("MARKED", 0), ("COUNTED", 500), ("PART", 4), ("AT_ONCE", 200), ("HELD", 300), ("PORTION", 50)):
        monkeypatch.setattr(toxicity, name, value)
    found.append(scores())
    monkeypatch.setattr(toxicity, "_files", lambda df: None)
    found.append(scores())
    assert all(found[0].keys() == x.keys() and all(abs(found[0][i] - x[i]) < 1e-6 for i in x) for x in found[1:])


@pytest.mark.parametrize("portion", [1 << 19, 5])
def test_toxicity_equals_a_plain_model(spark, monkeypatch, portion):
    """The counts, discounts, continuation counts, backoff and weights of the module, in plain Python."""
    random.seed(13)
    texts = [" ".join(random.choices("abcdefg", [7, 6, 5, 4, 3, 2, 1 + 4 * (i % 3 == 0)], k=random.randint(1, 12))) for i in range(90)] + ["a h b", "", "z"]
    toxic = [int(i % 3 == 0) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)], "doc_id long, toxic int, fold int"))
    words_, pairs_ = model.arrays()
    monkeypatch.setattr(toxicity, "PORTION", portion)
    found = dict(enumerate(toxicity.differences_of(texts, toxicity.Hashes(), words_, pairs_, model.by)))
    from collections import Counter

    pairs = ({}, {})
    n, d = [Counter(), Counter()], [Counter(), Counter()]
    wd = [Counter(), Counter()]
    for t, c in zip(texts, toxic, strict=False):
        ws = ["<s>", *t.split()]
        n[c].update(zip(ws, ws[1:], strict=False))
        d[c].update(set(zip(ws, ws[1:], strict=False)))
        wd[c].update(set(ws[1:]))
    del pairs
    many = [len([x for x in toxic if x == c]) for c in (0, 1)]
    cont = [Counter(w for _, w in n[c]) for c in (0, 1)]
    by = [toxicity._discounts(*(sum(v == i for v in n[c].values()) for i in range(1, 5))) for c in (0, 1)]
    word_by = [toxicity._discounts(*(sum(v == i for v in cont[c].values()) for i in range(1, 5))) for c in (0, 1)]
    shared = Counter(w for t in texts for w in t.split())
    everything = sum(shared.values())

    def weight(k1, k0):
        share, m = many[1] / sum(many), k1 + k0
        cells = ((k1, m * share), (k0, m * (1 - share)), (many[1] - k1, (sum(many) - m) * share), (many[0] - k0, (sum(many) - m) * (1 - share)))
        e = max(0.0, 2 * sum(k * np.log(k / x) for k, x in cells if k > 0))
        return e * e / (e * e + toxicity.SOFT**2)

    def word(w, c):
        if w not in cont[0] and w not in cont[1]:
            return 1.0
        total, k, base = sum(cont[c].values()), cont[c][w], shared[w] / everything
        rest = min(1.0, sum(word_by[c][min(v, 3)] for v in cont[c].values()) / total)
        g = weight(wd[1][w], wd[0][w])
        return g * ((k - word_by[c][min(k, 3)]) / total + rest * base) + (1 - g) * base

    for i, t in enumerate(texts):
        ws, out = ["<s>", *t.split()], 0.0
        for v, w in zip(ws, ws[1:], strict=False):
            alone = np.log(word(w, 1)) - np.log(word(w, 0))
            full = []
            for c in (1, 0):
                after = {p: k for p, k in n[c].items() if p[0] == v}
                t_ = max(1, sum(after.values()))
                b = sum(by[c][min(k, 3)] for k in after.values()) / t_ if after else 1.0
                k = n[c][v, w]
                full.append(np.log(max(0.0, k - by[c][min(k, 3)]) / t_ + b * word(w, c)))
            g = weight(d[1][v, w], d[0][v, w]) if n[0][v, w] + n[1][v, w] else 0.0
            out += alone + g * (full[0] - full[1] - alone)
        assert abs(found[i] - out / max(1, len(ws) - 1)) < 1e-5, t


@pytest.mark.parametrize("spread", [0.001, 0.5, 1e18])
def test_topk_in_blocks(spark, spread):
    """Small parts and few pivots, on clusters that bounds can leave out, on noise, and on sums beyond exact doubles."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(12, size=400)] + spread * rng.normal(size=(400, 6))
    x[100:140] = x[100]
    docs = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(docs, 5, 10, part=16, pivots=12).collect()}
    whole = [[int(v) for v in np.floor(256 * row)] for row in x]
    most = 2**63 - 1
    for q in range(0, 400, 10):
        scores = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(whole[q], w, strict=True)))), i) for i, w in enumerate(whole) if i != q)[:5]
        if spread < 1e18:
            assert [found[q, n] for n in range(1, 6)] == [(i, -s) for s, i in scores]
        else:
            assert [found[q, n][1] for n in range(1, 6)] == [-s for s, _ in scores]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"é{i}@x{i}.org" + " " * (i % 3) for i in range(1000))
    found = pii.with_base(spark.createDataFrame([(1, text), (2, text[:500]), (3, "")], "doc_id long, text string")).select("doc_id", "email").collect()
    import re

    for r in found:
        own = {1: text, 2: text[:500], 3: ""}[r["doc_id"]]
        assert [(x["s"], x["e"], x["m"]) for x in r["email"]] == [(*m.span(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", own)]


def test_added_spans_on_planted_rows(spark):
    """Personal data that no base rule finds, among numbers of other kinds."""
    random.seed(14)
    number = lambda: f"{random.randint(200, 999)}-{random.randint(200, 999)}-{random.randint(1000, 9999)}"
    planted = ["Frau Schäfer kam.", "Señor Ibáñez llama.", "Madame Éloise Dupont part."] + [f"Please call {number()} today." for _ in range(20)] + [f"Telefon: {number()}." for _ in range(20)] + [f"teléfono {number()}" for _ in range(10)]
    decoys = [f"see page {random.randint(10**7, 10**8)}" for _ in range(20)] + [f"casino {random.randint(10**9, 10**10)} mm" for _ in range(5)] + [f"version {random.randint(10**7, 10**8)}.1" for _ in range(20)] + [f"invoice {random.randint(10**16, 10**17)}" for _ in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(planted + decoys)], "doc_id long, text string")
    found = {r["doc_id"]: len(r["added"]) for r in pii.find(docs).select("doc_id", "added").collect()}
    assert sum(found[i] > 0 for i in range(len(planted))) >= 0.9 * len(planted)
    assert sum(found[i] > 0 for i in range(len(planted), len(found))) <= 0.1 * len(decoys)


def test_ledger_written_by_two_runs(spark, documents):
    folder = documents([(1, "password=abcdef"), (2, "password=abcdef"), (3, "clean")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ledger = f"{shared_dir(spark)}/test-{random.random()}"
    secret_scan.scan(docs, ledger).collect()
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-copy")
    spark.read.parquet(f"{ledger}-copy").write.mode("append").parquet(ledger)  # as if another run had scanned the same blobs
    assert sorted((r["doc_id"], len(r["findings"])) for r in secret_scan.scan(docs, ledger).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_a_row_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 7 + [(i, "c") for i in range(3, 40)], "doc_id long, text string")
    slots = {}
    for r in sharding.shards(docs).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == 94 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_equal_a_plain_tree(spark):
    """Each row's shard by the draws of the tree, in plain Python."""
    docs = spark.createDataFrame([(i, "x") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    rows = docs.select(sharding.F.coalesce(sharding.F.col("doc_id").cast("string"), sharding.F.lit("null")).alias("key"))
    placed = sharding.with_shard(rows, sharding.F.col("key"), sharding.tree(17), "shard").collect()

    def least(key, children):
        draw = lambda c: -np.log((int(hashlib.md5(f"{key}/{c[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / c[1]
        return min(children, key=draw)

    for r in placed:
        region = least(r["key"], [(f"region{x[0][0][0]}", sum(w for k in x for _, w in k), x) for x in sharding.tree(17)])[2]
        rack = least(r["key"], [(f"rack{k[0][0]}", sum(w for _, w in k), k) for k in region])[2]
        assert r["shard"] == least(r["key"], [(f"shard{s}", w, s) for s, w in rack])[2]


def test_stored_forms_take_palette_and_cache():
    """Frames whose stream is shorter with a palette or a colour cache use it, and all read back as they were."""
    random.seed(15)
    words = ["".join(random.choices("abcdefgh", k=4)) for _ in range(60)]
    texts = {"palette": b"word " * 4000, "palette of two": b"aaaabbbb" * 999, "cache": "".join(random.choices(words, k=4000)).encode(), "plain": bytes(random.choices(range(256), k=64 * 64)), "zero": b""}
    bits = {}
    for name, raw in texts.items():
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        file = webp.encode(payload)
        assert media.samples_of(webp.decode([file])[0]) == payload, name
        first = webp.frames_of(file)[0]
        word = int.from_bytes(first[:16], "little") >> 40
        bits[name] = "palette" if word & 7 == 7 else "cache" if not word & 1 and word & 2 else "plain"
    assert bits == {"palette": "palette", "palette of two": "palette", "cache": "cache", "plain": "plain", "zero": bits["zero"]}
