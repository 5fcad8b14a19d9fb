"""The stages of the pipeline, each on its own input, against plain readings; on hard rows, clashing names and empty tables."""

import re
import zlib
from collections import Counter

import pytest
from hard_rows import CLASHES, CLASHING, HARD
from pyspark.sql import functions as F
from test_contracts import groups, personal, shingle_sets

import corpus_pipeline
from lodestrata.llm import pii
from lodestrata.llm.common import cut

STAGES = dict(corpus_pipeline.STAGES)
#: Names that the operators use inside, as columns of the documents.
INNER = "_score double, _was string, _row string, _spans string, _clean string, hit string, alone string, chosen string, best string, removed string, score double, region long, email string, candidates string, lang string, n_chars int"
INSIDE = (0.5, "a", "b", "c", "d", "e", "f", "g", "h", "i", 0.7, 5, "j", "k", "en", 3)


@pytest.fixture(params=["hard", "data"])
def input_(request, spark, sf, documents):
    if request.param == "data":
        return spark.read.parquet(f"{sf}/documents.parquet"), sf
    folder = documents([(*r, *CLASHES, *INSIDE) for r in HARD], f"{CLASHING}, {INNER}")
    spark.createDataFrame([(5, 0), (6, 0), (4, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def others(columns):
    """The row without its text and number of characters."""
    keep = [i for i, c in enumerate(columns) if c not in ("text", "n_chars")]
    return lambda r: tuple(r[i] for i in keep)


def test_toxicity(spark, input_):
    docs, folder = input_
    out = STAGES["toxicity"](spark, docs, folder)
    assert out.columns == docs.columns
    kept, before = Counter(rows_of(out)), Counter(rows_of(docs))
    assert not kept - before and sum(kept.values()) >= 0.85 * sum(before.values())
    if "lang" in docs.columns and docs.count() > len(HARD):
        labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
        left = {r[0] for r in kept}
        clean = [d for d, t in labels.items() if not t]
        assert sum(d in left for d in clean) >= 0.95 * len(clean)


def test_near_duplicates(spark, input_):
    docs, folder = input_
    out = STAGES["near duplicates"](spark, docs, folder)
    assert out.columns == docs.columns
    rows = rows_of(docs)
    own = [(r[0], r[1] or "") for r in rows]
    sets = shingle_sets(own, corpus_pipeline.WORDS)
    root = groups(own, sets, corpus_pipeline.PERCENT)
    least = {}
    for i, (d, _) in enumerate(own):
        if sets[i]:
            least[root[i]] = min(least.get(root[i], 1 << 60), 1 << 60 if d is None else d)
    left = rows_of(out)
    assert not Counter(left) - Counter(rows)
    want = Counter(least.values()) + Counter((1 << 60 if d is None else d) for i, (d, _) in enumerate(own) if not sets[i])
    assert Counter(1 << 60 if r[0] is None else r[0] for r in left) == want


def test_repeated_passages(spark, input_):
    docs, folder = input_
    out = STAGES["repeated passages"](spark, docs, folder)
    assert out.columns == docs.columns
    size, rows, seen = corpus_pipeline.PASSAGE, rows_of(docs), Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        seen.update(raw[i : i + size] for i in range(len(raw) - size + 1))
    want, bare = [], others(docs.columns)
    for r in rows:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        text, at = "", 0
        for c in r[1] or "":
            n = len(c.encode())
            text += "" if any(gone[at : at + n]) else c
            at += n
        want.append((bare(r), None if r[1] is None else text))
    assert Counter((bare(r), r[1]) for r in rows_of(out)) == Counter(want)
    assert out.where("n_chars <> length(text)").count() == 0


def test_personal_data(spark, input_):
    docs, folder = input_
    out = STAGES["personal data"](spark, docs, folder)
    assert out.columns == docs.columns
    bare, place = others(docs.columns), docs.columns.index("text")
    model = pii.train(docs.select("text"))
    added = {}
    for r in pii.find(docs.select("text"), model).select("text", "added").collect():
        added[r["text"] or ""] = [(x["s"], x["e"], pii.ADDED[x["kind"]]) for x in r["added"]]
    want = []
    for r in rows_of(docs):
        text = r[place]
        if text is not None:
            spans = sorted([(s, e, k) for k, s, e in personal(text)] + added[text])
            clean, at = "", 0
            for s, e, k in sorted(spans, key=lambda x: (x[0], x[1], x[2].upper())):
                if s >= at:
                    clean += text[at:s] + f"[{k.upper()}]"
                at = max(at, e)
            text = clean + text[at:]
        want.append((bare(r), text))
    assert Counter((bare(r), r[place]) for r in rows_of(out)) == Counter(want)


def test_packing(spark, input_):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, folder = input_
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = STAGES["packing"](spark, docs, folder).collect()
    sums = Counter()
    for r in found:
        sums[r["doc_id"]] += r["length"]
    want = Counter()
    for r in rows_of(docs):
        want[r[0]] += len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert sums == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_the_whole_pipeline_on_hard_rows(spark, input_):
    docs, folder = input_
    if docs.count() != len(HARD):
        pytest.skip("the stages above run on the data")
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in found} >= {1, 2, 3, 8, 9, 10}


def test_empty_tables(spark, documents):
    folder = documents([], f"{CLASHING}, {INNER}")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, folder))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_one_stage_after_the_other_takes_effect(spark, documents):
    """A toxic document, a near copy, a repeated passage and an address are gone from what is packed."""
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = [(i, plain(i)) for i in range(40)] + [(50, plain(0) + " tail"), (51, f"{plain(51)} {passage}"), (52, f"{passage} {plain(52)}"), (53, f"{plain(53)} jo@example.org")]
    folder = documents([(*r, len(r[1])) for r in rows], "n_chars int")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 50 not in text and 0 in text and "shared5" not in text[51] + text[52] and "[EMAIL]" in text[53]
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0 and zlib.crc32(b"") == 0 and re.search("w51x59", text[51])
