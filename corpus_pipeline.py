"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, table
from lodestrata.llm.ngram_join import one_of_each
from lodestrata.llm.packing import pack
from lodestrata.llm.pii import redact
from lodestrata.llm.suffix_dedup import dedup
from lodestrata.llm.toxicity import scored

#: Near duplicates: words of a shingle and percent of the union.
WORDS, PERCENT = 5, 80
#: Bytes of a passage that counts as repeated: under 50 words of any language here.
PASSAGE = 200


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with n_chars, where there is one, as the text is now."""
    if "n_chars" not in before.columns:
        return after
    return after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose class models score them below 0.5; all columns, under any name, as they were.

    Null and empty texts hold no evidence and stay, as do all documents where the labels hold one class only or too few
    rows to learn from. Texts are scored whole, however long; repeated rows each on its own; an empty table stays empty.
    """
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, table(spark, sf_dir, "labels"), name=name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least doc_id, of each group that links of 5-word shingles and 80 percent connect; all columns as they were.

    Null, empty and blank texts have no shingle and all stay; texts under five words are one shingle; repeated rows and
    equal texts are one group; a null doc_id stays only where its group has no other; an empty table stays empty.
    """
    return one_of_each(docs, WORDS, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes covered by a string of ``PASSAGE`` bytes that also starts anywhere else.

    A character that loses a byte goes as a whole, and n_chars, where there is such a column, is counted again. Null texts
    stay null; texts under that size stay as they are; of texts that are equal as a whole each loses all; the text of a very
    long document is judged whole; no row goes; an empty table stays empty.
    """
    return _counted(docs, dedup(docs, PASSAGE))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind, in brackets; n_chars is counted again.

    Null texts stay null, texts without a span as they are; spans that overlap go together; equal texts change alike; the
    model of added spans is learned from the distinct texts; no row goes; an empty table stays empty.
    """
    return _counted(docs, redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the closing id alone; long ones are cut, none is shortened; repeated rows are packed each on
    its own; other columns are left out; an empty table gives no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packing),
]

#: No SQL can express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
