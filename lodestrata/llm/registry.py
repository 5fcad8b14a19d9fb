"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import oracles
from lodestrata.llm.byte_bpe import op8_byte_bpe
from lodestrata.llm.media import op10_media
from lodestrata.llm.ngram_join import op3_ngram_join
from lodestrata.llm.packing import op1_packing
from lodestrata.llm.pii import op5_pii
from lodestrata.llm.secret_scan import op7_secret_scan
from lodestrata.llm.sharding import op4_sharding
from lodestrata.llm.suffix_dedup import op2_suffix_dedup
from lodestrata.llm.topk import OP9_SQL, op9_topk
from lodestrata.llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_sharding": op4_sharding,
        "op5_pii": op5_pii,
        "op6_toxicity": op6_toxicity,
        "op7_secret_scan": op7_secret_scan,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_topk": op9_topk,
        "op10_media": op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": OP9_SQL} | oracles.oracle_sql()
