"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simspark.llm import minhash, neardup_vectors, topk
from simspark.llm.bpe import op9_byte_bpe
from simspark.llm.html import op2_html_extraction
from simspark.llm.language import op8_language_id
from simspark.llm.minhash import op10_minhash_near_dedup
from simspark.llm.neardup_vectors import op5_embedding_near_dedup
from simspark.llm.packing import op6_best_fit_packing
from simspark.llm.substring_dedup import op1_suffix_array_dedup
from simspark.llm.token_counts import op3_edit_token_counts
from simspark.llm.topk import op7_exact_topk
from simspark.llm.warc import op4_warc_bundles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_suffix_array_dedup, op2_html_extraction, op3_edit_token_counts, op4_warc_bundles, op5_embedding_near_dedup, op6_best_fit_packing, op7_exact_topk, op8_language_id, op9_byte_bpe, op10_minhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_near_dedup": neardup_vectors.ORACLE_SQL, "op7_exact_topk": topk.ORACLE_SQL, "op10_minhash_near_dedup": minhash.ORACLE_SQL}
