"""Queries of the text operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import _util as U
from . import decontaminate, language_cnn, maxent, packing, prefix_trie, quality, shingle_join, simhash, span_hash, substring_dedup, token_files, toxicity

_QUERIES = {
    "op1_maxent_score": maxent.op1_maxent_score,
    "op2_quality": quality.op2_quality,
    "op3_span_fingerprints": span_hash.op3_span_fingerprints,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_shingle_join": shingle_join.op5_shingle_join,
    "op6_length_buckets": packing.op6_length_buckets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_files": token_files.op9_token_files,
    "op10_language": language_cnn.op10_language,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_simhash": simhash.op12_simhash,
}

#: Each leaves one table, its result.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: U.finished(query) for name, query in _QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_shingle_join": shingle_join.OP5_SQL,
    "op6_length_buckets": packing.oracle(),
    "op11_prefix_trie": prefix_trie.OP11_SQL,
}
