"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import embedding_dedup, exact_dedup, fill_middle, html_text, language_id, line_dedup, mixing, packing, prefix_trie, secret_scan, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_secrets": secret_scan.op5_secrets,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
SQL: dict[str, str] = {k: v for m in (exact_dedup, embedding_dedup, mixing, prefix_trie, fill_middle, line_dedup) for k, v in m.SQL.items()}
