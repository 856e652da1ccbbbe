"""The registered query of each operator: its digest over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linecdc.llm import (
    byte_bpe,
    chosen_path,
    curve_search,
    fit_packing,
    html_main,
    language_id,
    merkle,
    secret_scan,
    shard_tree,
    soft_mixing,
    spelling,
    toxicity,
    vector_codes,
)
from linecdc.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": lambda s, d: secret_scan.op1_query(table(s, d, "documents")),
    "op2_merkle_fingerprint": lambda s, d: merkle.op2_query(table(s, d, "documents")),
    "op3_toxicity": lambda s, d: toxicity.op3_query(table(s, d, "documents"), table(s, d, "labels")),
    "op4_html_main": lambda s, d: html_main.op4_query(table(s, d, "pages")),
    "op5_chosen_path_join": lambda s, d: chosen_path.op5_query(table(s, d, "documents")),
    "op6_shard_tree": lambda s, d: shard_tree.op6_query(table(s, d, "documents")),
    "op7_soft_mixing": lambda s, d: soft_mixing.op7_query(table(s, d, "documents"), table(s, d, "labels")),
    "op8_curve_search": lambda s, d: curve_search.op8_query(table(s, d, "embeddings")),
    "op9_language_id": lambda s, d: language_id.op9_query(table(s, d, "documents")),
    "op10_byte_bpe": lambda s, d: byte_bpe.op10_query(table(s, d, "documents")),
    "op11_spelling_groups": lambda s, d: spelling.op11_query(table(s, d, "documents")),
    "op12_vector_codes": lambda s, d: vector_codes.op12_query(table(s, d, "embeddings")),
    "op13_fit_packing": lambda s, d: fit_packing.op13_query(table(s, d, "documents")),
}

# The others are no SQL: they are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_secret_scan": secret_scan.OP1_SQL,
    "op2_merkle_fingerprint": merkle.OP2_SQL,
    "op6_shard_tree": shard_tree.OP6_SQL,
    "op11_spelling_groups": spelling.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
