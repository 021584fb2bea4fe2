"""Queries of this package and their SQL, which the entry module adds to the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import cells, chat, licenses, mixing, near_dup, packing, pii, quality, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_chat_examples": chat.op2_chat_examples,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op5_line_quality": quality.op5_line_quality,
    "op6_personal_data": pii.op6_personal_data,
    "op7_toxic_documents": toxicity.op7_toxic_documents,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_nearest_neighbours": cells.op9_nearest_neighbours,
    "op10_mix_sources": mixing.op10_mix_sources,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op2_chat_examples": chat.ORACLE,
    "op10_mix_sources": mixing.select_sql("documents"),
}
