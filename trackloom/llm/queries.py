"""The corpus operators' queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from trackloom.llm import decontamination, embedding_dedup, jaccard_join, language_id, mixing, personal_data, quality, secret_scan, token_tables, url_filter

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_quality_classifier": quality.op2,
    "op3_url_filter": url_filter.op3,
    "op4_token_tables": token_tables.op4,
    "op5_secret_scan": secret_scan.op5,
    "op6_personal_data": personal_data.op6,
    "op7_language_id": language_id.op7,
    "op8_benchmark_decontamination": decontamination.op8,
    "op9_jaccard_join": jaccard_join.op9,
    "op10_embedding_dedup": embedding_dedup.op10,
}
ORACLE = {"op8_benchmark_decontamination": decontamination.OP8_SQL}
