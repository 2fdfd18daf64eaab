"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import (
    conversations,
    decontamination,
    line_dedup,
    minhash,
    mixing,
    quality,
    ranked_search,
    repair,
    substrings,
    token_counts,
    toxicity,
    url_filter,
    warc_zip,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_minhash": minhash.op2_minhash,
    "op3_substrings": substrings.op3_substrings,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_repair": repair.op6_repair,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc_zip": warc_zip.op10_warc_zip,
    "op11_conversations": conversations.op11_conversations,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

SQL: dict[str, str] = {
    **url_filter.SQL,
    **mixing.SQL,
    **warc_zip.SQL,
    **conversations.SQL,
    **line_dedup.SQL,
    **ranked_search.SQL,
}
