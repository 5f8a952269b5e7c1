"""The registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from notegrove.llm import chat_format, compression_rules, decontaminate, ngram_lm, packing, quality_model, simhash_dedup, token_counts, token_orc, url_rules
from notegrove.llm._shared import table

QUERIES = {
    "op1_simhash_dedup": lambda spark, sf: simhash_dedup.near_duplicate_groups(table(spark, sf, "documents")),
    "op2_chat_format": lambda spark, sf: chat_format.format_conversations(table(spark, sf, "conversations")),
    "op3_token_counts": lambda spark, sf: token_counts.token_counts(table(spark, sf, "documents")),
    "token_counts_warm_cache": lambda spark, sf: token_counts.warm_counts(table(spark, sf, "documents")),
    "op4_packing": lambda spark, sf: packing.pack(table(spark, sf, "documents")),
    "op5_decontaminate": lambda spark, sf: decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op6_quality_classifier": lambda spark, sf: quality_model.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op7_compression_rules": lambda spark, sf: compression_rules.compression_report(table(spark, sf, "documents")),
    "op8_url_rules": lambda spark, sf: url_rules.filter_urls(table(spark, sf, "pages"), table(spark, sf, "labels")),
    "op9_lm_scores": lambda spark, sf: ngram_lm.lm_scores(table(spark, sf, "documents")),
    "op10_token_orc": lambda spark, sf: token_orc.tokens_through_orc(table(spark, sf, "documents")),
}

ORACLES: dict[str, str] = {}
