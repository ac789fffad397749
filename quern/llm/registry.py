"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import bpe, embedding_dedup, mixing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_warc": warc.op10_warc,
}

SQL = {
    "op3_embedding_dedup": embedding_dedup.SQL,
    "op9_url_filter": url_filter.SQL,
    "op10_warc": warc.SQL,
}
