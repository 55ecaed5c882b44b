"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, html_extract, license_scan, ngram_join, quality_crf, quality_rules, sharding, token_output, url_filter

QUERIES = {
    "op1_ngram_jaccard": ngram_join.query,
    "op2_token_output": token_output.query,
    "op3_quality_crf": quality_crf.query,
    "op4_bpe": bpe.query,
    "op5_decontamination": decontaminate.query,
    "op6_license_scan": license_scan.query,
    "op7_quality_rules": quality_rules.query,
    "op8_sharding": sharding.query,
    "op9_html_extraction": html_extract.query,
    "op10_url_filter": url_filter.query,
}

ORACLES = {
    "op1_ngram_jaccard": ngram_join.ORACLE_SQL,
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_license_scan": license_scan.oracle_sql(),
    "op9_html_extraction": html_extract.ORACLE_SQL,
    "op10_url_filter": url_filter.oracle_sql(),
}
