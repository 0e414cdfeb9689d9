"""The queries of the training-data operators, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshlark.llm import bpe, filter_audit, html_extract, license_scan, maxent, mtree, ngram_join, packing, quality_rules, resample, secret_scan, token_store, warc
from meshlark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": lambda s, d: ngram_join.op1_jaccard(s, table(s, d, "documents")),
    "op2_packing": lambda s, d: packing.op2_packing(s, table(s, d, "documents")),
    "op3_token_store": lambda s, d: token_store.op3_tokens(s, table(s, d, "documents")),
    "op4_html": lambda s, d: html_extract.op4_html(s, table(s, d, "pages")),
    "op5_topk_mtree": lambda s, d: mtree.op5_topk(s, table(s, d, "embeddings")),
    "op6_warc": lambda s, d: warc.op6_warc(s, table(s, d, "pages")),
    "op7_quality": lambda s, d: quality_rules.op7_quality(s, table(s, d, "documents"), table(s, d, "labels")),
    "op8_license": lambda s, d: license_scan.op8_license(s, table(s, d, "documents")),
    "op9_secrets": lambda s, d: secret_scan.op9_secrets(s, table(s, d, "documents")),
    "op10_bpe": lambda s, d: bpe.op10_bpe(s, table(s, d, "documents")),
    "op11_audit": lambda s, d: filter_audit.op11_audit(s, table(s, d, "documents"), table(s, d, "labels")),
    "op12_resample": lambda s, d: resample.op12_resample(s, table(s, d, "documents"), table(s, d, "benchmark")),
    "op13_lm": lambda s, d: maxent.op13_lm(s, table(s, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard": ngram_join.ORACLE_SQL,
    "op5_topk_mtree": mtree.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op8_license": license_scan.oracle_sql(),
    "op11_audit": filter_audit.ORACLE_SQL,
    "op12_resample": resample.ORACLE_SQL,
}
