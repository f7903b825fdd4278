"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontaminate, language_id, line_windows, ngram_join, packing, passages, pii, quality_gam, quality_rules, token_store, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_store": token_store.op3_token_store,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality_gam": quality_gam.op6_quality_gam,
    "op7_line_window_dedup": line_windows.op7_line_window_dedup,
    "op7_passage_dedup": passages.op7_passage_dedup,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op7_line_window_dedup": line_windows.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
}
