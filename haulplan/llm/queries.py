"""Registered queries of this subpackage, and SQL counterparts where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from haulplan.llm import (
    decontamination,
    exact_substrings,
    licenses,
    line_rules,
    mixing,
    near_passages,
    packing,
    periodic_runs,
    simhash,
    token_counts,
    toxicity,
    vector_search,
    whitening,
)

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_license_scan": licenses.query,
    "op3_toxicity": toxicity.query,
    "op4_exact_substrings": exact_substrings.query,
    "op5_source_mixing": mixing.query,
    "op6_vector_search": vector_search.query,
    "op7_line_rules": line_rules.query,
    "op8_near_passages": near_passages.query,
    "op9_token_counts": token_counts.query,
    "op10_simhash": simhash.query,
    "op11_embedding_whitening": whitening.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_benchmark_decontamination": decontamination.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_license_scan": licenses.ORACLE,
    "op13_benchmark_decontamination": decontamination.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op6_vector_search": vector_search.ORACLE,
}
