"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

# in the order of their numbers: (query, module)
_QUERIES = [("op1_warc", "warc"), ("op2_nn_descent", "ann"), ("op3_url_filter", "urlfilter"),
            ("op4_decontaminate", "decontam"), ("op5_toxicity", "toxicity"), ("op6_substring_dedup", "substring"), ("op7_suffix_array_dedup", "suffix"), ("op8_ngram_jaccard_join", "jaccard"), ("op9_pack", "packing"), ("op10_line_dedup", "lines"), ("op11_resample", "resample"), ("op12_whiten", "whiten"),
            ("op13_exact_dedup", "exact")]


def queries() -> dict:
    import corpus_pipeline

    return {q: getattr(importlib.import_module(f"quarry.llm.{m}"), q) for q, m in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from quarry.llm.oracles import SQL

    import corpus_pipeline

    out = {q: s for q, s in SQL.items() if q in dict(_QUERIES)}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
