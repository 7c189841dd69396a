"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontamination, jaccard_join, language, lexical_packing, line_templates, markov, mixing, page_text, periodic_runs, quality, sharding, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm_scoring": markov.op1_hmm_scoring,
        "op2_language_id": language.op2_language_id,
        "op3_page_text": page_text.op3_page_text,
        "op4_exact_topk": topk.op4_exact_topk,
        "op5_quality": quality.op5_quality,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
        "op8_sharding": sharding.op8_sharding,
        "op9_line_dedup": line_templates.op9_line_dedup,
        "op10_mixing": mixing.op10_mixing,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_packing": lexical_packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": topk.SQL, "op6_decontamination": decontamination.SQL, "op7_ngram_jaccard": jaccard_join.SQL, "op8_sharding": sharding.SQL, "op9_line_dedup": line_templates.SQL, "op10_mixing": mixing.SQL}
