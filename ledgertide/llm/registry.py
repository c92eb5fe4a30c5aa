"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgertide.llm import decontaminate, divergence, host_rules, licenses, line_dedup, mixing, ngram_jaccard, phrases, quality_model, repeats, token_output, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_model.op1_quality_classifier,
        "op2_ngram_jaccard_join": ngram_jaccard.op2_ngram_jaccard_join,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_quality_rules": host_rules.op5_quality_rules,
        "op6_token_output": token_output.op6_token_output,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_mixing": mixing.op8_mixing,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_suffix_dedup": repeats.op10_suffix_dedup,
        "op11_phrase_collocations": phrases.op11_phrase_collocations,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_jaccard.OP2_SQL,
        "op5_quality_rules": host_rules.OP5_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_phrase_collocations": phrases.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
