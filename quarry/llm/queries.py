"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, langid, licenses, mixing, ngram_join, phrases, pii, quality, ranked, sharding, tokens, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": html_text.query,
        "op2_token_counts": tokens.query,
        "op3_source_mixing": mixing.query,
        "op4_decontamination": decontam.query,
        "op7_url_filters": urls.query,
        "op5_quality_rules": quality.query,
        "op6_pii_surrogates": pii.query,
        "op8_language_id": langid.query,
        "op9_sharding": sharding.query,
        "op10_ngram_jaccard_join": ngram_join.query,
        "op11_phrase_collocations": phrases.query,
        "op12_ranked_search": ranked.query,
        "op13_license_scan": licenses.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontam.SQL,
        "op7_url_filters": urls.SQL,
        "op10_ngram_jaccard_join": ngram_join.SQL,
        "op11_phrase_collocations": phrases.SQL,
        "op12_ranked_search": ranked.SQL,
        "op13_license_scan": licenses.SQL,
    }
