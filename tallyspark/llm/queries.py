"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, flac, licences, mixing, simhash, substring_dedup, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        mixing.op1_mixing, substring_dedup.op2_suffix_array, embedding_dedup.op3_embeddings, licences.op4_licences, toxicity.op5_toxicity,
        simhash.op6_simhash, bpe.op7_bpe, flac.op8_flac, substring_dedup.op9_recompression, url_rules.op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL, "op2_suffix_array": substring_dedup.OP2_SQL, "op3_embeddings": embedding_dedup.OP3_SQL,
        "op9_recompression": substring_dedup.OP9_SQL, "op10_url_filter": url_rules.OP10_SQL}
