"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, jaccard, media, oracles, packing, pii, quality, sharding, token_files, url_filter
from .shared import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_redirect_equivalence": url_filter.op1_redirect_equivalence,
        "op2_zstd_dictionary": token_files.op2_zstd_dictionary,
        "op3_netpbm_tiles": media.op3_netpbm_tiles,
        "op4_offset_deobfuscation": pii.op4_offset_deobfuscation,
        "op5_weak_labels": quality.op5_weak_labels,
        "op6_jaccard_regions": jaccard.op6_jaccard_regions,
        "op7_rotated_codes": embedding_dedup.op7_rotated_codes,
        "op8_sampled_splitters": sharding.op8_sampled_splitters,
        "op9_backtracking_bpe": bpe.op9_backtracking_bpe,
        "op10_large_item_matching": packing.op10_large_item_matching,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
