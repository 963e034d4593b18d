"""The queries of this folder: name -> function of (spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, balance, hamming, media, merkle, ordermin, packing, pii, quality, quotes, rans, simhash, substrings
from .common import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index_hashing": lambda s, d: hamming.report(tables(s, d, "embeddings")),
    "op2_prefix_suffix_trees": lambda s, d: substrings.report(tables(s, d, "documents")),
    "op3_rans_token_ids": lambda s, d: rans.report(tables(s, d, "documents")),
    "op4_lossless_webp": lambda s, d: media.report(tables(s, d, "documents")),
    "op5_hilbert_packing": lambda s, d: packing.report(tables(s, d, "documents")),
    "op6_quotation_linking": lambda s, d: quotes.threads(tables(s, d, "conversations")),
    "op7_entropy_balancing": lambda s, d: balance.report(tables(s, d, "documents")),
    "op8_simhash_tiles": lambda s, d: simhash.report(tables(s, d, "documents")),
    "op9_pii_spans": lambda s, d: pii.report(tables(s, d, "documents")),
    "op10_quality_weak_labels": lambda s, d: quality.report(tables(s, d, "documents")),
    "op11_merkle_manifest": lambda s, d: merkle.report(tables(s, d, "documents")),
    "op12_cross_tokenizer_alignment": lambda s, d: alignment.report(tables(s, d, "documents")),
    "op13_order_minhash": lambda s, d: ordermin.report(tables(s, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {"op1_multi_index_hashing": hamming.SQL, "op6_quotation_linking": quotes.SQL, "op11_merkle_manifest": merkle.SQL}
