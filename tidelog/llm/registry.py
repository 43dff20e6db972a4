"""The queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, langid, media, mixing, neardup, pii, quality, shard, tokencount, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_token_counts": tokencount.op2_token_counts,
        "op3_near_duplicates": neardup.op3_near_duplicates,
        "op4_mixing": mixing.op4_mixing,
        "op5_shards": shard.op5_shards,
        "op6_pii": pii.op6_pii,
        "op7_topk": topk.op7_topk,
        "op8_bpe": bpe.op8_bpe,
        "op9_language": langid.op9_language,
        "op10_media": media.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": neardup.OP3_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op5_shards": shard.OP5_SQL,
        "op7_topk": topk.OP7_SQL,
    }
