"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import chat, linededup, mixing, packing, pivots, quality, sharding, simhash, tokencount, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivots": pivots.op1_pivots,
    "op2_topk": topk.op2_topk,
    "op3_tokens": tokencount.op3_tokens,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_lines": linededup.op9_lines,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_pivots": pivots.OP1_SQL,
    "op2_topk": topk.OP2_SQL,
    "op5_chat": chat.OP5_SQL,
}
