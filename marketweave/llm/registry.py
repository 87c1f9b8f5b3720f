"""Queries and SQL of the training-data operators, as the entry point adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketweave.llm import balltree, classlm, decontaminate, licenses, quality, sharding, simhash, sp_encode, tokencount, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.query,
    "op2_simhash": simhash.query,
    "op3_class_lm": classlm.query,
    "op4_licenses": licenses.query,
    "op5_topk": balltree.query,
    "op6_token_counts": tokencount.query,
    "op7_decontamination": decontaminate.query,
    "op8_sentencepiece": sp_encode.query,
    "op9_quality": quality.query,
    "op10_warc": warc.query,
}

SQL: dict[str, str] = {
    "op1_sharding": sharding.SQL,
    "op5_topk": balltree.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op10_warc": warc.SQL,
}
