"""Data quality checks and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failures(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows (rule, failures): how many rows break each rule, in one pass. A null verdict breaks it."""
    counted = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counted.unpivot([], [F.col(f"`{n}`") for n in rules], "rule", "failures")


def not_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def repeated_keys(rows: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Row (rule, failures): keys that occur more than once."""
    return rows.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("failures")).select(F.lit(rule).alias("rule"), "failures")


def unknown_values(rows: DataFrame, known: DataFrame, column: str, rule: str) -> DataFrame:
    """Row (rule, failures): rows whose value is not in ``known``."""
    return rows.join(known.select(column).distinct(), column, "left_anti").agg(F.count(F.lit(1)).alias("failures")).select(F.lit(rule).alias("rule"), "failures")


def reconcile(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by, left_rows, right_rows, matches): counts of both sides, also where one has none."""
    a = left.groupBy(*by).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(*by).agg(F.count(F.lit(1)).alias("right_rows"))
    both = a.join(b, list(by), "full").fillna(0, ["left_rows", "right_rows"])
    return both.withColumn("matches", F.col("left_rows") == F.col("right_rows"))


def key_overlap(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row (in_both, left_only, right_only) of distinct keys."""
    a = left.select(*key).distinct().withColumn("_a", F.lit(1))
    b = right.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(key), "full")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"),
        F.count_if(F.col("_b").isNull()).alias("left_only"),
        F.count_if(F.col("_a").isNull()).alias("right_only"),
    )
