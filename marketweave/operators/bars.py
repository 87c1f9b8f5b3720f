"""Bars from ticks and roll-ups of bars; one aggregation each, combined map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ohlcv(price: str, volume: Column, order: Column) -> list[Column]:
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.alias("volume")]


def bars(ticks: DataFrame, by: Sequence[str], price: str, volume: Column, order: Sequence[str]) -> DataFrame:
    """First, highest, lowest and last price and the volume of each group; ``order`` must be unique in it."""
    return ticks.groupBy(*by).agg(*ohlcv(price, volume, F.struct(*order)))


def minute_bars(ticks: DataFrame, price: str = "price", at: str = "ts") -> DataFrame:
    """Rows (ticker, ts, open, high, low, close, volume): ticks by minute; volume is their number."""
    keyed = ticks.withColumn("minute", F.date_trunc("minute", at))
    return keyed.groupBy("ticker", "minute").agg(*ohlcv(price, F.count(F.lit(1)), F.struct(at, price))).withColumnRenamed("minute", "ts")


def minute_to_daily(minutes: DataFrame) -> DataFrame:
    """Rows (ticker, day, open, high, low, close, volume): first open, last close."""
    return minutes.groupBy("ticker", F.to_date("ts").alias("day")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def clean_bars(rows: DataFrame) -> DataFrame:
    """Bars with a close and some volume."""
    return rows.where("close is not null and volume > 0")
