"""News sentiment by day and over trailing days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.columns import MARKET_KEY
from marketweave.operators.ingest import dedupe

LABELS = ("positive", "negative", "neutral")


def staged_news(news: DataFrame) -> DataFrame:
    """Items with an accepted label, one of each natural key."""
    return dedupe(news.where(F.col("sentiment").isin(*LABELS)), ["source", "url", "ts"])


def sentiment_daily(news: DataFrame) -> DataFrame:
    """Rows (ticker, day, mean_intensity, positive, negative, items)."""
    return news.groupBy("ticker", F.to_date("ts").alias("day")).agg(
        F.avg("intensity").alias("mean_intensity"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count(F.lit(1)).alias("items"),
        F.sum("intensity").alias("intensity_sum"),
    )


def sentiment_trailing(daily: DataFrame, days: int = 7) -> DataFrame:
    """Rows (ticker, day, sentiment_7d, news_count_7d) over the last ``days`` days, the day itself included.

    Runs on daily sums, so a window holds at most ``days`` rows however many items there are.
    """
    number = F.datediff("day", F.lit("1970-01-01"))
    w = Window.partitionBy("ticker").orderBy("_n").rangeBetween(1 - days, 0)
    keyed = daily.withColumn("_n", number)
    total, count = F.sum("intensity_sum").over(w), F.sum("items").over(w)
    return keyed.select("ticker", "day", F.try_divide(total, count).alias(f"sentiment_{days}d"), count.alias(f"news_count_{days}d"))


def sentiment_as_of(news: DataFrame, day, days: int = 7) -> DataFrame:
    """Rows (ticker, sentiment_7d, news_count_7d) of the days (day - 7 ... day]."""
    d = F.to_date("ts")
    recent = news.where((d > F.date_sub(F.lit(day), days)) & (d <= F.lit(day)))
    return recent.groupBy("ticker").agg(F.avg("intensity").alias(f"sentiment_{days}d"), F.count(F.lit(1)).alias(f"news_count_{days}d"))


def with_market(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """rows with the market-wide news of their day: one row a day, joined by day."""
    market = daily.where(F.col("ticker") == MARKET_KEY).select("day", F.col("mean_intensity").alias("market_intensity"), F.col("items").alias("market_items"))
    return rows.join(market, "day", "left")


def negative_spikes(daily: DataFrame, last_day, factor: float = 1.5, week: int = 7, base: int = 21) -> DataFrame:
    """Days of the last week whose negative count is above ``factor`` times the mean of the ``base`` days before."""
    n = F.datediff("day", F.lit("1970-01-01"))
    w = Window.partitionBy("ticker").orderBy("_n").rangeBetween(-base, -1)
    known = daily.where(F.col("ticker") != MARKET_KEY).withColumn("_n", n).withColumn("trailing_mean", F.avg("negative").over(w))
    recent = known.where((F.col("day") > F.date_sub(F.lit(last_day), week)) & (F.col("day") <= F.lit(last_day)))
    return recent.where(F.col("negative") > factor * F.col("trailing_mean")).select("ticker", "day", "negative", "trailing_mean")
