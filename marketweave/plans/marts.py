"""Marts: the feature store, its selected subset and the stock screener."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.operators import fundamentals, sentiment, technicals

#: Columns of the feature store that a model may use.
FEATURES = (
    "daily_return", "ma_30d", "ma_90d", "vol_30d", "sharpe_30d", "eps_basic", "net_income", "long_term_debt", "shares_outstanding", "operating_cash_flow", "revenue",
    "mean_intensity", "positive", "negative",
)


def features(bars: DataFrame, facts: DataFrame, news: DataFrame) -> DataFrame:
    """Ticker x day: technicals, fundamentals as known on the day, the day's sentiment.

    The rolling windows and the point-in-time join share the partitioning by ticker.
    """
    rows = fundamentals.fundamentals_asof(technicals.technicals(bars), fundamentals.staged(facts))
    daily = sentiment.sentiment_daily(news).select("ticker", "day", "mean_intensity", "positive", "negative")
    return rows.join(daily, ["ticker", "day"], "left").fillna(0, ["positive", "negative"])


def training_frame(store: DataFrame, horizon: int = 5) -> DataFrame:
    """The store with its target; rows without a target (the last ones of a ticker) drop out."""
    name = f"forward_return_{horizon}"
    return technicals.forward_return(store, [horizon]).where(F.col(name).isNotNull())


def feature_summary(store: DataFrame, selected: Sequence[str]) -> DataFrame:
    """The selected features only."""
    if unknown := sorted(set(selected) - set(store.columns)):
        raise ValueError(f"no such features: {unknown}")
    return store.select("ticker", "day", *selected)


def latest_fundamentals(facts: DataFrame) -> DataFrame:
    """One row a ticker: its latest period with growth."""
    wide = fundamentals.pivot_metrics(fundamentals.latest_facts(fundamentals.staged(facts)), ["ticker", "cik", "base_form", "period_end"])
    grown = fundamentals.growth_qoq(wide)
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("period_end").desc(), "base_form"))
    return grown.withColumn("_rank", newest).where("_rank = 1").drop("_rank", "revenue_tag", "revenue_fallback", "gap_quarters")


def screener(bars: DataFrame, facts: DataFrame, news: DataFrame, companies: DataFrame) -> DataFrame:
    """One row a ticker: company, latest fundamentals and ratios, technicals and 7-day sentiment."""
    tech = technicals.latest(technicals.technicals(bars)).select("ticker", F.col("close").alias("latest_price"), F.col("day").alias("price_date"), "ma_30d", "ma_90d", "vol_30d", "sharpe_30d")
    last = bars.agg(F.max("day").alias("last_day"))
    day = F.to_date("ts")
    recent = news.join(F.broadcast(last), (day > F.date_sub("last_day", 7)) & (day <= F.col("last_day")))  # one row is broadcast
    mood = recent.groupBy("ticker").agg(F.avg("intensity").alias("sentiment_7d"), F.count(F.lit(1)).alias("news_count_7d"))
    joined = companies.drop("cik").join(latest_fundamentals(facts), "ticker", "left").join(tech, "ticker", "left").join(mood, "ticker", "left")
    return fundamentals.ratios(joined).fillna(0, ["news_count_7d"])
