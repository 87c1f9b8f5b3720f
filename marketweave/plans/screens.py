"""Analyst questions over the screener and its neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.columns import EPS


def value_growth(mart: DataFrame, sector: str | None, max_pe: float = 20, min_growth: float = 0.15) -> DataFrame:
    rows = mart.where((F.col("price_to_earnings") < max_pe) & (F.col("revenue_growth_qoq") > min_growth))
    return in_sector(rows, sector).select("ticker", "sector", "price_to_earnings", "revenue_growth_qoq")


def pe_growth(mart: DataFrame, since, max_pe: float = 15, min_growth: float = 0.10) -> DataFrame:
    rows = mart.where((F.col("price_to_earnings") < max_pe) & (F.col("revenue_growth_qoq") > min_growth) & (F.col("period_end") >= F.lit(since)))
    return rows.select("ticker", "period_end", "price_to_earnings", "revenue_growth_qoq")


def in_sector(rows: DataFrame, sector: str | None) -> DataFrame:
    return rows if sector is None else rows.where(F.col("sector") == sector)


def sector_beats(latest: DataFrame, companies: DataFrame, by: float = 0.05) -> DataFrame:
    """Share of each sector's tickers whose earnings per share rose by more than ``by`` (a proxy: there are no estimates)."""
    eps = latest.where((F.col("metric") == EPS) & (F.col("base_form") == "10-Q"))
    w = Window.partitionBy("ticker").orderBy(F.col("period_end").desc())
    ranked = eps.withColumns({"_rank": F.row_number().over(w), "before": F.lead("value").over(w)}).where("_rank = 1")
    beat = F.coalesce(F.try_divide(F.col("value"), F.col("before")) - 1 > by, F.lit(False))
    joined = ranked.join(companies, "ticker").groupBy("sector").agg(F.count(F.lit(1)).alias("tickers"), F.count_if(beat).alias("beats"))
    return joined.withColumn("beat_share", F.try_divide(F.col("beats").cast("double"), F.col("tickers")))


def risk_flags(mart: DataFrame, leverage: float = 1.0) -> DataFrame:
    """Leverage above a level, with negative operating cash flow as a second flag."""
    risky = F.coalesce(F.col("debt_to_market_cap") > leverage, F.lit(False))
    burning = F.coalesce(F.col("operating_cash_flow") < 0, F.lit(False))
    return mart.select("ticker", "debt_to_market_cap", "operating_cash_flow", risky.alias("high_leverage"), burning.alias("negative_cash_flow"), (risky & burning).alias("flagged"))


def small_profitable(mart: DataFrame, sector: str | None, max_cap: float = 1e10) -> DataFrame:
    return in_sector(mart.where((F.col("net_income") > 0) & (F.col("market_cap") < max_cap)), sector).select("ticker", "sector", "net_income", "market_cap")


def top_sharpe(mart: DataFrame, k: int = 10) -> DataFrame:
    """The k tickers with the highest ratio (a top-k plan, no full sort)."""
    return mart.where("sharpe_30d is not null").orderBy(F.col("sharpe_30d").desc(), "ticker").limit(k).select("ticker", "sharpe_30d")


def margin(mart: DataFrame, sector: str | None, max_pe: float = 15, min_margin: float = 0.2) -> DataFrame:
    return in_sector(mart.where((F.col("price_to_earnings") < max_pe) & (F.col("net_margin") > min_margin)), sector).select("ticker", "sector", "price_to_earnings", "net_margin")


def peers(mart: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """The named tickers side by side: fundamentals and momentum."""
    return mart.where(F.col("ticker").isin(*tickers)).select(
        "ticker", "company_name", "period_end", "eps_basic", "revenue", "net_income", "price_to_earnings", "market_cap", "net_margin", "latest_price", "ma_30d", "ma_90d", "sharpe_30d"
    )


def ticker_fundamentals(wide: DataFrame, ticker: str, quarters: int = 4) -> DataFrame:
    """The latest periods of one ticker."""
    rows = wide.where(F.col("ticker") == ticker)
    return rows.orderBy(F.col("period_end").desc(), "base_form").limit(quarters).select("ticker", "period_end", "base_form", "eps_basic", "revenue", "net_income", "long_term_debt", "shares_outstanding", "operating_cash_flow")


def sector_performance(mart: DataFrame, sector: str | None = None) -> DataFrame:
    """Aggregates by sector (null fields are left out of the means)."""
    return in_sector(mart, sector).groupBy("sector").agg(
        F.count(F.lit(1)).alias("tickers"), F.avg("price_to_earnings").alias("avg_pe"), F.avg("net_margin").alias("avg_margin"), F.avg("sharpe_30d").alias("avg_sharpe"), F.sum("market_cap").alias("total_cap")
    )
