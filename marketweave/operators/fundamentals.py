"""Filed facts: latest state, pivots, growth, ratios and the point-in-time join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions import columns as C

#: Output names of the metrics.
WIDE = {C.EPS: "eps_basic", C.NET_INCOME: "net_income", C.REVENUE: "revenue_tag", C.DEBT: "long_term_debt", C.SHARES: "shares_outstanding", C.CASH_FLOW: "operating_cash_flow", C.REVENUE_FALLBACK: "revenue_fallback"}


def staged(facts: DataFrame) -> DataFrame:
    """Facts of accepted forms (amendments too), with base_form."""
    return facts.where(C.accepted_form(F.col("form_type"))).withColumn("base_form", C.base_form(F.col("form_type")))


def latest_facts(facts: DataFrame, key: Sequence[str] = ("cik", "metric", "period_end")) -> DataFrame:
    """The fact of each key that was filed last; accession numbers break ties."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("filed_date").desc(), F.col("accession_no").desc()))
    return facts.withColumn("_rank", newest).where("_rank = 1").drop("_rank")


def pivot_metrics(latest: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row of ``by``, one column of each metric, and revenue with its fallback.

    Fixed metric list: no job is spent to find it. Within ``by``, the last filed value counts.
    """
    order = F.struct("filed_date", "accession_no")
    wide = latest.groupBy(*by).agg(*[F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, order)).alias(name) for m, name in WIDE.items()])
    return wide.withColumn("revenue", F.coalesce("revenue_tag", "revenue_fallback"))


def growth_qoq(wide: DataFrame, value: str = "revenue", name: str = "revenue_growth_qoq") -> DataFrame:
    """Growth over the previous period of the same company and base form, with the quarters between them."""
    w = Window.partitionBy("cik", "base_form").orderBy("period_end")
    gap = F.round(F.months_between("period_end", F.lag("period_end").over(w)) / 3).cast("int")
    return wide.withColumns({name: F.try_divide(F.col(value), F.lag(value).over(w)) - 1, "gap_quarters": gap})


def ratios(rows: DataFrame, price: str = "latest_price") -> DataFrame:
    """rows with the engineered ratios; zero denominators give null."""
    cap = F.col(price) * F.col("shares_outstanding")
    return rows.withColumns(
        {
            "price_to_earnings": F.try_divide(F.col(price), F.col("eps_basic")),
            "market_cap": cap,
            "debt_to_market_cap": F.try_divide(F.col("long_term_debt"), cap),
            "net_margin": F.try_divide(F.col("net_income"), F.col("revenue")),
        }
    )


def fundamentals_asof(days: DataFrame, facts: DataFrame) -> DataFrame:
    """days (ticker, day, ...) with each metric's value as it was known on that day.

    Known is what was filed on the day or before; of those, the last by (filed_date,
    period_end, accession_no). Amendments show only from their own filing on, and nothing
    is joined on period_end. Facts and days go through one exchange by ticker and one
    running window: no range join.
    """
    known = facts.select(
        "ticker", F.col("filed_date").alias("_at"), F.lit(0).alias("_kind"), F.col("period_end").alias("_period"), F.col("accession_no").alias("_accession"),
        *[F.when(F.col("metric") == m, F.col("value")).alias(n) for m, n in WIDE.items()],
    )
    asked = days.withColumns({"_at": F.col("day"), "_kind": F.lit(1)})
    every = asked.unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("_at", "_kind", "_period", "_accession").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in WIDE.values()})
    out = filled.where("_kind = 1").withColumn("revenue", F.coalesce("revenue_tag", "revenue_fallback"))
    return out.select(*days.columns, *[n for n in WIDE.values() if n not in ("revenue_tag", "revenue_fallback")], "revenue")
