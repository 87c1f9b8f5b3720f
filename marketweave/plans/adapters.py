"""Domain views over the driver's tables, each with its SQL twin in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import columns as C
from marketweave.operators.fundamentals import WIDE

TICKERS = 25
NEWS_SHIFT_DAYS = 8122
MARKET_EVERY = 20
AMENDED_EVERY = 10
FILING_LAG = 95

REVENUE_TAG = f"CASE WHEN o_orderkey % 3 = 0 THEN '{C.REVENUE_FALLBACK}' ELSE '{C.REVENUE}' END"
#: The facts that one order reports: SQL of (metric, value), which Spark and DuckDB read alike.
REPORTED = (
    (f"'{C.EPS}'", "o_totalprice / 50"),
    (REVENUE_TAG, "o_totalprice"),
    (f"'{C.NET_INCOME}'", "o_totalprice * (o_orderkey % 11 - 3) / 20"),
    (f"'{C.DEBT}'", "o_totalprice * (o_orderkey % 7) * 20000"),
    (f"'{C.SHARES}'", "o_totalprice * 2"),
    (f"'{C.CASH_FLOW}'", "o_totalprice * (o_orderkey % 5 - 2)"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticker_of(number) -> F.Column:
    return F.concat(F.lit("T"), F.lpad((number % TICKERS).cast("string"), 2, "0"))


def company_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(ticker_of(F.col("n_nationkey")).alias("ticker"), C.pad_cik(F.col("n_nationkey")).alias("cik"), F.col("n_name").alias("company_name"), F.col("r_name").alias("sector"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        ticker_of(F.col("l_partkey")).alias("ticker"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("volume"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (ticker, day, open, high, low, close, volume)."""
    from marketweave.operators.bars import bars

    return bars(trades(spark, sf_dir), ["ticker", "day"], "price", F.sum("volume"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(ticker_of(F.col("user_id")).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def landed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars in the shape of the landing table, with an extra column."""
    b = daily_bars(spark, sf_dir)
    return b.select(
        F.lit(True).alias("extra"), F.col("volume").alias("Volume"), F.col("day").alias("date"), F.col("ticker").alias("symbol"), F.col("close").alias("Adj Close"), F.col("close").alias("Close"),
        F.lit(0.0).alias("Dividends"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("open").alias("Open"), F.lit(0.0).alias("Stock Splits"),
    )


def edgar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    reported = F.inline(F.array(*[F.struct(F.expr(m).alias("metric"), F.expr(v).alias("value")) for m, v in REPORTED]))
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    day = F.to_date("o_orderdate")
    return o.select(
        ticker_of(F.col("o_custkey")).alias("ticker"),
        C.pad_cik(F.col("o_custkey") % TICKERS).alias("cik"),
        reported,
        F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1).alias("period_end"),
        F.date_add(day, F.lit(FILING_LAG) + (key % 60).cast("int")).alias("filed_date"),
        F.concat(form, F.when(key % AMENDED_EVERY == 0, "/A").otherwise("")).alias("form_type"),
        F.concat(F.lpad(key.cast("string"), 10, "0"), F.lit("-00-000001")).alias("accession_no"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    label = F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative").otherwise("neutral")
    return e.select(
        F.when(key % MARKET_EVERY == 0, C.MARKET_KEY).otherwise(ticker_of(F.col("user_id"))).alias("ticker"),
        (F.col("ts").cast("timestamp") - F.expr(f"INTERVAL {NEWS_SHIFT_DAYS} DAYS")).alias("ts"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("headline"),
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
        label.alias("sentiment"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("intensity"),
        F.concat(F.lit("http://news.example/"), key.cast("string")).alias("url"),
    )


def _ticker(number: str) -> str:
    return f"'T' || lpad(({number} % {TICKERS})::VARCHAR, 2, '0')"


#: CTEs by name; with_(...) puts those a query needs before it.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "company": (
        f"SELECT {_ticker('n_nationkey')} AS ticker, lpad(n_nationkey::VARCHAR, 10, '0') AS cik, n_name AS company_name, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey",
        (),
    ),
    "daily": (
        f"SELECT {_ticker('l_partkey')} AS ticker, l_shipdate::DATE AS day, min_by(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open, "
        "max(l_extendedprice) AS high, min(l_extendedprice) AS low, max_by(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
        (),
    ),
    "facts": (
        f"SELECT {_ticker('o_custkey')} AS ticker, lpad((o_custkey % {TICKERS})::VARCHAR, 10, '0') AS cik, m.metric AS metric, m.value AS value, "
        "(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, "
        f"(o_orderdate::DATE + ({FILING_LAG} + o_orderkey % 60)::INT)::DATE AS filed_date, "
        f"CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END || CASE WHEN o_orderkey % {AMENDED_EVERY} = 0 THEN '/A' ELSE '' END AS form_type, "
        "lpad(o_orderkey::VARCHAR, 10, '0') || '-00-000001' AS accession_no "
        f"FROM (SELECT *, unnest([{', '.join(f'{{metric: {m}, value: {v}}}' for m, v in REPORTED)}]) AS m FROM orders)",
        (),
    ),
    "news": (
        f"SELECT CASE WHEN event_id % {MARKET_EVERY} = 0 THEN '{C.MARKET_KEY}' ELSE {_ticker('user_id')} END AS ticker, ts - INTERVAL {NEWS_SHIFT_DAYS} DAY AS ts, event_type || ' ' || props AS headline, "
        "'src' || (user_id % 7)::VARCHAR AS source, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment, "
        "least(value / 500, 1.0) AS intensity, 'http://news.example/' || event_id::VARCHAR AS url FROM events",
        (),
    ),
    "minutes": (
        f"SELECT {_ticker('user_id')} AS ticker, date_trunc('minute', ts) AS minute, min_by(value, row(ts, value)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, value)) AS close, count(*) AS volume FROM events GROUP BY 1, 2",
        (),
    ),
    "returns": ("SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS daily_return FROM daily", ("daily",)),
    "tech": (
        "SELECT ticker, day, open, high, low, close, volume, daily_return, avg(close) OVER (PARTITION BY ticker ORDER BY day ROWS 29 PRECEDING) AS ma_30d, "
        "avg(close) OVER (PARTITION BY ticker ORDER BY day ROWS 89 PRECEDING) AS ma_90d, stddev_samp(daily_return) OVER (PARTITION BY ticker ORDER BY day ROWS 29 PRECEDING) AS vol_30d, "
        "avg(daily_return) OVER (PARTITION BY ticker ORDER BY day ROWS 29 PRECEDING) AS mean_30d FROM returns",
        ("returns",),
    ),
    "technicals": (f"SELECT * EXCLUDE (mean_30d), (mean_30d - {C.RISK_FREE}::DOUBLE / {C.TRADING_DAYS}) / nullif(vol_30d, 0) * sqrt({C.TRADING_DAYS}.0::DOUBLE) AS sharpe_30d FROM tech", ("tech",)),
    "staged": ("SELECT *, split_part(form_type, '/', 1) AS base_form FROM facts WHERE split_part(form_type, '/', 1) IN ('10-K', '10-Q', '8-K')", ("facts",)),
    "latest": ("SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY cik, metric, period_end ORDER BY filed_date DESC, accession_no DESC) = 1", ("staged",)),
    "wide": (
        "SELECT ticker, cik, base_form, period_end, " + ", ".join(f"max_by(value, row(filed_date, accession_no)) FILTER (WHERE metric = '{m}') AS {n}" for m, n in WIDE.items()) + " FROM latest GROUP BY ALL",
        ("latest",),
    ),
    "grown": (
        "SELECT *, coalesce(revenue_tag, revenue_fallback) AS revenue, coalesce(revenue_tag, revenue_fallback) / nullif(lag(coalesce(revenue_tag, revenue_fallback)) OVER (PARTITION BY cik, base_form ORDER BY period_end), 0) - 1 AS revenue_growth_qoq FROM wide",
        ("wide",),
    ),
    "sent": (
        "SELECT ticker, ts::DATE AS day, avg(intensity) AS mean_intensity, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) AS items, sum(intensity) AS intensity_sum FROM news GROUP BY 1, 2",
        ("news",),
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in (*_needed(CTES[name][1]), name):
            if n not in out:
                out.append(n)
    return out


def with_(*names: str, more: str = "") -> str:
    """WITH clause of the CTEs and what they need; ``more`` holds further ones."""
    parts = [f"{n} AS ({CTES[n][0]})" for n in _needed(names)]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n"
