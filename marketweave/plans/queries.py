"""The engine's queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import columns as C
from marketweave.operators import bars, checks, fundamentals, ingest, reshape, sentiment, technicals
from marketweave.plans import adapters as A
from marketweave.plans import marts, screens
from marketweave.plans.adapters import with_
from marketweave.schemas import OHLCV
from marketweave.sources import filings, universe

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FLOOR, END = date(1995, 1, 1), date(2001, 11, 5)
STALE_FROM = date(2001, 10, 1)
FIELDS = ("Close", "Volume")
SYMBOLS = tuple(f"T{k:02d}" for k in range(A.TICKERS))
SINCE, UNTIL = date(1997, 1, 1), date(1997, 3, 31)
CUT = datetime(1998, 1, 1)
WEEK_END = date(2001, 11, 4)
GROWTH_SECTOR, PROFIT_SECTOR = "EUROPE", "MIDDLE EAST"
FUNDAMENTALS = ("eps_basic", "net_income", "long_term_debt", "shares_outstanding", "operating_cash_flow", "revenue")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Six places, rounded a little off the half: means of few short decimals often lie on it, and engines differ there."""
    return df.withColumns({n: F.round(F.col(n) + F.lit(1e-7), 6) for n in names})


# --- bars and technicals ----------------------------------------------------


@query("daily_ohlcv", with_("daily") + "SELECT * FROM daily")
def daily_ohlcv(spark, d):
    return A.daily_bars(spark, d)


@query("ma_30_90", with_("technicals") + "SELECT ticker, day, close, round(ma_30d + 1e-7, 6) AS ma_30d, round(ma_90d + 1e-7, 6) AS ma_90d FROM technicals")
def ma_30_90(spark, d):
    out = technicals.moving_average(technicals.moving_average(A.daily_bars(spark, d), 30), 90)
    return rounded(out.select("ticker", "day", "close", "ma_30d", "ma_90d"), "ma_30d", "ma_90d")


@query("daily_return", with_("returns") + "SELECT ticker, day, round(daily_return + 1e-7, 6) AS daily_return FROM returns")
def daily_return(spark, d):
    return rounded(technicals.daily_return(A.daily_bars(spark, d)).select("ticker", "day", "daily_return"), "daily_return")


@query("vol_30d", with_("technicals") + "SELECT ticker, day, round(vol_30d + 1e-7, 6) AS vol_30d FROM technicals")
def vol_30d(spark, d):
    return rounded(technicals.technicals(A.daily_bars(spark, d)).select("ticker", "day", "vol_30d"), "vol_30d")


@query("sharpe_30d", with_("technicals") + "SELECT ticker, day, round(sharpe_30d + 1e-7, 6) AS sharpe_30d FROM technicals")
def sharpe_30d(spark, d):
    return rounded(technicals.technicals(A.daily_bars(spark, d)).select("ticker", "day", "sharpe_30d"), "sharpe_30d")


@query("minute_bars", with_("minutes") + "SELECT ticker, minute AS ts, open, high, low, close, volume FROM minutes")
def minute_bars(spark, d):
    return bars.minute_bars(A.ticks(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "minute_to_daily",
    with_("minutes") + "SELECT ticker, minute::DATE AS day, min_by(open, minute) AS open, max(high) AS high, min(low) AS low, max_by(close, minute) AS close, sum(volume)::BIGINT AS volume FROM minutes GROUP BY 1, 2",
)
def minute_to_daily(spark, d):
    return bars.minute_to_daily(bars.clean_bars(bars.minute_bars(A.ticks(spark, d))))


@query(
    "forward_return",
    with_("daily") + "SELECT ticker, day, round(lead(close, 1) OVER w / close - 1 + 1e-7, 6) AS forward_return_1, round(lead(close, 5) OVER w / close - 1 + 1e-7, 6) AS forward_return_5 FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY day)",
)
def forward_return(spark, d):
    out = technicals.forward_return(A.daily_bars(spark, d)).select("ticker", "day", "forward_return_1", "forward_return_5")
    return rounded(out, "forward_return_1", "forward_return_5")


@query("symbol_scan", with_("daily") + "SELECT * FROM daily WHERE ticker = 'T07'")
def symbol_scan(spark, d):
    return A.daily_bars(spark, d).where(F.col("ticker") == "T07")


@query("clean_bars", with_("daily") + "SELECT * FROM daily WHERE close IS NOT NULL AND volume > 0")
def clean_bars(spark, d):
    return bars.clean_bars(A.daily_bars(spark, d))


# --- schema, reshape --------------------------------------------------------


@query("company_meta", with_("company") + "SELECT * FROM company")
def company_meta(spark, d):
    return A.company_meta(spark, d)


_LANDED = 'SELECT day AS date, ticker AS symbol, close AS "Adj Close", close AS "Close", 0.0::DOUBLE AS "Dividends", high AS "High", low AS "Low", open AS "Open", 0.0::DOUBLE AS "Stock Splits", volume AS "Volume" FROM daily'


@query("validate_projection", with_("daily") + _LANDED)
def validate_projection(spark, d):
    return OHLCV.validate(A.landed_bars(spark, d))


@query("stamp", with_("daily") + f"SELECT *, DATE '{END}' AS run_date, TIMESTAMP '{END} 00:00:00' AS inserted_at FROM ({_LANDED})")
def stamp(spark, d):
    out = ingest.stamp(OHLCV.validate(A.landed_bars(spark, d)), END, datetime(END.year, END.month, END.day))
    return out.withColumn("inserted_at", F.col("inserted_at").cast("timestamp_ntz"))


def _wide(spark, d):
    return reshape.tidy_to_wide(A.landed_bars(spark, d), FIELDS, SYMBOLS)


@query(
    "wide_to_long",
    with_("daily")
    + f"SELECT g.day AS date, s.symbol, f.field, CASE f.field WHEN 'Close' THEN close ELSE volume END AS value FROM (SELECT DISTINCT day FROM daily) g "
    + f"CROSS JOIN (SELECT unnest({list(SYMBOLS)}) AS symbol) s CROSS JOIN (SELECT unnest({list(FIELDS)}) AS field) f LEFT JOIN daily b ON b.ticker = s.symbol AND b.day = g.day",
)
def wide_to_long(spark, d):
    return reshape.wide_to_long(_wide(spark, d))


@query("wide_to_tidy", with_("daily") + 'SELECT day AS date, ticker AS symbol, close AS "Close", volume AS "Volume" FROM daily')
def wide_to_tidy(spark, d):
    return reshape.long_to_tidy(reshape.wide_to_long(_wide(spark, d)), FIELDS)


@query(
    "long_to_wide",
    "SELECT l_shipdate::DATE AS date, 'T' || lpad((l_partkey % 25)::VARCHAR, 2, '0') AS symbol, round(avg(l_extendedprice) + 1e-7, 6) AS \"Close\", round(avg(l_quantity) + 1e-7, 6) AS \"Volume\" FROM lineitem GROUP BY 1, 2",
)
def long_to_wide(spark, d):
    t = A.trades(spark, d).select(F.col("day").alias("date"), F.col("ticker").alias("symbol"), F.col("price").alias("Close"), F.col("volume").alias("Volume"))
    long = t.unpivot(["date", "symbol"], ["Close", "Volume"], "field", "value")
    return rounded(reshape.long_to_tidy(long, FIELDS), *FIELDS)


# --- incremental loading ----------------------------------------------------


def _marks(spark, d):
    stored = A.landed_bars(spark, d).where(~((F.substring("symbol", 2, 2).cast("int") % 5 == 3) & (F.col("date") >= F.lit(STALE_FROM))))
    return ingest.watermarks(stored)


def _universe(spark, d):
    """All companies, two new symbols and one that stands there twice."""
    known = A.company_meta(spark, d).select(F.substring("ticker", 2, 2).cast("int").alias("pos"), F.col("ticker").alias("symbol"))
    return known.unionByName(spark.sql("SELECT * FROM VALUES (25, 'NEW1'), (26, 'NEW2'), (27, 'T03') AS t(pos, symbol)"))


_MARKS = f"marks AS (SELECT ticker AS symbol, max(day) AS max_date FROM daily WHERE NOT (substr(ticker, 2, 2)::INT % 5 = 3 AND day >= DATE '{STALE_FROM}') GROUP BY 1)"
_UNIVERSE = "universe AS (SELECT substr(ticker, 2, 2)::INT AS pos, ticker AS symbol FROM company UNION ALL VALUES (25, 'NEW1'), (26, 'NEW2'), (27, 'T03'))"
_PLAN = f"plan AS (SELECT symbol, pos, coalesce(max_date + 1, DATE '{FLOOR}')::DATE AS start FROM universe LEFT JOIN marks USING (symbol) WHERE coalesce(max_date + 1, DATE '{FLOOR}') < DATE '{END}')"


@query("watermarks", with_("daily", more=_MARKS) + "SELECT * FROM marks")
def watermarks(spark, d):
    return _marks(spark, d)


@query("gap_plan", with_("daily", "company", more=f"{_MARKS}, {_UNIVERSE}, {_PLAN}") + "SELECT symbol, pos, start FROM plan")
def gap_plan(spark, d):
    return ingest.gap_plan(_universe(spark, d), _marks(spark, d), FLOOR, END)


@query("gap_groups", with_("daily", "company", more=f"{_MARKS}, {_UNIVERSE}, {_PLAN}") + "SELECT start, string_agg(symbol, ',' ORDER BY pos) AS symbols FROM plan GROUP BY 1")
def gap_groups(spark, d):
    groups = ingest.gap_groups(ingest.gap_plan(_universe(spark, d), _marks(spark, d), FLOOR, END))
    return groups.withColumn("symbols", F.array_join("symbols", ","))


@query("symbol_chunks", with_("company", more=_UNIVERSE) + "SELECT pos, symbol, ((row_number() OVER (ORDER BY pos) - 1) // 10)::INT AS chunk_id FROM universe")
def symbol_chunks(spark, d):
    return ingest.symbol_chunks(_universe(spark, d), 10)


_FACT_KEY = ("cik", "metric", "period_end", "form_type", "accession_no")


@query(
    "insert_ignore",
    with_("facts") + "SELECT cik, metric, period_end, min(filed_date) AS filed_date FROM facts f WHERE filed_date >= DATE '1998-01-01' AND NOT EXISTS (SELECT 1 FROM facts o WHERE o.filed_date < DATE '1998-01-01' AND o.cik = f.cik AND o.metric = f.metric AND o.period_end = f.period_end) GROUP BY 1, 2, 3",
)
def insert_ignore(spark, d):
    """A replayed batch against what is stored: new keys only, one row each."""
    facts = A.edgar_facts(spark, d).select("cik", "metric", "period_end", "filed_date")
    new, old = facts.where(F.col("filed_date") >= F.lit(CUT.date())), facts.where(F.col("filed_date") < F.lit(CUT.date()))
    return ingest.insert_ignore(new.unionByName(new), old, ["cik", "metric", "period_end"], ["filed_date"])


@query("incremental_load", f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '{CUT}'")
def incremental_load(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ingest.incremental(rows, CUT, "o_orderdate")


@query(
    "prune_landing",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-03-01' - INTERVAL 40 DAY OR event_id % 3 <> 0",
)
def prune_landing(spark, d):
    rows = A.table(spark, d, "events").select("event_id", "ts")
    return ingest.prune(rows, rows.where("event_id % 3 = 0"), ["event_id"], datetime(2024, 3, 1), 40, "ts")


@query(
    "upsert_watermarks",
    with_("daily", more=_MARKS) + f"SELECT 'ohlcv' AS source, symbol AS entity, greatest(max_date, CASE WHEN symbol = 'T00' THEN DATE '2030-01-01' ELSE max_date END) AS watermark, CASE WHEN symbol = 'T00' THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '{CUT}' END AS updated_at FROM marks",
)
def upsert_watermarks(spark, d):
    state = spark.sql("SELECT 'ohlcv' AS source, 'T00' AS entity, DATE '2030-01-01' AS watermark, TIMESTAMP_NTZ '2001-01-01' AS updated_at UNION ALL SELECT 'ohlcv', 'T01', DATE '1990-01-01', TIMESTAMP_NTZ '2001-01-01'")
    out = ingest.upsert_state(state, "ohlcv", _marks(spark, d), CUT)
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query(
    "dq_checks",
    with_("facts", "daily", "company")
    + "SELECT 'value_present' AS rule, count(*) FILTER (WHERE value IS NULL) AS failures FROM facts UNION ALL SELECT 'form_accepted', count(*) FILTER (WHERE split_part(form_type, '/', 1) NOT IN ('10-K', '10-Q', '8-K')) FROM facts "
    + "UNION ALL SELECT 'first_filing', count(*) FILTER (WHERE form_type LIKE '%/A') FROM facts UNION ALL SELECT 'positive_volume', count(*) FILTER (WHERE volume <= 0) FROM daily "
    + "UNION ALL SELECT 'fact_key_unique', count(*) FROM (SELECT 1 FROM facts GROUP BY cik, metric, period_end, form_type, accession_no HAVING count(*) > 1) "
    + "UNION ALL SELECT 'period_unique', count(*) FROM (SELECT 1 FROM facts GROUP BY cik, metric, period_end HAVING count(*) > 1) UNION ALL SELECT 'ticker_known', count(*) FROM facts WHERE ticker NOT IN (SELECT ticker FROM company WHERE sector <> 'ASIA')",
)
def dq_checks(spark, d):
    facts, companies = A.edgar_facts(spark, d), A.company_meta(spark, d)
    one = checks.failures(facts, {"value_present": F.col("value").isNotNull(), "form_accepted": C.accepted_form(F.col("form_type")), "first_filing": ~F.col("form_type").endswith("/A")})
    two = checks.failures(A.daily_bars(spark, d), {"positive_volume": F.col("volume") > 0})
    keys = checks.repeated_keys(facts, _FACT_KEY, "fact_key_unique").unionByName(checks.repeated_keys(facts, ["cik", "metric", "period_end"], "period_unique"))
    return one.unionByName(two).unionByName(keys).unionByName(checks.unknown_values(facts, companies.where("sector <> 'ASIA'"), "ticker", "ticker_known"))


@query(
    "reconcile",
    with_("facts") + "SELECT coalesce(a.metric, b.metric) AS metric, coalesce(left_rows, 0) AS left_rows, coalesce(right_rows, 0) AS right_rows, coalesce(left_rows, 0) = coalesce(right_rows, 0) AS matches FROM (SELECT metric, count(*) AS left_rows FROM facts GROUP BY 1) a FULL JOIN (SELECT metric, count(*) AS right_rows FROM facts WHERE metric <> 'LongTermDebt' AND NOT (metric = 'Revenues' AND form_type = '8-K') GROUP BY 1) b ON a.metric = b.metric",
)
def reconcile(spark, d):
    facts = A.edgar_facts(spark, d)
    return checks.reconcile(facts, facts.where("metric <> 'LongTermDebt' AND NOT (metric = 'Revenues' AND form_type = '8-K')"), ["metric"])


@query(
    "key_overlap",
    with_("facts") + "SELECT count(*) FILTER (WHERE a AND b) AS in_both, count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only FROM (SELECT bool_or(filed_date < DATE '1998-06-01') AS a, bool_or(filed_date >= DATE '1998-01-01') AS b FROM facts GROUP BY cik, metric, period_end)",
)
def key_overlap(spark, d):
    facts = A.edgar_facts(spark, d)
    return checks.key_overlap(facts.where("filed_date < DATE '1998-06-01'"), facts.where("filed_date >= DATE '1998-01-01'"), ["cik", "metric", "period_end"])


# --- filings ----------------------------------------------------------------


def _index_lines(spark, d):
    """Index text of the facts, with its header; CIKs without their zeros."""
    f = A.edgar_facts(spark, d).join(A.company_meta(spark, d).select("cik", "company_name"), "cik")
    cik = F.col("cik").cast("int").cast("string")
    data = f.select(F.concat_ws("|", cik, F.concat(F.lit(" "), F.col("company_name"), F.lit(" ")), "form_type", F.date_format("filed_date", "yyyyMMdd"), F.concat(F.lit("edgar/data/"), cik, F.lit("/"), F.col("accession_no"), F.lit(".htm"))).alias("value"))
    head = spark.sql("SELECT * FROM VALUES ('Description: Master Index'), (''), ('CIK|Company Name|Form Type|Date Filed|Filename'), ('------------'), ('77|Odd Form Co|S-1|19970115|edgar/data/77/x.htm') AS t(value)")
    return head.unionByName(data)


_INDEX = "idx AS (SELECT f.cik, company_name, form_type, filed_date AS date_filed, 'edgar/data/' || f.cik::INT::VARCHAR || '/' || accession_no || '.htm' AS filename, 'https://www.sec.gov/edgar/data/' || f.cik::INT::VARCHAR || '/' || accession_no || '.htm' AS full_url FROM facts f JOIN company c ON c.cik = f.cik)"


@query("index_parse", with_("facts", "company", more=_INDEX) + "SELECT * FROM idx")
def index_parse(spark, d):
    return filings.parse_index(_index_lines(spark, d))


@query("new_filers", with_("facts", "company", more=_INDEX) + f"SELECT * FROM idx WHERE date_filed BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' AND cik IN (SELECT cik FROM company WHERE sector <> 'ASIA')")
def new_filers(spark, d):
    members = A.company_meta(spark, d).where("sector <> 'ASIA'").select(F.col("cik").cast("int").alias("cik"))
    return filings.new_filers(filings.parse_index(_index_lines(spark, d)), members, SINCE, UNTIL)


@query("unique_filers", with_("facts") + f"SELECT DISTINCT cik FROM facts WHERE filed_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'")
def unique_filers(spark, d):
    return filings.unique_filers(filings.new_filers(filings.parse_index(_index_lines(spark, d)), None, SINCE, UNTIL))


@query("filer_union", with_("facts") + "SELECT DISTINCT cik FROM facts WHERE filed_date IN (DATE '1997-01-06', DATE '1997-01-07', DATE '1997-01-08')")
def filer_union(spark, d):
    facts = A.edgar_facts(spark, d)
    days = [filings.unique_filers(facts.where(F.col("filed_date") == F.lit(date(1997, 1, k)))) for k in (6, 7, 8)]
    return days[0].union(days[1]).union(days[2]).distinct()


def _facts_documents(spark, d):
    """Nested documents as the facts service writes them: one a company and year of filing, so none grows with the history."""
    f = A.edgar_facts(spark, d).withColumn("year", F.year("filed_date"))
    concept = F.when(F.col("metric") == C.CASH_FLOW, C.CASH_FLOW_CONCEPT).otherwise(F.col("metric"))
    space = F.when(F.col("metric") == C.SHARES, "dei").otherwise("us-gaap")
    fact = F.struct(F.date_format("period_end", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"), F.date_format("filed_date", "yyyy-MM-dd").alias("filed"), F.col("form_type").alias("form"), F.col("accession_no").alias("accn"))
    units = f.groupBy("cik", "year", space.alias("space"), concept.alias("concept")).agg(F.collect_list(fact).alias("facts"))
    body = F.struct(F.create_map(F.lit("USD"), F.col("facts")).alias("units"))
    spaces = units.groupBy("cik", "year", "space").agg(F.map_from_entries(F.collect_list(F.struct("concept", body))).alias("concepts"))
    return spaces.groupBy("cik", "year").agg(F.map_from_entries(F.collect_list(F.struct("space", "concepts"))).alias("facts")).select(F.to_json(F.struct(F.col("cik").cast("bigint").alias("cik"), "facts")).alias("value"))


@query("facts_json", with_("facts") + "SELECT cik, metric, value, period_end, filed_date, form_type, accession_no FROM facts WHERE filed_date >= DATE '1997-01-01'")
def facts_json(spark, d):
    rows = filings.metric_facts(filings.parse_facts(_facts_documents(spark, d)), SINCE)
    return rows.select("cik", "metric", "value", "period_end", "filed_date", "form_type", "accession_no")


@query("submissions_json", with_("facts") + "SELECT accession_no, filed_date AS report_date, form_type, accession_no || '.htm' AS primary_document FROM facts")
def submissions_json(spark, d):
    f = A.edgar_facts(spark, d).groupBy("cik", F.year("filed_date")).agg(F.sort_array(F.collect_list(F.struct("accession_no", "filed_date", "form_type"))).alias("r"))
    names = {"accessionNumber": F.col("r.accession_no"), "reportDate": F.transform("r.filed_date", lambda x: F.date_format(x, "yyyy-MM-dd")), "form": F.col("r.form_type"), "primaryDocument": F.transform("r.accession_no", lambda x: F.concat(x, F.lit(".htm")))}
    doc = f.select(F.to_json(F.struct(F.struct(F.struct(*[c.alias(n) for n, c in names.items()]).alias("recent")).alias("filings"))).alias("value"))
    return filings.parse_submissions(doc)


@query("concept_json", with_("facts") + f"SELECT '{C.DEBT}' AS concept, period_end AS end_date, value AS val, accession_no AS accn FROM facts WHERE metric = '{C.DEBT}' AND split_part(form_type, '/', 1) = '10-Q'")
def concept_json(spark, d):
    f = A.edgar_facts(spark, d).where(F.col("metric") == C.DEBT)
    fact = F.struct(F.date_format("period_end", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"), F.col("form_type").alias("form"), F.col("accession_no").alias("accn"))
    docs = f.groupBy("cik", F.year("filed_date")).agg(F.collect_list(fact).alias("facts")).select(F.to_json(F.struct(F.lit(C.DEBT).alias("tag"), F.create_map(F.lit("USD"), F.col("facts")).alias("units"))).alias("value"))
    return filings.parse_concept(docs).where(C.base_form(F.col("form")) == "10-Q").select("concept", F.col("end").alias("end_date"), "val", "accn")


@query("universe_json", with_("company") + "SELECT ticker, cik, company_name AS title FROM company")
def universe_json(spark, d):
    c = A.company_meta(spark, d).select(F.struct(F.col("cik").cast("bigint").alias("cik_str"), "ticker", F.col("company_name").alias("title")).alias("v"))
    doc = c.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("v.cik_str").cast("string"), "v")))).alias("value"))
    return universe.parse_tickers(doc)


@query("cik_map", with_("company") + "SELECT ticker, cik, 'CIK' || cik AS prefixed, c_custkey FROM customer JOIN company ON lpad((c_custkey % 25)::VARCHAR, 10, '0') = cik")
def cik_map(spark, d):
    """Unpadded numbers joined to padded ones."""
    customers = A.table(spark, d, "customer").select("c_custkey", C.pad_cik(F.col("c_custkey") % 25).alias("cik"))
    return customers.join(A.company_meta(spark, d), "cik").select("ticker", "cik", C.prefixed_cik(F.col("cik")).alias("prefixed"), "c_custkey")


@query(
    "index_calendar",
    f"SELECT d::DATE AS day, 'https://www.sec.gov/Archives/edgar/daily-index/' || year(d) || '/QTR' || quarter(d) || '/master.' || strftime(d, '%Y%m%d') || '.idx' AS url FROM range(TIMESTAMP '{SINCE}', TIMESTAMP '{UNTIL}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d) WHERE dayofweek(d) NOT IN (0, 6)",
)
def index_calendar(spark, d):
    return filings.index_days(spark, SINCE, UNTIL)


# --- fundamentals -----------------------------------------------------------


@query("facts_latest", with_("latest") + "SELECT cik, metric, period_end, value, filed_date, form_type, accession_no FROM latest")
def facts_latest(spark, d):
    return fundamentals.latest_facts(fundamentals.staged(A.edgar_facts(spark, d))).select("cik", "metric", "period_end", "value", "filed_date", "form_type", "accession_no")


def _wide_facts(spark, d):
    latest = fundamentals.latest_facts(fundamentals.staged(A.edgar_facts(spark, d)))
    return fundamentals.pivot_metrics(latest, ["ticker", "cik", "base_form", "period_end"])


@query("facts_pivot", with_("wide") + "SELECT * FROM wide")
def facts_pivot(spark, d):
    return _wide_facts(spark, d).drop("revenue")


@query("revenue_fallback", with_("wide") + "SELECT ticker, base_form, period_end, coalesce(revenue_tag, revenue_fallback) AS revenue FROM wide WHERE coalesce(revenue_tag, revenue_fallback) IS NOT NULL")
def revenue_fallback(spark, d):
    return _wide_facts(spark, d).where("revenue is not null").select("ticker", "base_form", "period_end", "revenue")


@query("growth_qoq", with_("grown") + "SELECT ticker, base_form, period_end, revenue, revenue_growth_qoq FROM grown")
def growth_qoq(spark, d):
    return fundamentals.growth_qoq(_wide_facts(spark, d)).select("ticker", "base_form", "period_end", "revenue", "revenue_growth_qoq")


_LATEST_PRICE = "price AS (SELECT ticker, max_by(close, day) AS latest_price, max(day) AS price_date FROM daily GROUP BY 1)"


@query(
    "ratios",
    with_("grown", "daily", more=_LATEST_PRICE)
    + "SELECT ticker, base_form, period_end, latest_price / nullif(eps_basic, 0) AS price_to_earnings, latest_price * shares_outstanding AS market_cap, long_term_debt / nullif(latest_price * shares_outstanding, 0) AS debt_to_market_cap, net_income / nullif(revenue, 0) AS net_margin FROM grown JOIN price USING (ticker)",
)
def ratios(spark, d):
    price = A.daily_bars(spark, d).groupBy("ticker").agg(F.max_by("close", "day").alias("latest_price"))
    out = fundamentals.ratios(_wide_facts(spark, d).join(price, "ticker"))
    return out.select("ticker", "base_form", "period_end", "price_to_earnings", "market_cap", "debt_to_market_cap", "net_margin")


_METRIC_NAMES = [(n, m) for m, n in fundamentals.WIDE.items()]
_ASOF = ", ".join(f"known_{n} AS (SELECT ticker, filed_date, max_by(value, row(period_end, accession_no)) AS v FROM staged WHERE metric = '{m}' GROUP BY 1, 2)" for n, m in _METRIC_NAMES)
_ASOF += ", pit AS (SELECT d.ticker, d.day, " + ", ".join(f"known_{n}.v AS {n}" for n, _ in _METRIC_NAMES) + " FROM daily d " + " ".join(f"ASOF LEFT JOIN known_{n} ON d.ticker = known_{n}.ticker AND d.day >= known_{n}.filed_date" for n, _ in _METRIC_NAMES) + ")"


@query(
    "fundamentals_asof",
    with_("daily", "staged", more=_ASOF) + "SELECT ticker, day, eps_basic, net_income, long_term_debt, shares_outstanding, operating_cash_flow, coalesce(revenue_tag, revenue_fallback) AS revenue FROM pit",
)
def fundamentals_asof(spark, d):
    days = A.daily_bars(spark, d).select("ticker", "day")
    return fundamentals.fundamentals_asof(days, fundamentals.staged(A.edgar_facts(spark, d)))


# --- sentiment --------------------------------------------------------------


@query("news_staged", with_("news") + "SELECT ticker, ts, source, url, sentiment FROM news")
def news_staged(spark, d):
    n = A.news(spark, d)
    return sentiment.staged_news(n.unionByName(n)).select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "source", "url", "sentiment")


@query("sentiment_daily", with_("sent") + "SELECT ticker, day, round(mean_intensity + 1e-7, 6) AS mean_intensity, positive, negative, items FROM sent")
def sentiment_daily(spark, d):
    return rounded(sentiment.sentiment_daily(A.news(spark, d)).drop("intensity_sum"), "mean_intensity")


@query(
    "sentiment_7d",
    with_("sent") + "SELECT ticker, day, round(sum(intensity_sum) OVER w / sum(items) OVER w + 1e-7, 6) AS sentiment_7d, (sum(items) OVER w)::BIGINT AS news_count_7d FROM sent WINDOW w AS (PARTITION BY ticker ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)",
)
def sentiment_7d(spark, d):
    return rounded(sentiment.sentiment_trailing(sentiment.sentiment_daily(A.news(spark, d))), "sentiment_7d")


@query(
    "market_news",
    with_("sent") + f"SELECT s.ticker, s.day, s.items, round(m.mean_intensity + 1e-7, 6) AS market_intensity, m.items AS market_items FROM sent s LEFT JOIN sent m ON m.ticker = '{C.MARKET_KEY}' AND m.day = s.day WHERE s.ticker <> '{C.MARKET_KEY}'",
)
def market_news(spark, d):
    daily = sentiment.sentiment_daily(A.news(spark, d))
    out = sentiment.with_market(daily.where(F.col("ticker") != C.MARKET_KEY).select("ticker", "day", "items"), daily)
    return rounded(out, "market_intensity")


# --- marts ------------------------------------------------------------------

_TECH = ("daily_return", "ma_30d", "ma_90d", "vol_30d", "sharpe_30d")


@query(
    "mart_features",
    with_("technicals", "staged", "sent", more=_ASOF)
    + "SELECT t.ticker, t.day, t.close, "
    + ", ".join(f"round(t.{c} + 1e-7, 6) AS {c}" for c in _TECH)
    + ", p.eps_basic, p.net_income, p.long_term_debt, p.shares_outstanding, p.operating_cash_flow, coalesce(p.revenue_tag, p.revenue_fallback) AS revenue, round(s.mean_intensity + 1e-7, 6) AS mean_intensity, coalesce(s.positive, 0) AS positive, coalesce(s.negative, 0) AS negative "
    + "FROM technicals t JOIN pit p USING (ticker, day) LEFT JOIN sent s USING (ticker, day)",
)
def mart_features(spark, d):
    out = marts.features(A.daily_bars(spark, d), A.edgar_facts(spark, d), A.news(spark, d))
    return rounded(out.drop("open", "high", "low", "volume"), *_TECH, "mean_intensity")


_NEWEST = "newest AS (SELECT * FROM grown QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, base_form) = 1)"
_LAST_TECH = "last_tech AS (SELECT ticker, close AS latest_price, day AS price_date, ma_30d, ma_90d, vol_30d, sharpe_30d FROM technicals QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1)"
_MOOD = "mood AS (SELECT ticker, avg(intensity) AS sentiment_7d, count(*) AS news_count_7d FROM news, (SELECT max(day) AS last_day FROM daily) WHERE ts::DATE > last_day - 7 AND ts::DATE <= last_day GROUP BY 1)"
_MART = (
    f"{_NEWEST}, {_LAST_TECH}, {_MOOD}, mart AS (SELECT c.ticker, company_name, sector, base_form, period_end, eps_basic, revenue, net_income, long_term_debt, shares_outstanding, operating_cash_flow, revenue_growth_qoq, "
    "latest_price, price_date, ma_30d, ma_90d, vol_30d, sharpe_30d, sentiment_7d, coalesce(news_count_7d, 0) AS news_count_7d, latest_price / nullif(eps_basic, 0) AS price_to_earnings, latest_price * shares_outstanding AS market_cap, "
    "long_term_debt / nullif(latest_price * shares_outstanding, 0) AS debt_to_market_cap, net_income / nullif(revenue, 0) AS net_margin "
    "FROM company c LEFT JOIN newest n ON c.ticker = n.ticker LEFT JOIN last_tech t ON c.ticker = t.ticker LEFT JOIN mood m ON c.ticker = m.ticker)"
)


def _mart_sql(select: str) -> str:
    return with_("company", "grown", "technicals", "news", more=_MART) + select


def screener(spark: SparkSession, d: str) -> DataFrame:
    return marts.screener(A.daily_bars(spark, d), A.edgar_facts(spark, d), A.news(spark, d), A.company_meta(spark, d))


@query("mart_screener", _mart_sql("SELECT * REPLACE (round(ma_30d + 1e-7, 6) AS ma_30d, round(ma_90d + 1e-7, 6) AS ma_90d, round(vol_30d + 1e-7, 6) AS vol_30d, round(sharpe_30d + 1e-7, 6) AS sharpe_30d, round(sentiment_7d + 1e-7, 6) AS sentiment_7d) FROM mart"))
def mart_screener(spark, d):
    return rounded(screener(spark, d).drop("cik"), "ma_30d", "ma_90d", "vol_30d", "sharpe_30d", "sentiment_7d")


@query("mart_feature_summary", with_("technicals") + "SELECT ticker, day, round(ma_30d + 1e-7, 6) AS ma_30d, round(vol_30d + 1e-7, 6) AS vol_30d FROM technicals")
def mart_feature_summary(spark, d):
    store = technicals.technicals(A.daily_bars(spark, d))
    return rounded(marts.feature_summary(store, ["ma_30d", "vol_30d"]), "ma_30d", "vol_30d")


@query(
    "training_frame",
    with_("technicals") + "SELECT ticker, day, round(vol_30d + 1e-7, 6) AS vol_30d, round(lead(close, 5) OVER (PARTITION BY ticker ORDER BY day) / close - 1 + 1e-7, 6) AS forward_return_5 FROM technicals QUALIFY lead(close, 5) OVER (PARTITION BY ticker ORDER BY day) IS NOT NULL",
)
def training_frame(spark, d):
    store = technicals.technicals(A.daily_bars(spark, d))
    return rounded(marts.training_frame(store).select("ticker", "day", "vol_30d", "forward_return_5"), "vol_30d", "forward_return_5")


@query(
    "walk_forward_folds",
    with_("daily", more="days AS (SELECT day, ntile(5) OVER (ORDER BY day) AS run FROM (SELECT DISTINCT day FROM daily)), edges AS (SELECT run, min(day) AS test_from, max(day) AS test_until FROM days GROUP BY 1)")
    + "SELECT (e.run - 1)::INT AS fold, p.test_until AS train_until, e.test_from, e.test_until FROM edges e JOIN edges p ON p.run = e.run - 1",
)
def walk_forward_folds(spark, d):
    return technicals.walk_forward_folds(A.daily_bars(spark, d))


# --- analyst questions ------------------------------------------------------


@query("screen_value_growth", _mart_sql(f"SELECT ticker, sector, price_to_earnings, revenue_growth_qoq FROM mart WHERE price_to_earnings < 20 AND revenue_growth_qoq > 0.15::DOUBLE AND sector = '{GROWTH_SECTOR}'"))
def screen_value_growth(spark, d):
    return screens.value_growth(screener(spark, d), GROWTH_SECTOR)


@query("screen_pe_growth", _mart_sql("SELECT ticker, period_end, price_to_earnings, revenue_growth_qoq FROM mart WHERE price_to_earnings < 15 AND revenue_growth_qoq > 0.1::DOUBLE AND period_end >= DATE '1997-01-01'"))
def screen_pe_growth(spark, d):
    return screens.pe_growth(screener(spark, d), SINCE)


@query(
    "sector_beats",
    with_("company", "latest", more=f"eps AS (SELECT ticker, value, lead(value) OVER w AS before, row_number() OVER w AS k FROM latest WHERE metric = '{C.EPS}' AND base_form = '10-Q' WINDOW w AS (PARTITION BY ticker ORDER BY period_end DESC))")
    + "SELECT sector, count(*) AS tickers, count(*) FILTER (WHERE value / nullif(before, 0) - 1 > 0.05::DOUBLE) AS beats, count(*) FILTER (WHERE value / nullif(before, 0) - 1 > 0.05::DOUBLE)::DOUBLE / count(*) AS beat_share FROM eps JOIN company USING (ticker) WHERE k = 1 GROUP BY 1",
)
def sector_beats(spark, d):
    latest = fundamentals.latest_facts(fundamentals.staged(A.edgar_facts(spark, d)))
    return screens.sector_beats(latest, A.company_meta(spark, d).drop("cik"))


@query(
    "risk_flags",
    _mart_sql(
        "SELECT ticker, debt_to_market_cap, operating_cash_flow, coalesce(debt_to_market_cap > 1, false) AS high_leverage, coalesce(operating_cash_flow < 0, false) AS negative_cash_flow, coalesce(debt_to_market_cap > 1, false) AND coalesce(operating_cash_flow < 0, false) AS flagged FROM mart"
    ),
)
def risk_flags(spark, d):
    return screens.risk_flags(screener(spark, d))


@query("screen_small_profitable", _mart_sql(f"SELECT ticker, sector, net_income, market_cap FROM mart WHERE net_income > 0 AND market_cap < 1e10 AND sector = '{PROFIT_SECTOR}'"))
def screen_small_profitable(spark, d):
    return screens.small_profitable(screener(spark, d), PROFIT_SECTOR)


@query("top_sharpe", _mart_sql("SELECT ticker, round(sharpe_30d + 1e-7, 6) AS sharpe_30d FROM mart WHERE sharpe_30d IS NOT NULL ORDER BY mart.sharpe_30d DESC, ticker LIMIT 10"))
def top_sharpe(spark, d):
    return rounded(screens.top_sharpe(screener(spark, d)), "sharpe_30d")


@query("screen_margin", _mart_sql(f"SELECT ticker, sector, price_to_earnings, net_margin FROM mart WHERE price_to_earnings < 15 AND net_margin > 0.2::DOUBLE AND sector = '{PROFIT_SECTOR}'"))
def screen_margin(spark, d):
    return screens.margin(screener(spark, d), PROFIT_SECTOR)


@query(
    "peers",
    _mart_sql(
        "SELECT ticker, company_name, period_end, eps_basic, revenue, net_income, price_to_earnings, market_cap, net_margin, latest_price, round(ma_30d + 1e-7, 6) AS ma_30d, round(ma_90d + 1e-7, 6) AS ma_90d, round(sharpe_30d + 1e-7, 6) AS sharpe_30d FROM mart WHERE ticker IN ('T01', 'T05', 'T09')"
    ),
)
def peers(spark, d):
    return rounded(screens.peers(screener(spark, d), ["T01", "T05", "T09"]), "ma_30d", "ma_90d", "sharpe_30d")


@query(
    "negative_spikes",
    with_("sent", more=f"trail AS (SELECT ticker, day, negative, avg(negative) OVER (PARTITION BY ticker ORDER BY day RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS trailing_mean FROM sent WHERE ticker <> '{C.MARKET_KEY}')")
    + f"SELECT ticker, day, negative, round(trailing_mean + 1e-7, 6) AS trailing_mean FROM trail WHERE day > DATE '{WEEK_END}' - 7 AND day <= DATE '{WEEK_END}' AND negative > 1.5 * trailing_mean",
)
def negative_spikes(spark, d):
    return rounded(sentiment.negative_spikes(sentiment.sentiment_daily(A.news(spark, d)), WEEK_END), "trailing_mean")


@query("sector_perf", _mart_sql("SELECT sector, count(*) AS tickers, round(avg(price_to_earnings) + 1e-7, 6) AS avg_pe, round(avg(net_margin) + 1e-7, 6) AS avg_margin, round(avg(sharpe_30d) + 1e-7, 6) AS avg_sharpe, round(sum(market_cap), 0) AS total_cap FROM mart GROUP BY 1"))
def sector_perf(spark, d):
    return rounded(screens.sector_performance(screener(spark, d)), "avg_pe", "avg_margin", "avg_sharpe").withColumn("total_cap", F.round("total_cap", 0))


@query(
    "ticker_fundamentals",
    with_("grown") + "SELECT ticker, period_end, base_form, eps_basic, revenue, net_income, long_term_debt, shares_outstanding, operating_cash_flow FROM grown WHERE ticker = 'T03' ORDER BY period_end DESC, base_form LIMIT 4",
)
def ticker_fundamentals(spark, d):
    return screens.ticker_fundamentals(_wide_facts(spark, d), "T03")
