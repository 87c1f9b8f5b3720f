from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketweave.errors import PermanentError, SchemaMismatchError
from marketweave.functions import columns as C
from marketweave.operators import bars, checks, fundamentals, reshape, sentiment, technicals
from marketweave.plans import marts, screens, serve
from marketweave.sources import filings

D0 = date(2024, 1, 1)


def day(k):
    return D0 + timedelta(days=k)


def closes(spark, values, ticker="A"):
    return spark.createDataFrame([(ticker, day(k), float(v)) for k, v in enumerate(values)], "ticker string, day date, close double")


# --- reshape ----------------------------------------------------------------


def test_wide_frame_to_tidy(spark):
    wide = spark.createDataFrame([(day(0), 1.0, 2.0, 3.0, float("nan")), (day(1), None, 5.0, None, 7.0)], "date date, `Close|A` double, `Close|B` double, `Open|A` double, `Open|B` double")
    long = reshape.wide_to_long(wide)
    assert long.count() == 8 and long.columns == ["date", "symbol", "field", "value"]
    out = {(r.date, r.symbol): (r.Close, r.Open) for r in reshape.long_to_tidy(long, ["Close", "Open"]).collect()}
    assert out == {(day(0), "A"): (1.0, 3.0), (day(0), "B"): (2.0, None), (day(1), "B"): (5.0, 7.0)}


def test_mean_of_repeats_and_missing_field(spark):
    long = spark.createDataFrame([(day(0), "A", "Close", 1.0), (day(0), "A", "Close", 3.0), (day(0), "A", "Open", None)], "date date, symbol string, field string, value double")
    assert tuple(reshape.long_to_tidy(long, ["Close", "Open"]).first()) == (day(0), "A", 2.0, None)
    with pytest.raises(SchemaMismatchError, match="Open"):
        reshape.long_to_tidy(long, ["Close", "Open"], strict=True)


# --- bars and technicals ----------------------------------------------------


def test_bars_first_last(spark):
    t = spark.createDataFrame([("A", datetime(2024, 1, 1, 9, 0, s), p) for s, p in ((30, 5.0), (1, 2.0), (59, 4.0), (20, 9.0))], "ticker string, ts timestamp, price double")
    minutes = bars.minute_bars(t)
    assert tuple(minutes.first())[2:] == (2.0, 9.0, 2.0, 4.0, 4)
    assert tuple(bars.minute_to_daily(minutes).first()) == ("A", date(2024, 1, 1), 2.0, 9.0, 2.0, 4.0, 4)
    dirty = spark.createDataFrame([(1.0, 0), (None, 5), (2.0, 3)], "close double, volume int")
    assert bars.clean_bars(dirty).count() == 1


def test_one_row_constant_and_zero_prices(spark):
    one = technicals.technicals(closes(spark, [5.0])).first()
    assert one.daily_return is None and one.vol_30d is None and one.sharpe_30d is None and one.ma_30d == 5.0
    flat = technicals.technicals(closes(spark, [5.0] * 4)).orderBy("day").collect()[-1]
    assert flat.vol_30d == 0.0 and flat.sharpe_30d is None
    zero = technicals.daily_return(closes(spark, [0.0, 1.0])).orderBy("day").collect()[-1]
    assert zero.daily_return is None


def test_rolling_frames_by_hand(spark):
    values = [10 + (k * 7) % 5 + k / 10 for k in range(100)]
    out = technicals.technicals(closes(spark, values)).orderBy("day").collect()
    returns = [b / a - 1 for a, b in zip(values, values[1:])]
    last = returns[-30:]
    mean = sum(last) / 30
    vol = (sum((r - mean) ** 2 for r in last) / 29) ** 0.5
    assert out[-1].ma_30d == pytest.approx(sum(values[-30:]) / 30) and out[-1].ma_90d == pytest.approx(sum(values[-90:]) / 90)
    assert out[-1].vol_30d == pytest.approx(vol) and out[-1].sharpe_30d == pytest.approx((mean - 0.045 / 252) / vol * 252**0.5)
    strict = technicals.moving_average(closes(spark, values), 30, min_periods=30).orderBy("day").collect()
    assert strict[28].ma_30d is None and strict[29].ma_30d is not None


def test_technicals_take_one_exchange(spark):
    plan = technicals.technicals(closes(spark, range(1, 50)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_forward_return_latest_and_folds(spark):
    c = closes(spark, [1, 2, 4, 8, 16, 32])
    out = technicals.forward_return(c, [1, 5]).orderBy("day").collect()
    assert out[0].forward_return_1 == 1.0 and out[0].forward_return_5 == 31.0 and out[-1].forward_return_1 is None
    assert [r.close for r in technicals.latest(c, 2).orderBy("day").collect()] == [16.0, 32.0]
    for f in technicals.walk_forward_folds(c, 2).collect():
        train, test = technicals.split_fold(c, f.train_until, f.test_from, f.test_until)
        assert train.agg(F.max("day")).first()[0] < test.agg(F.min("day")).first()[0]


# --- fundamentals -----------------------------------------------------------


def facts(spark, rows):
    return spark.createDataFrame([("A", "0000000001", *r) for r in rows], "ticker string, cik string, metric string, value double, period_end date, filed_date date, form_type string, accession_no string")


def test_point_in_time_sees_the_original_before_the_amendment(spark):
    f = facts(spark, [(C.EPS, 1.0, day(0), day(10), "10-Q", "a1"), (C.EPS, 2.0, day(0), day(20), "10-Q/A", "a2"), (C.REVENUE_FALLBACK, 9.0, day(0), day(10), "10-Q", "a1")])
    days = spark.createDataFrame([("A", day(k)) for k in (9, 10, 15, 20, 25)] + [("B", day(15))], "ticker string, day date")
    out = {(r.ticker, r.day): (r.eps_basic, r.revenue) for r in fundamentals.fundamentals_asof(days, f).collect()}
    assert out == {("A", day(9)): (None, None), ("A", day(10)): (1.0, 9.0), ("A", day(15)): (1.0, 9.0), ("A", day(20)): (2.0, 9.0), ("A", day(25)): (2.0, 9.0), ("B", day(15)): (None, None)}
    later = facts(spark, [(C.EPS, 5.0, day(50), day(60), "10-Q", "b"), (C.EPS, 4.0, day(40), day(60), "10-Q", "c")])
    assert fundamentals.fundamentals_asof(days.limit(1).withColumn("day", F.lit(day(60))), later).first().eps_basic == 5.0


def test_latest_filing_breaks_ties_by_accession(spark):
    f = facts(spark, [(C.EPS, 1.0, day(0), day(10), "10-Q", "a1"), (C.EPS, 2.0, day(0), day(10), "10-Q", "a2"), (C.EPS, 3.0, day(0), day(5), "10-Q", "a9"), (C.EPS, 7.0, day(0), day(99), "S-1", "z")])
    assert [r.value for r in fundamentals.latest_facts(fundamentals.staged(f)).collect()] == [2.0]


@pytest.mark.parametrize(("tags", "want"), [([C.REVENUE], 1.0), ([C.REVENUE_FALLBACK], 2.0), ([C.REVENUE, C.REVENUE_FALLBACK], 1.0), ([C.EPS], None)])
def test_revenue_fallback(spark, tags, want):
    value = {C.REVENUE: 1.0, C.REVENUE_FALLBACK: 2.0, C.EPS: 3.0}
    f = fundamentals.staged(facts(spark, [(t, value[t], day(0), day(1), "10-Q", "a") for t in tags]))
    assert fundamentals.pivot_metrics(f, ["ticker", "cik", "base_form", "period_end"]).first().revenue == want


def test_growth_never_mixes_forms(spark):
    rows = [(C.REVENUE, v, p, day(1), form, "a") for v, p, form in ((100.0, date(2023, 3, 31), "10-Q"), (400.0, date(2023, 6, 30), "10-K"), (120.0, date(2023, 9, 30), "10-Q/A"), (0.0, date(2023, 12, 31), "10-Q"), (5.0, date(2024, 3, 31), "10-Q"))]
    wide = fundamentals.pivot_metrics(fundamentals.staged(facts(spark, rows)), ["ticker", "cik", "base_form", "period_end"])
    out = {r.period_end: (r.revenue_growth_qoq, r.gap_quarters) for r in fundamentals.growth_qoq(wide).collect()}
    assert out[date(2023, 9, 30)] == (pytest.approx(0.2), 2) and out[date(2023, 6, 30)] == (None, None)
    assert out[date(2023, 12, 31)] == (-1.0, 1) and out[date(2024, 3, 31)][0] is None


def test_ratios_and_zero_denominators(spark):
    df = spark.createDataFrame([(10.0, 2.0, 5.0, 25.0, 3.0, 6.0), (10.0, 0.0, 0.0, 25.0, 3.0, 0.0)], "latest_price double, eps_basic double, shares_outstanding double, long_term_debt double, net_income double, revenue double")
    a, b = fundamentals.ratios(df).orderBy(F.col("eps_basic").desc()).collect()
    assert (a.price_to_earnings, a.market_cap, a.debt_to_market_cap, a.net_margin) == (5.0, 50.0, 0.5, 0.5)
    assert (b.price_to_earnings, b.market_cap, b.debt_to_market_cap, b.net_margin) == (None, 0.0, None, None)


# --- filings ----------------------------------------------------------------

INDEX = ["Description: daily index", "", "CIK|Company Name|Form Type|Date Filed|Filename", "-----", '320193|APPLE "A" INC|10-Q|20240102|edgar/data/1.htm', "77|OTHER|10-K/A|20240103| edgar/data/2.htm ", "78|ODD|S-1|20240103|x", "12345678901|LONG|8-K|20240103|y"]


def test_index_text(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in INDEX], "value string")
    out = {r.cik: r for r in filings.parse_index(lines).collect()}
    assert set(out) == {"0000320193", "0000000077", "12345678901"}
    apple = out["0000320193"]
    assert apple.company_name == 'APPLE "A" INC' and apple.date_filed == date(2024, 1, 2) and apple.full_url == "https://www.sec.gov/edgar/data/1.htm"
    assert {r.form_type for r in filings.parse_index(lines, amendments=False).collect()} == {"10-Q", "8-K"}
    (tmp_path / "master.20240102.idx").write_text("\n".join(INDEX))
    got = filings.read_index_files(spark, f"file://{tmp_path}", date(2024, 1, 1), date(2024, 1, 5))
    assert got.count() == 3 and filings.read_index_files(spark, f"file://{tmp_path}", date(2025, 1, 1), date(2025, 1, 5)).count() == 0
    members = spark.createDataFrame([(320193,)], "cik int")
    assert filings.new_filers(got, members, date(2024, 1, 1), date(2024, 1, 2)).count() == 1
    assert filings.new_filers(got, None, date(2024, 1, 3), date(2024, 1, 3)).count() == 2
    assert [r.day.weekday() for r in filings.index_days(spark, date(2024, 1, 5), date(2024, 1, 8)).collect()] == [4, 0]
    assert filings.index_days(spark, date(2024, 1, 5), date(2024, 1, 4)).count() == 0


def test_facts_document(spark):
    doc = """{"cik": 5, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "2024-03-31", "start": "2024-01-01", "val": 1, "filed": "2024-05-01", "form": "10-Q", "accn": "a"},
      {"end": "2024-03-31", "start": "2023-07-01", "val": 9, "filed": "2024-05-01", "form": "10-Q", "accn": "a"}]}}, "NetCashProvidedByUsedInOperatingActivities": {"units": {"USD": [{"end": "2024-03-31", "val": 2, "filed": "2024-05-01", "form": "10-Q", "accn": "a"}]}},
      "EntityCommonStockSharesOutstanding": {"units": {"shares": [{"end": "2024-03-31", "val": 3, "filed": "2024-05-01", "form": "10-Q", "accn": "wrong"}]}}, "Unknown": {"units": {"USD": [{"end": "2024-03-31", "val": 2, "filed": "2024-05-01", "form": "10-Q", "accn": "a"}]}}},
      "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [{"end": "2024-03-31", "val": 4, "filed": "2024-04-01", "form": "10-Q", "accn": "a"}]}}}}}"""
    rows = filings.parse_facts(spark.createDataFrame([(doc,), ("nonsense",)], "value string"))
    out = {r.metric: r.value for r in filings.metric_facts(rows).collect()}
    assert out == {C.REVENUE: 1.0, C.CASH_FLOW: 2.0, C.SHARES: 4.0}
    assert {r.metric for r in filings.metric_facts(rows, date(2024, 4, 15)).collect()} == {C.REVENUE, C.CASH_FLOW}


def test_sections_and_latest(spark):
    text = "Cover\nItem 1. Business\nWe make things.\nITEM 1A. Risk\nMany."
    f = spark.createDataFrame([("1", "10-K", day(0), "a", "old"), ("1", "10-K/A", day(9), "b", text), ("1", "10-Q", day(20), "c", "q")], "cik string, form_type string, filed_date date, accession_no string, text string")
    newest = filings.latest_filing(f)
    assert newest.first().accession_no == "b"
    assert {r.item: r.section for r in filings.filing_sections(newest).collect()} == {"1": "Business\nWe make things.", "1A": "Risk\nMany."}


def test_agents_and_ciks(spark):
    assert C.valid_user_agent("Some One one@site.org") and not any(C.valid_user_agent(x) for x in (None, "", "curl", "Name your@email.com", "<you> a@b.c"))
    row = spark.range(1).select(C.pad_cik(F.lit(" 42 ")), C.prefixed_cik(F.lit(42)), C.pad_cik(F.lit("12345678901")), C.index_url(F.lit(date(2026, 6, 30))), C.safe_upper(F.lit(day(5)))).first()
    assert tuple(row) == ("0000000042", "CIK0000000042", "12345678901", "https://www.sec.gov/Archives/edgar/daily-index/2026/QTR2/master.20260630.idx", day(3))


# --- sentiment, checks ------------------------------------------------------


def items(spark, rows):
    return spark.createDataFrame([(t, datetime(2024, 1, 1 + d, 5), "s", f"u{k}", lab, i) for k, (t, d, lab, i) in enumerate(rows)], "ticker string, ts timestamp, source string, url string, sentiment string, intensity double")


def test_trailing_week_bounds_and_market(spark):
    n = items(spark, [("A", 0, "positive", 1.0), ("A", 6, "negative", 0.5), ("A", 7, "neutral", 0.0), (C.MARKET_KEY, 6, "neutral", 0.25)])
    daily = sentiment.sentiment_daily(sentiment.staged_news(n.unionByName(n)))
    out = {(r.ticker, r.day): (r.sentiment_7d, r.news_count_7d) for r in sentiment.sentiment_trailing(daily).collect()}
    assert out["A", day(6)] == (0.75, 2) and out["A", day(7)] == (0.25, 2)
    assert sentiment.sentiment_as_of(n, day(7)).where("ticker = 'A'").first().news_count_7d == 2
    market = {r.day: r.market_items for r in sentiment.with_market(daily.where("ticker = 'A'"), daily).collect()}
    assert market == {day(0): None, day(6): 1, day(7): None}


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, -1.0)], "k int, v double")
    out = checks.failures(df, {"present": checks.not_null(["v"]), "positive": F.col("v") > 0}).unionByName(checks.repeated_keys(df, ["k"], "unique")).unionByName(checks.unknown_values(df, df.where("k = 1"), "k", "known"))
    assert {r.rule: r.failures for r in out.collect()} == {"present": 1, "positive": 2, "unique": 1, "known": 1}
    rec = {r.k: (r.left_rows, r.right_rows, r.matches) for r in checks.reconcile(df, df.where("v is not null"), ["k"]).collect()}
    assert rec == {1: (2, 1, False), 2: (1, 1, True)}


# --- marts and serving ------------------------------------------------------


@pytest.fixture
def mart(spark):
    c = closes(spark, [10, 11, 12], "A").unionByName(closes(spark, [5, 4, 3], "B")).withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0)})
    f = facts(spark, [(m, v, date(2023, 9, 30), date(2023, 11, 1), "10-Q", "a") for m, v in ((C.EPS, 2.0), (C.REVENUE, 100.0), (C.NET_INCOME, 30.0), (C.SHARES, 7.0))] + [(C.REVENUE, 130.0, date(2023, 12, 31), date(2024, 1, 2), "10-Q", "b"), (C.EPS, 3.0, date(2023, 12, 31), date(2024, 1, 2), "10-Q", "b")])
    companies = spark.createDataFrame([("A", "1", "Alpha", "tech"), ("B", "2", "Beta", "food")], "ticker string, cik string, company_name string, sector string")
    n = items(spark, [("A", 1, "positive", 0.5)])
    out = marts.screener(c, f, n, companies)
    marts.features(c, f, n).createOrReplaceTempView("mart_features")
    out.createOrReplaceTempView("mart_stock_screener")
    return out


def test_screener_and_screens(mart):
    rows = {r.ticker: r for r in mart.collect()}
    a, b = rows["A"], rows["B"]
    assert a.period_end == date(2023, 12, 31) and a.price_to_earnings == 4.0 and a.revenue_growth_qoq == pytest.approx(0.3) and a.news_count_7d == 1 and a.sentiment_7d == 0.5
    assert b.period_end is None and b.latest_price == 3.0 and b.news_count_7d == 0
    assert [r.ticker for r in screens.value_growth(mart, "tech").collect()] == ["A"] and screens.value_growth(mart, "food").count() == 0
    assert screens.pe_growth(mart, date(2024, 1, 1)).count() == 0 and screens.peers(mart, ["A", "Z"]).count() == 1
    assert {r.sector: r.tickers for r in screens.sector_performance(mart).collect()} == {"tech": 1, "food": 1}
    assert screens.top_sharpe(mart, 1).count() == 1


def test_features_see_no_future(spark, mart):
    rows = {(r.ticker, r.day): (r.revenue, r.positive) for r in spark.table("mart_features").collect()}
    assert rows["A", day(0)] == (100.0, 0) and rows["A", day(1)] == (130.0, 1)
    with pytest.raises(ValueError):
        marts.feature_summary(spark.table("mart_features"), ["nope"])


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT ticker FROM mart_stock_screener",
        "WITH x AS (SELECT * FROM mart_features) SELECT count(*) FROM x JOIN mart_stock_screener USING (ticker) WHERE x.close > (SELECT avg(close) FROM mart_features)",
        "SELECT ticker FROM mart_stock_screener WHERE ticker IN (SELECT ticker FROM mart_features) UNION SELECT 'x' ORDER BY 1 LIMIT 3",
        "SELECT sector, avg(net_margin) m FROM mart_stock_screener GROUP BY sector HAVING count(*) > 0",
        "SELECT ticker, row_number() OVER (ORDER BY ticker) FROM mart_stock_screener",
    ],
)
def test_guard_lets_selects_through(spark, mart, sql):
    serve.run_guarded(spark, sql).collect()


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE mart_stock_screener",
        "SELECT * FROM customers",
        "SELECT * FROM parquet.`/etc`",
        "SELECT 1; SELECT 2",
        "INSERT INTO mart_features SELECT * FROM mart_features",
        "SELECT (SELECT max(x) FROM secret) FROM mart_features",
        "SELECT * FROM mart_features WHERE EXISTS (SELECT 1 FROM secret)",
        "WITH secret AS (SELECT * FROM hidden) SELECT * FROM secret",
        "SELECT reflect('java.lang.System', 'exit', 1) FROM mart_features",
        "SELECT * FROM range(5)",
        "CREATE TABLE x AS SELECT 1",
        "SET spark.sql.ansi.enabled=false",
        "not sql",
    ],
)
def test_guard_refuses(spark, mart, sql):
    with pytest.raises(PermanentError):
        serve.run_guarded(spark, sql)


def test_questions(spark, mart):
    out = serve.screen_stocks(spark, "Which profitable tickers have P/E under 15 and growth above 10%?")
    assert "| A |" not in out.splitlines()[0] and "ticker" in out.splitlines()[0] and len(out.splitlines()) == 2
    assert "| A " in serve.screen_stocks(spark, "P/E below 15 and growth over 10%")
    assert serve.template_sql("companies under $10B with margin above 20%").count("market_cap < 10000000000.0") == 1
    assert "| 2 |" in serve.screen_stocks(spark, "anything", lambda q: "SELECT count(*) AS n FROM mart_stock_screener")
    with pytest.raises(PermanentError):
        serve.screen_stocks(spark, "hello")
    with pytest.raises(PermanentError):
        serve.screen_stocks(spark, "x", lambda q: "DROP TABLE x")
    assert serve.fundamentals_of(spark, "A' OR '1'='1").count() == 0 and serve.fundamentals_of(spark, "A").count() == 1
    assert serve.compare(spark, ["A", "B"]).count() == 2
    assert serve.sector(spark, "tech").count() == 1 and serve.sector(spark).count() == 2
