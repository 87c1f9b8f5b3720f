"""Queries of the streaming, source and model operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.config import BarConfig
from marketweave.operators import bars, ingest, ml, technicals
from marketweave.plans import adapters as A
from marketweave.plans import marts, serve
from marketweave.plans.adapters import with_
from marketweave.plans.queries import END, SYMBOLS, _mart_sql, query, rounded, screener
from marketweave.schemas import OHLCV
from marketweave.sources import filings, topics, universe
from marketweave.sources.bars import StoredBarSource
from marketweave.sources.files import scratch_path
from marketweave.streaming import flows

ML_FEATURES = ("daily_return", "ma_30d", "ma_90d", "vol_30d", "sharpe_30d")


def _replay(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """A file stream of rows."""
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drain(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there, into Parquet, and read that."""
    out, checkpoint = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-check")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(
    "stream_minute_bars",
    with_("minutes") + "SELECT ticker, minute AS ts, open, high, low, close, volume FROM minutes WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def stream_minute_bars(spark, d):
    """Closed one-minute windows of the replayed ticks."""
    return _ntz(_drain(spark, flows.minute_bars(_replay(spark, A.ticks(spark, d), "ticks")), "minute"), "ts")


@query("stream_dedup", "SELECT event_id, user_id, ts FROM events")
def stream_dedup(spark, d):
    """Every message delivered twice."""
    e = A.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _ntz(_drain(spark, flows.deduplicated(_replay(spark, e.unionByName(e), "twice"), ["event_id"]), "dedup"), "ts")


@query("stream_landing", with_("news") + "SELECT source, url, ts, ticker FROM news")
def stream_landing(spark, d):
    """The same topic replayed into one table twice."""
    rows = A.news(spark, d).select("source", "url", "ts", "ticker")
    path = scratch_path(spark, "landed")
    for k in range(2):
        flows.land(_replay(spark, rows, f"news{k}"), path, ["source", "url", "ts"], scratch_path(spark, f"land{k}")).awaitTermination()
    return _ntz(spark.read.parquet(path).drop("_day"), "ts")


@query(
    "stream_rolling",
    with_("minutes")
    + "SELECT ticker, minute AS ts, close, round(r + 1e-7, 6) AS daily_return, round(avg(close) OVER w + 1e-7, 6) AS ma, round(stddev_samp(r) OVER w + 1e-7, 6) AS vol, count(*) OVER w AS n FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY minute), 0) - 1 AS r FROM minutes) WINDOW w AS (PARTITION BY ticker ORDER BY minute ROWS 29 PRECEDING)",
)
def stream_rolling(spark, d):
    """Stateful rolling features, held against batch windows."""
    minutes = bars.minute_bars(A.ticks(spark, d)).select("ticker", "ts", "close")
    out = _drain(spark, flows.rolling_features(_replay(spark, minutes, "bars")), "rolling")
    return rounded(_ntz(out.withColumn("n", F.col("n").cast("long")), "ts"), "daily_return", "ma", "vol")


def _join_sql() -> str:
    return (
        with_("minutes", "news")
        + "SELECT m.ticker, m.minute AS ts, n.ts AS news_ts, n.sentiment FROM minutes m JOIN news n ON n.ticker = m.ticker AND n.ts + INTERVAL 8122 DAY <= m.minute AND n.ts + INTERVAL 8122 DAY > m.minute - INTERVAL 30 MINUTE"
    )


@query("stream_interval_join", _join_sql())
def stream_interval_join(spark, d):
    """Bars joined with the news of the half hour before them, both as streams."""
    minutes = bars.minute_bars(A.ticks(spark, d)).select("ticker", "ts", "close")
    shift = F.expr(f"INTERVAL {A.NEWS_SHIFT_DAYS} DAYS")
    news = A.news(spark, d).withColumn("ts", F.col("ts") + shift).select("ticker", "ts", "sentiment", "intensity")
    out = _drain(spark, flows.with_sentiment(_replay(spark, minutes, "jbars"), _replay(spark, news, "jnews")), "join")
    return _ntz(out.select("ticker", "ts", (F.col("news_ts") - shift).alias("news_ts"), "sentiment"), "ts", "news_ts")


@query(
    "stream_sliding",
    with_("news")
    + "SELECT ticker, w AS from_ts, w + INTERVAL 7 DAY AS to_ts, round(avg(intensity) + 1e-7, 6) AS mean_intensity, count(*) AS items FROM (SELECT ticker, intensity, unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS w FROM news) GROUP BY 1, 2 HAVING w + INTERVAL 7 DAY <= (SELECT max(ts) FROM news) - INTERVAL 10 MINUTE",
)
def stream_sliding(spark, d):
    """Sliding weekly windows of news, closed ones only."""
    rows = A.news(spark, d).select("ticker", "ts", "intensity")
    return rounded(_ntz(_drain(spark, flows.sliding_sentiment(_replay(spark, rows, "slide")), "sliding"), "from_ts", "to_ts"), "mean_intensity")


@query(
    "score_ticker",
    with_("minutes")
    + ", r AS (SELECT ticker, minute AS ts, close, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY minute), 0) - 1 AS daily_return FROM minutes), "
    + "s AS (SELECT ticker, ts, close - avg(close) OVER w AS score, coalesce(daily_return, 0) AS a, coalesce(stddev_samp(daily_return) OVER w, 0) AS b FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 29 PRECEDING)) "
    + "SELECT ticker, ts, CASE WHEN score > 50 THEN 'buy' WHEN score < -50 THEN 'sell' ELSE 'hold' END AS signal, round(score + 1e-7, 6) AS score, 'momentum-1' AS model_version, CASE WHEN b >= abs(a) THEN 'vol' ELSE 'daily_return' END AS first_feature, "
    + "round(CASE WHEN b >= abs(a) THEN b ELSE a END + 1e-7, 6) AS first_value, round(CASE WHEN b >= abs(a) THEN a ELSE b END + 1e-7, 6) AS second_value FROM s WHERE ticker = 'T05'",
)
def score_ticker(spark, d):
    """The decision stream of one ticker, scored by momentum over rolling state."""
    minutes = bars.minute_bars(A.ticks(spark, d)).select("ticker", "ts", "close")
    path = scratch_path(spark, "decisions")
    rolling = spark.read.parquet(_parquet(spark, _drain(spark, flows.rolling_features(_replay(spark, minutes, "sbars")), "score"), "rolled"))
    score = lambda df: df.withColumn("score", F.col("close") - F.col("ma"))
    flows.decisions(_replay(spark, rolling, "rolled2"), score, path, scratch_path(spark, "dec"), sigma=100.0, threshold=0.5, version="momentum-1", attributions=["daily_return", "vol"]).awaitTermination()
    made = spark.read.parquet(path).where("ticker = 'T05'")
    value = lambda k: F.get(F.map_values("top_features"), k)
    out = made.select("ticker", "ts", "signal", "score", "model_version", F.get(F.map_keys("top_features"), 0).alias("first_feature"), value(0).alias("first_value"), value(1).alias("second_value"))
    return rounded(_ntz(out, "ts"), "score", "first_value", "second_value")


def _parquet(spark: SparkSession, df: DataFrame, label: str) -> str:
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return path


@query("topic_round_trip", with_("minutes") + "SELECT ticker, minute AS ts, open, high, low, close, volume FROM minutes")
def topic_round_trip(spark, d):
    """Bars as JSON messages and back."""
    folder = scratch_path(spark, "topic")
    topics.publish(bars.minute_bars(A.ticks(spark, d)), topics.BARS, folder)
    return _ntz(topics.decode(spark.read.schema("key STRING, value STRING").json(folder), topics.BARS).drop("_ingested_at"), "ts")


@query("ingest_run", with_("daily") + f"SELECT ticker AS symbol, day AS date, close AS \"Close\", DATE '{END}' AS end_date FROM daily WHERE day >= DATE '2000-01-01' AND day < DATE '{END}'")
def ingest_run(spark, d):
    """The bar pipeline end to end: plan, scan, stamp, write, resume (the second run finds nothing new)."""
    stored = _parquet(spark, OHLCV.validate(A.landed_bars(spark, d)), "vendor")
    config = BarConfig.load(env={}, sleep_seconds=0)
    sink = ingest.TableSink(scratch_path(spark, "warehouse"))
    source, state = StoredBarSource(spark, stored, config), ingest.LandingState(spark, sink.path(config.table))
    for _ in range(2):
        ingest.BarPipeline(spark, source, state, sink, config, sleep=lambda s: None).run(SYMBOLS, END)
    return spark.read.parquet(sink.path(config.table)).select("symbol", "date", "Close", F.lit(END).alias("end_date"))


@query("universe_html", with_("company") + "SELECT (row_number() OVER (ORDER BY ticker) - 1)::INT AS pos, ticker AS symbol FROM company")
def universe_html(spark, d):
    """The constituents page, built of the companies (25 rows)."""
    rows = A.company_meta(spark, d).orderBy("ticker").collect()
    cells = "".join(f"<tr><td><a>{r.ticker}</a></td><td>{r.company_name}</td></tr>" for r in rows)
    return universe.parse_constituents(spark, f"<html><table><tr><th>Symbol</th><th>Security</th></tr>{cells}</table></html>")


@query("filing_sections", with_("facts") + "SELECT accession_no, '1' AS item, 'Business ' || metric AS section FROM facts WHERE form_type = '10-K' UNION ALL SELECT accession_no, '1A', 'Risk ' || cik FROM facts WHERE form_type = '10-K'")
def filing_sections(spark, d):
    f = A.edgar_facts(spark, d).where("form_type = '10-K'")
    text = F.concat(F.lit("Annual report\nItem 1. Business "), F.col("metric"), F.lit("\nITEM 1A. Risk "), F.col("cik"), F.lit("\n"))
    return filings.filing_sections(f.select("accession_no", text.alias("text"))).select("accession_no", "item", "section")


@query("latest_filing", with_("facts") + "SELECT cik, accession_no, filed_date FROM facts WHERE split_part(form_type, '/', 1) = '10-K' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filed_date DESC, accession_no DESC) = 1")
def latest_filing(spark, d):
    return filings.latest_filing(A.edgar_facts(spark, d).select("cik", "form_type", "filed_date", "accession_no")).select("cik", "accession_no", "filed_date")


@query("guarded_sql", _mart_sql("SELECT ticker, sector, price_to_earnings, debt_to_market_cap, net_income FROM mart WHERE price_to_earnings < 15 AND debt_to_market_cap > 0.5::DOUBLE ORDER BY ticker LIMIT 50"))
def guarded_sql(spark, d):
    """A question's template SQL, run behind the guard on the screener."""
    screener(spark, d).createOrReplaceTempView("mart_stock_screener")
    found = serve.run_guarded(spark, serve.template_sql("P/E under 15 and debt-to-market-cap above 0.5") or "")
    return found.select("ticker", "sector", "price_to_earnings", "debt_to_market_cap", "net_income")


def _training(spark: SparkSession, d: str) -> DataFrame:
    store = technicals.technicals(A.daily_bars(spark, d))
    return marts.training_frame(store).select("ticker", "day", *ML_FEATURES, "forward_return_5")


def _ranking(rows: DataFrame) -> DataFrame:
    """Rows (feature, mean_abs): a model for each walk-forward fold, exact attributions on its test days, averaged over the folds."""
    found = None
    for fold in technicals.walk_forward_folds(rows).orderBy("fold").collect():  # a few folds
        train, test = technicals.split_fold(rows, fold.train_until, fold.test_from, fold.test_until)
        summary = ml.shap_summary(ml.attributions(test, ml.train_gbt(train, ML_FEATURES, "forward_return_5"), ML_FEATURES), ML_FEATURES)
        found = summary if found is None else found.unionByName(summary)
    return found.groupBy("feature").agg(F.avg("mean_abs").alias("mean_abs"))


@query("shap_ranking")
def shap_ranking(spark, d):
    """The features ranked over all walk-forward folds."""
    return _ranking(_training(spark, d))


@query("selected_features")
def selected_features(spark, d):
    """The store cut to the features that the ranking selects, with the predictions of a model retrained on these alone."""
    rows = _training(spark, d)
    selected = ml.select_features(_ranking(rows), 3)
    model = ml.train_gbt(rows, selected, "forward_return_5")
    scored = model.transform(ml.filled(marts.feature_summary(rows, selected), selected))
    return scored.select("ticker", "day", *selected, "prediction")


@query("sentiment_model")
def sentiment_model(spark, d):
    """News labelled by a model that learned from all labelled items."""
    news = A.news(spark, d)
    model = ml.train_sentiment(news)
    return ml.score_sentiment(news.select("url", "headline", "sentiment"), model).select("url", "sentiment", "predicted_sentiment")
