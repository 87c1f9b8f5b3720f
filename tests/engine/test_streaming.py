import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketweave.errors import PermanentError
from marketweave.operators import bars, technicals
from marketweave.schemas import MARKET_1M
from marketweave.sources import topics
from marketweave.streaming import flows

START = datetime(2024, 1, 2, 15, 0)


def ticks(spark, n=240):
    rows = [(f"T{k % 2}", START + timedelta(seconds=17 * k), 100.0 + (k * 7) % 13) for k in range(n)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, price double")


def stream_of(spark, df, folder, files=3):
    """A stream of files that arrive in the order of their times."""
    times = sorted({r.ts for r in df.select("ts").collect()})
    edges = [times[k * len(times) // files] for k in range(files)] + [times[-1] + timedelta(days=1)]
    for a, b in zip(edges, edges[1:]):
        df.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, name, tmp, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_minute_bars_equal_the_batch(spark, tmp_path):
    rows = ticks(spark)
    out = drain(flows.minute_bars(stream_of(spark, rows, tmp_path / "in")), "bars_out", tmp_path).collect()
    want = {(r.ticker, r.ts): tuple(r)[2:] for r in bars.minute_bars(rows).collect()}
    got = {(r.ticker, r.ts): tuple(r)[2:] for r in out}
    assert got and all(want[k] == v for k, v in got.items())
    closed = max(r.ts for r in rows.collect()) - timedelta(minutes=11)
    assert {k for k in want if k[1] < closed} <= set(got)


def test_duplicates_within_the_watermark(spark, tmp_path):
    rows = ticks(spark, 60)
    out = drain(flows.deduplicated(stream_of(spark, rows.unionByName(rows), tmp_path / "in"), ["ticker", "ts"]), "dedup_out", tmp_path)
    assert out.count() == 60


def test_landing_twice_changes_nothing(spark, tmp_path):
    rows, path = ticks(spark, 60), str(tmp_path / "landed")
    for k in range(2):
        flows.land(stream_of(spark, rows, tmp_path / f"in{k}"), path, ["ticker", "ts"], str(tmp_path / f"ck{k}")).awaitTermination()
    assert spark.read.parquet(path).count() == 60


def test_rolling_features_equal_the_batch_windows(spark, tmp_path):
    b = bars.minute_bars(ticks(spark, 300)).select("ticker", "ts", "close")
    out = drain(flows.rolling_features(stream_of(spark, b, tmp_path / "in", 4), 5), "roll_out", tmp_path).collect()
    batch = technicals.technicals(b.withColumnRenamed("ts", "day"), 5, 9).collect()
    want = {(r.ticker, r.day): (r.daily_return, r.ma_5d, r.vol_5d) for r in batch}
    assert len(out) == len(want)
    for r in out:
        for a, x in zip((r.daily_return, r.ma, r.vol), want[r.ticker, r.ts]):
            assert (a is None and x is None) or a == pytest.approx(x)


def test_sliding_windows_and_interval_join(spark, tmp_path):
    news = spark.createDataFrame([("T0", START + timedelta(minutes=k), "positive", 0.5) for k in range(0, 60, 5)], "ticker string, ts timestamp, sentiment string, intensity double")
    slid = drain(flows.sliding_sentiment(stream_of(spark, news, tmp_path / "n1"), "20 minutes", "10 minutes"), "slide_out", tmp_path)
    assert slid.where("items > 4").count() == 0 and slid.count() > 2
    joined = drain(flows.with_sentiment(stream_of(spark, bars.minute_bars(ticks(spark)), tmp_path / "b"), stream_of(spark, news, tmp_path / "n2"), "10 minutes"), "join_out", tmp_path)
    assert joined.where("news_ts > ts or news_ts <= ts - interval 10 minutes").count() == 0 and joined.count() > 0


def test_interval_join_compares_within_spans_of_time(spark, tmp_path):
    old = datetime(1969, 12, 31, 23, 50)  # spans before 1970 too
    b = [(t, at + timedelta(minutes=k), 1.0) for t in ("T0", "T1") for at in (old, START) for k in range(0, 45, 3)]
    n = [(t, at + timedelta(seconds=s), f"{t}{s}", 0.5) for t in ("T0", "T2") for at in (old, START) for k in range(-15, 45, 2) for s in (60 * k, 60 * k + 1, 60 * k + 59)]
    left, right = spark.createDataFrame(b, "ticker string, ts timestamp, close double"), spark.createDataFrame(n, "ticker string, ts timestamp, sentiment string, intensity double")
    want = sorted((x[0], x[1], y[1], y[2]) for x in b for y in n if x[0] == y[0] and x[1] - timedelta(minutes=10) < y[1] <= x[1])
    joined = flows.with_sentiment(left, right, "10 minutes")
    assert joined.columns == ["ticker", "ts", "close", "news_ts", "sentiment", "intensity"]
    assert want and sorted((r.ticker, r.ts, r.news_ts, r.sentiment) for r in joined.collect()) == want
    assert re.search(r"Join \[ticker#\d+, _span#\d+L\]", joined._jdf.queryExecution().executedPlan().toString())  # not all news of a ticker with all its bars
    for df, name in ((left, "left"), (right, "right")):
        df.write.parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    out = drain(flows.with_sentiment(read(left, "left"), read(right, "right"), "10 minutes"), "span_out", tmp_path)
    assert sorted((r.ticker, r.ts, r.news_ts, r.sentiment) for r in out.where("ts > '2000-01-01'").collect()) == [w for w in want if w[1].year > 2000]


def test_decisions_with_static_side(spark, tmp_path):
    b, path, seen = bars.minute_bars(ticks(spark, 60)), str(tmp_path / "decisions"), []
    static = spark.createDataFrame([("T0", 5.0)], "ticker string, eps double")
    flows.with_fundamentals(stream_of(spark, b, tmp_path / "a"), lambda: static, lambda df, k: seen.append(df.where("eps is not null").count()), str(tmp_path / "ca")).awaitTermination()
    assert sum(seen) == b.where("ticker = 'T0'").count()
    score = lambda df: df.withColumns({"score": F.col("close") - 106.0, "shap_a": F.col("close"), "shap_b": F.lit(-500.0), "shap_c": F.lit(None).cast("double")})
    for k in range(2):
        flows.decisions(stream_of(spark, b, tmp_path / f"d{k}"), score, path, str(tmp_path / f"cd{k}"), sigma=2.0, version="v1", attributions=["shap_a", "shap_b", "shap_c"], top=2).awaitTermination()
    out = spark.read.parquet(path).collect()
    assert len(out) == b.count() and {r.signal for r in out} <= {"buy", "sell", "hold"}
    for r in out:
        assert r.signal == ("buy" if r.score > 1 else "sell" if r.score < -1 else "hold") and set(r.top_features) == {"shap_a", "shap_b"} and r.model_version == "v1"


def test_topics_round_trip(spark, tmp_path):
    b = MARKET_1M.validate(bars.minute_bars(ticks(spark, 60)).withColumn("_ingested_at", F.current_timestamp())).drop("_ingested_at")
    folder = str(tmp_path / "topic")
    topics.publish(b, topics.BARS, folder)
    spark.createDataFrame([("x", "not json"), ("x", "{}")], "key string, value string").write.mode("append").json(folder)
    source = topics.TopicSource(topics.BARS, folder)
    source.subscribe(["T1"])
    out = drain(source.stream(spark), "topic_out", tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, b.where("ticker = 'T1'").collect()))
    assert set(json.loads(topics.encode(b, topics.BARS).first().value)) == {"ticker", "ts", "open", "high", "low", "close", "volume"}
    source.close()
    with pytest.raises(PermanentError):
        source.stream(spark)
    with pytest.raises(PermanentError):
        topics.TopicSource(topics.BARS)


def test_gaps(spark):
    b = spark.createDataFrame([("A", START), ("A", START + timedelta(minutes=2))], "ticker string, ts timestamp")
    out = flows.missing_minutes(b, START, START + timedelta(minutes=4))
    assert sorted(r.ts.minute for r in out.collect()) == [1, 3]
    assert flows.missing_minutes(b, datetime(2024, 1, 6, 15), datetime(2024, 1, 6, 16)).count() == 0


def test_session_follows_new_york_in_both_halves_of_the_year(spark):
    rows = [("2024-07-01 13:45:00", True), ("2024-07-01 20:30:00", False), ("2024-07-01 13:29:00", False), ("2024-01-08 14:29:00", False), ("2024-01-08 14:30:00", True), ("2024-01-08 20:59:00", True), ("2024-01-08 21:00:00", False), ("2024-07-06 15:00:00", False)]
    df = spark.createDataFrame(rows, "at string, open boolean").withColumn("at", F.col("at").cast("timestamp"))
    assert df.where(flows.in_session(F.col("at")) != F.col("open")).count() == 0
