"""Streaming counterparts of the batch operators.

Event-time state is bounded by a watermark of WATERMARK; rows later than that drop out
and are counted in the queries' progress. Each consumer is a query with its own checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketweave.operators.bars import ohlcv
from marketweave.operators.ingest import insert_ignore, dedupe, read_or_none

WATERMARK = "10 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with changelog checkpoints, so it may outgrow the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def minute_bars(ticks: DataFrame, price: str = "price", at: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Tumbling one-minute bars of a tick stream; a bar is emitted once, when the watermark passes its end."""
    keyed = ticks.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    rows = keyed.groupBy("ticker", F.window(at, "1 minute")).agg(*ohlcv(price, F.count(F.lit(1)), F.struct(at, price)))
    return rows.select("ticker", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_sentiment(news: DataFrame, length: str = "7 days", step: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Sliding windows of sentiment for each ticker."""
    rows = news.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    out = rows.groupBy("ticker", F.window("ts", length, step)).agg(F.avg("intensity").alias("mean_intensity"), F.count(F.lit(1)).alias("items"))
    return out.select("ticker", F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "mean_intensity", "items")


def deduplicated(rows: DataFrame, key: Sequence[str], at: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Redelivered messages once, as far back as the watermark reaches."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark).dropDuplicatesWithinWatermark(list(key))


def land(rows: DataFrame, path: str, key: Sequence[str], checkpoint: str, available_now: bool = True, at: str = "ts") -> StreamingQuery:
    """Append a stream to a Parquet table; keys that are there are ignored, so replays change nothing."""
    return _start(rows.writeStream.foreachBatch(lambda batch, number: append_new(batch, path, key, at)), checkpoint, available_now)


def append_new(batch: DataFrame, path: str, key: Sequence[str], at: str = "ts", order: Sequence | None = None) -> None:
    """Append the rows whose key the table lacks. The table lies by day (column ``_day``, of ``at``).

    Where ``at`` is part of the key, equal keys share a day, so only the days of the batch are read.
    """
    batch = batch.withColumn("_day", F.to_date(at))
    stored = read_or_none(batch.sparkSession, path)
    if stored is None:
        fresh = dedupe(batch, key, order)
    else:
        if at in key:
            span = batch.agg(F.min("_day").alias("a"), F.max("_day").alias("b")).first()
            stored = stored.where(F.col("_day").between(F.lit(span.a), F.lit(span.b)))
        fresh = insert_ignore(batch, stored, key, order)
    fresh.write.mode("append").partitionBy("_day").parquet(path)


def _start(writer, checkpoint: str, available_now: bool, interval: str = "10 seconds") -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


_FEATURES = "ticker STRING, ts TIMESTAMP, close DOUBLE, daily_return DOUBLE, ma DOUBLE, vol DOUBLE, n INT"


def rolling_features(bars: DataFrame, length: int = 30, idle: str = "30 days", watermark: str = WATERMARK) -> DataFrame:
    """Each bar with its return, mean and deviation over the last ``length`` bars of its ticker.

    The state is a ring of length + 1 closes and the time of the last bar; bars that are not
    newer than it (redeliveries) are left out, and a ticker without bars for ``idle`` of event
    time loses its state. Within a micro-batch bars go by time. Equal to the batch windows
    over the same bars; a return on a zero close is null.
    """
    keep = pd.Timedelta(idle).value // 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring, last = state.get if state.exists else ([], None)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        at = rows["ts"].astype("datetime64[ns]").astype("int64").to_numpy()
        before = np.concatenate([[np.iinfo(np.int64).min if last is None else last], at[:-1]])
        rows, at = rows[at > before], at[at > before]
        if last is not None:
            rows, at = rows[at > last], at[at > last]
        if len(rows):
            new = rows["close"].to_numpy(np.float64)
            closes = np.concatenate([np.asarray(ring, np.float64), new])
            yield _rolled(key[0], rows["ts"], closes, len(new), length)
            ring, last = closes[-(length + 1) :].tolist(), int(at[-1])
        state.update((list(ring), last))
        if last is not None:
            state.setTimeoutTimestamp(max(last // 1_000_000, state.getCurrentWatermarkMs()) + keep)

    timed = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy("ticker").applyInPandasWithState(step, _FEATURES, "closes ARRAY<DOUBLE>, last LONG", "append", GroupStateTimeout.EventTimeTimeout)


def _rolled(ticker: str, ts: pd.Series, closes: np.ndarray, new: int, length: int) -> pd.DataFrame:
    """Features of the last ``new`` closes; those before them are what the ring held."""
    with np.errstate(divide="ignore", invalid="ignore"):
        returns = np.where(closes[:-1] != 0, closes[1:] / closes[:-1] - 1, np.nan)
    returns = np.concatenate([[np.nan], returns])

    def windows(values: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(length - 1, np.nan), values]), length)[-new:]

    of_closes, of_returns = windows(closes), windows(returns)
    n, m = (~np.isnan(of_closes)).sum(axis=1), (~np.isnan(of_returns)).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.nansum(of_returns, axis=1) / m
        vol = np.sqrt(np.nansum((of_returns - mean[:, None]) ** 2, axis=1) / (m - 1))
        ma = np.nansum(of_closes, axis=1) / n
    null = lambda values, ok: pd.Series(values).astype(object).where(pd.Series(ok), None)
    daily = returns[-new:]
    columns = {"daily_return": null(daily, ~np.isnan(daily)), "ma": ma, "vol": null(vol, m > 1), "n": n.astype(np.int32)}
    return pd.DataFrame({"ticker": ticker, "ts": ts.to_numpy(), "close": closes[-new:], **columns})


def with_fundamentals(bars: DataFrame, fundamentals: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Live bars joined with slow fundamentals, which are read anew in every micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        write(batch.join(fundamentals(), "ticker", "left"), number)

    return _start(bars.writeStream.foreachBatch(each), checkpoint, available_now)


def with_sentiment(bars: DataFrame, news: DataFrame, before: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Each bar with the news of its ticker in the time before it: an interval join with bounded state.

    A key of ticker alone would compare each bar with all news that the ticker has in the state. So time is cut into
    spans as long as ``before``: a bar has one span, news have their own and the next, which makes a pair meet once.
    """
    length = pd.Timedelta(before).value // 1000
    span = lambda at: F.expr(f"(unix_micros({at}) - pmod(unix_micros({at}), {length}L)) div {length}L")
    left = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).withColumn("_span", span("ts")).alias("b")
    right = news.select(F.col("ticker").alias("news_ticker"), F.col("ts").cast("timestamp").alias("news_ts"), "sentiment", "intensity").withWatermark("news_ts", watermark)
    right = right.select("*", F.explode(F.array(span("news_ts"), span("news_ts") + 1)).alias("news_span")).alias("n")
    near = F.expr(f"b.ticker = n.news_ticker AND b._span = n.news_span AND n.news_ts <= b.ts AND n.news_ts > b.ts - INTERVAL {before}")
    return left.join(right, near, "inner").drop("news_ticker", "news_span", "_span")


def decide(rows: DataFrame, score: str = "score", sigma: float = 1.0, threshold: float = 0.5, version: str = "0", attributions: Sequence[str] = (), top: int = 3) -> DataFrame:
    """Decision events: buy or sell beyond +/- threshold * sigma, else hold, with the largest attributions."""
    limit = threshold * sigma
    signal = F.when(F.col(score) > limit, "buy").when(F.col(score) < -limit, "sell").otherwise("hold")
    named = F.array(*[F.struct(F.abs(F.coalesce(F.col(c), F.lit(0.0))).alias("size"), F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0.0)).alias("value")) for c in attributions]) if attributions else None
    pairs = F.slice(F.sort_array(named, asc=False), 1, top) if attributions else None
    features = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["name"], x["value"]))) if attributions else F.create_map().cast("map<string,double>")
    return rows.select("ts", "ticker", signal.alias("signal"), F.col(score).alias("score"), F.lit(version).alias("model_version"), features.alias("top_features"))


def decisions(bars: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Score a stream with a model and append the decisions; a replayed batch adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        append_new(decide(score(batch), **options), path, ["ts", "ticker"], order=[F.col("score")])

    return _start(bars.writeStream.foreachBatch(write), checkpoint, available_now)


def in_session(at, opens: str = "09:30", closes: str = "16:00", zone: str = "America/New_York"):
    """Whether a UTC time is within a weekday's market hours, which follow the exchange's own clock."""
    there = F.from_utc_timestamp(at, zone)
    clock = F.date_format(there, "HH:mm")
    return ~F.dayofweek(there).isin(1, 7) & (clock >= opens) & (clock < closes)


def missing_minutes(bars: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows (ticker, ts) of session minutes without a bar: what a backfill has to fetch."""
    minutes = F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 MINUTE"))).alias("ts")
    grid = bars.select("ticker").distinct().select("ticker", minutes).where((F.col("ts") < F.lit(end)) & in_session(F.col("ts")))
    return grid.join(bars.select("ticker", F.date_trunc("minute", "ts").alias("ts")), ["ticker", "ts"], "left_anti")


def backfill_window(marks: DataFrame, today: date) -> DataFrame:
    """Rows (symbol, start, end) still to be fetched in batch."""
    return marks.select("symbol", F.date_add("max_date", 1).alias("start"), F.lit(today).alias("end")).where(F.col("start") < F.col("end"))
