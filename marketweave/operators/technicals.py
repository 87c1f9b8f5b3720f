"""Rolling technicals over daily bars: one exchange and one sort by (ticker, day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.columns import TRADING_DAYS, risk_free_daily


def _days():
    return Window.partitionBy("ticker").orderBy("day")


def daily_return(bars: DataFrame) -> DataFrame:
    """bars with daily_return: close over the previous close, less one; null for the first and after a zero."""
    before = F.lag("close").over(_days())
    return bars.withColumn("daily_return", F.try_divide(F.col("close"), before) - 1)


def _rolling(value: Column, n: int, min_periods: int) -> tuple[Column, Column]:
    frame = _days().rowsBetween(1 - n, 0)
    return F.avg(value).over(frame), F.count(value).over(frame) >= min_periods


def moving_average(bars: DataFrame, n: int, name: str | None = None, min_periods: int = 1) -> DataFrame:
    """Mean close of the last n trading rows; partial frames count from ``min_periods`` rows on."""
    mean, enough = _rolling(F.col("close"), n, min_periods)
    return bars.withColumn(name or f"ma_{n}d", F.when(enough, mean) if min_periods > 1 else mean)


def technicals(bars: DataFrame, short: int = 30, long: int = 90) -> DataFrame:
    """bars with daily_return, ma, vol and sharpe columns.

    vol is the sample deviation of the returns (null for one); sharpe is null where it is zero.
    """
    frame = _days().rowsBetween(1 - short, 0)
    vol = F.stddev_samp("daily_return").over(frame)
    mean = F.avg("daily_return").over(frame)
    out = moving_average(moving_average(daily_return(bars), short), long)
    out = out.withColumns({f"vol_{short}d": vol, "_mean": mean})
    sharpe = F.try_divide(F.col("_mean") - risk_free_daily(), F.col(f"vol_{short}d")) * F.sqrt(F.lit(float(TRADING_DAYS)))
    return out.withColumn(f"sharpe_{short}d", sharpe).drop("_mean")


def forward_return(bars: DataFrame, horizons: Sequence[int] = (1, 5)) -> DataFrame:
    """bars with forward_return_h: the close h rows ahead over this one, less one."""
    return bars.withColumns({f"forward_return_{h}": F.try_divide(F.lead("close", h).over(_days()), F.col("close")) - 1 for h in horizons})


def latest(rows: DataFrame, n: int = 1, by: str = "ticker", at: str = "day") -> DataFrame:
    """The last n rows of each ticker (Spark limits each group before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(at).desc()))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def walk_forward_folds(rows: DataFrame, folds: int = 4, at: str = "day") -> DataFrame:
    """Rows (fold, train_until, test_from, test_until): fold k trains on days before its test days.

    Distinct days are cut into folds + 1 runs in time order; there are thousands of days at
    most, so the single ordered window over them is small.
    """
    days = rows.select(F.col(at).alias("day")).distinct().withColumn("run", F.ntile(folds + 1).over(Window.orderBy("day")))
    edges = days.groupBy("run").agg(F.min("day").alias("test_from"), F.max("day").alias("test_until"))
    previous = edges.select((F.col("run") + 1).alias("run"), F.col("test_until").alias("train_until"))
    return edges.join(F.broadcast(previous), "run").select((F.col("run") - 1).alias("fold"), "train_until", "test_from", "test_until")


def split_fold(rows: DataFrame, train_until, test_from, test_until, at: str = "day") -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of a fold; nothing of the future trains."""
    return rows.where(F.col(at) <= F.lit(train_until)), rows.where(F.col(at).between(F.lit(test_from), F.lit(test_until)))
