"""Incremental loading: gap planning, stamping, de-duplication and idempotent writes."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from datetime import UTC, date, datetime
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketweave.config import BarConfig
from marketweave.errors import PermanentError, TransientError
from marketweave.schemas import RecordSchema

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class FetchRequest:
    """What to read: symbols in the half-open window [start, end). No cadence is implied."""

    symbols: tuple[str, ...]
    start: date
    end: date
    interval: str = "1d"


class BatchSource(Protocol):
    schema: RecordSchema

    def fetch(self, request: FetchRequest) -> Iterator[DataFrame]: ...


class StreamSource(Protocol):
    """One validated record is one message."""

    schema: RecordSchema

    def subscribe(self, symbols: Sequence[str]) -> None: ...
    def stream(self, spark: SparkSession) -> DataFrame: ...
    def close(self) -> None: ...


class StateStore(Protocol):
    derived: bool  # whether the written table itself is the state

    def get_watermarks(self, source: str) -> DataFrame: ...
    def set_watermark(self, source: str, entity: str, value: date) -> None: ...


class Sink(Protocol):
    def write(self, df: DataFrame, *, table: str, natural_key: Sequence[str]) -> int: ...


# --- planning ---------------------------------------------------------------


def watermarks(bars: DataFrame, entity: str = "symbol", at: str = "date") -> DataFrame:
    """Rows (symbol, max_date): the last stored day of each symbol, combined map-side."""
    return bars.groupBy(F.col(entity).alias("symbol")).agg(F.max(F.to_date(at)).alias("max_date"))


def gap_plan(universe: DataFrame, marks: DataFrame, floor: date, end: date) -> DataFrame:
    """Rows (symbol, start) with something to fetch before ``end``.

    Start is the day after the watermark, or the floor. Repeated universe rows are kept,
    watermarks of unknown symbols are ignored, and empty windows drop out.
    """
    joined = universe.select("symbol", *[c for c in universe.columns if c != "symbol"]).join(marks, "symbol", "left")
    start = F.coalesce(F.date_add("max_date", 1), F.lit(floor))
    return joined.withColumn("start", start).drop("max_date").where(F.col("start") < F.lit(end))


def gap_groups(plan: DataFrame, position: str = "pos") -> DataFrame:
    """Rows (start, symbols): symbols of one start in the universe's order."""
    ordered = F.array_sort(F.collect_list(F.struct(position, "symbol")))
    return plan.groupBy("start").agg(F.transform(ordered, lambda x: x["symbol"]).alias("symbols"))


def symbol_chunks(universe: DataFrame, size: int, position: str = "pos") -> DataFrame:
    """universe with chunk_id: runs of ``size`` symbols in order, the last one may be short.

    The universe is a list of symbols (thousands at most), so its single ordered window is small.
    """
    if size < 1:
        raise ValueError("a chunk has one symbol at least")
    number = F.row_number().over(Window.orderBy(position))
    return universe.withColumn("chunk_id", F.floor((number - 1) / size).cast("int"))


def stamp(df: DataFrame, run_date: date, inserted_at: datetime | None = None) -> DataFrame:
    """df with its lineage: the run's date and the time of writing."""
    at = F.current_timestamp() if inserted_at is None else F.lit(inserted_at)
    return df.withColumns({"run_date": F.lit(run_date), "inserted_at": at})


# --- writes -----------------------------------------------------------------


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence | None = None) -> DataFrame:
    """The first row of each key, by ``order`` (default: all other columns, for one defined result)."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in key]
    first = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(*(order or rest or [F.lit(1)])))
    return df.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def insert_ignore(new: DataFrame, target: DataFrame, key: Sequence[str], order: Sequence | None = None) -> DataFrame:
    """Rows of ``new`` to append: one of each key, and none whose key the target has."""
    return dedupe(new, key, order).join(target.select(*[F.col(f"`{k}`") for k in key]), list(key), "left_anti").select(*[F.col(f"`{c}`") for c in new.columns])


def incremental(rows: DataFrame, watermark: datetime | str | None, at: str = "_ingested_at") -> DataFrame:
    """Rows ingested after the watermark (all without one); the literal reaches the scan."""
    return rows if watermark is None else rows.where(F.col(at) > F.lit(watermark).cast(rows.schema[at].dataType))


def prune(rows: DataFrame, loaded: DataFrame, key: Sequence[str], now: datetime, keep_days: int = 30, at: str = "_ingested_at") -> DataFrame:
    """Landing rows that stay: those not yet loaded, and all of the last ``keep_days`` days (30 at least)."""
    if keep_days < 30:
        raise PermanentError("landing rows are kept for 30 days at least")
    cutoff = F.lit(now).cast(rows.schema[at].dataType) - F.expr(f"INTERVAL {keep_days} DAYS")
    done = loaded.select(*key).distinct().withColumn("_loaded", F.lit(True))
    return rows.join(done, list(key), "left").where((F.col(at) >= cutoff) | F.col("_loaded").isNull()).drop("_loaded").select(rows.columns)


def upsert_state(state: DataFrame, source: str, marks: DataFrame, now: datetime) -> DataFrame:
    """The state table (source, entity, watermark, updated_at) with newer marks in place of older ones."""
    fresh = marks.select(F.lit(source).alias("source"), F.col("symbol").alias("entity"), F.col("max_date").alias("watermark"), F.lit(now).alias("updated_at"))
    newest = F.row_number().over(Window.partitionBy("source", "entity").orderBy(F.col("watermark").desc(), F.col("updated_at").desc()))
    return state.unionByName(fresh).withColumn("_rank", newest).where("_rank = 1").drop("_rank")


class TableSink:
    """Writes frames to Parquet tables under a root: plain append, or ignoring keys that are there.

    Insert-ignore is for a single writer: the check and the append are two steps.
    """

    def __init__(self, root: str | None, mode: str = "append"):
        if mode not in ("append", "insert_ignore"):
            raise PermanentError(f"no such mode: {mode}")
        self.root, self.mode = root, mode

    def path(self, table: str) -> str:
        if not self.root:
            raise PermanentError("the sink has no root folder")
        return f"{self.root.rstrip('/')}/{table}"

    def write(self, df: DataFrame, *, table: str, natural_key: Sequence[str]) -> int:
        """Rows written, counted within the write."""
        path = self.path(table)
        if self.mode == "insert_ignore":
            stored = read_or_none(df.sparkSession, path)
            df = dedupe(df, natural_key) if stored is None else insert_ignore(df, stored, natural_key)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
        logger.info("%s: %d rows appended", path, seen.get["rows"])
        return seen.get["rows"]


class JdbcSink:
    """Inserts into a table of a relational database, ignoring keys that are there.

    Executors write a staging table; one statement then inserts the rows whose key the target
    lacks, so a run or task that is repeated adds nothing. A target that doesn't exist is
    created; text keys are then of ``key_type``, as databases compare no unbounded text.
    Null keys are equal to none and are inserted each time, as a unique constraint has it.
    The driver class must be on the class path.
    """

    def __init__(self, url: str | None, properties: dict[str, str] | None = None, key_type: str = "VARCHAR(255)"):
        self.url, self.properties, self.key_type = url, properties or {}, key_type

    def write(self, df: DataFrame, *, table: str, natural_key: Sequence[str]) -> int:
        """Rows inserted, as the database counts them."""
        if not self.url:
            raise PermanentError("the database's address is not configured")
        staging = f"{table}_staging_{uuid.uuid4().hex[:12]}"
        texts = ", ".join(f"`{k}` {self.key_type}" for k in natural_key if df.schema[k].dataType == StringType())
        typed = {"createTableColumnTypes": texts} if texts else {}
        with closing(self._connect(df.sparkSession, table)) as connection:
            quote = lambda name: self._dialect(df.sparkSession).quoteIdentifier(name)
            names = ", ".join(quote(c) for c in df.columns)
            same = " AND ".join(f"t.{quote(k)} = s.{quote(k)}" for k in natural_key)
            try:
                df.limit(0).write.options(**typed).jdbc(self.url, table, "append", self.properties)
                dedupe(df, natural_key).write.options(**typed).jdbc(self.url, staging, "overwrite", self.properties)
                missing = f"SELECT {names} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})"
                return self._run(connection, f"INSERT INTO {table} ({names}) {missing}")
            finally:
                self._drop(connection, staging)

    def _dialect(self, spark: SparkSession):
        return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)

    def _connect(self, spark: SparkSession, table: str):
        """A connection of the driver's own, by the same driver class as Spark's writer."""
        jvm = spark._jvm
        options = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(self.url, table, jvm.PythonUtils.toScalaMap(self.properties))
        return self._dialect(spark).createConnectionFactory(options).apply(-1)

    @staticmethod
    def _run(connection, sql: str) -> int:
        with closing(connection.createStatement()) as statement:
            return statement.executeUpdate(sql)

    def _drop(self, connection, staging: str) -> None:
        try:
            self._run(connection, f"DROP TABLE {staging}")
        except Py4JJavaError as error:  # it may never have been made; the write's own error must not be hidden
            logger.warning("%s stays or was never made: %s", staging, error.java_exception.getMessage())


class ListSink:
    """Keeps the frames it is given (for tests)."""

    def __init__(self) -> None:
        self.frames: list[tuple[DataFrame, str, tuple[str, ...]]] = []

    def write(self, df: DataFrame, *, table: str, natural_key: Sequence[str]) -> int:
        kept = df.sparkSession.createDataFrame(df.collect(), df.schema)
        self.frames.append((kept, table, tuple(natural_key)))
        return kept.count()


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if it isn't there yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return None
        raise


class LandingState:
    """Watermarks are what the landing table holds; writing it advances them."""

    EMPTY = "symbol STRING, max_date DATE"
    derived = True

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def get_watermarks(self, source: str) -> DataFrame:
        stored = read_or_none(self.spark, self.path) if self.path else None
        if stored is None:
            logger.info("%s has no landing table yet", source)
            return self.spark.createDataFrame([], self.EMPTY)
        return watermarks(stored)

    def set_watermark(self, source: str, entity: str, value: date) -> None:
        """Nothing to do: the landing table's last day is the watermark."""


class MemoryState:
    derived = False

    def __init__(self, spark: SparkSession, marks: dict[str, date] | None = None):
        self.spark, self.marks = spark, dict(marks or {})

    def get_watermarks(self, source: str) -> DataFrame:
        return self.spark.createDataFrame(list(self.marks.items()), LandingState.EMPTY)

    def set_watermark(self, source: str, entity: str, value: date) -> None:
        self.marks[entity] = value


def retrying(call: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; only transient errors are tried again, with doubling waits."""
    for k in range(attempts):
        try:
            return call()
        except TransientError:
            if k == attempts - 1:
                raise
            sleep(wait * 2**k)


class BarPipeline:
    """Reads the gap of each symbol and writes each batch as it comes.

    A failed write ends the run before the watermark moves, so the next run resumes.
    """

    SOURCE = "ohlcv"

    def __init__(self, spark: SparkSession, source: BatchSource, state: StateStore, sink: Sink, config: BarConfig, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.source, self.state, self.sink, self.config, self.sleep = spark, source, state, sink, config, sleep

    def plan(self, symbols: Sequence[str], end: date) -> list[tuple[date, list[str]]]:
        """Symbols by start, starts by first appearance. The universe is thousands of rows at most."""
        if not symbols:
            return []
        universe = self.spark.createDataFrame(list(enumerate(symbols)), "pos INT, symbol STRING")
        groups = gap_groups(gap_plan(universe, self.state.get_watermarks(self.SOURCE), self.config.history_floor, end))
        rows = [(r.start, list(r.symbols)) for r in groups.collect()]
        return sorted(rows, key=lambda r: symbols.index(r[1][0]))

    def run(self, symbols: Sequence[str], end: date | None = None) -> int:
        """Rows written."""
        today = datetime.now(UTC).date()
        until = end or today
        requests = [FetchRequest(tuple(named), start, until, self.config.interval) for start, named in self.plan(symbols, until)]
        counts = [self._store(frame, today) for request in requests for frame in self.source.fetch(request)]
        logger.info("%s: %d rows in %d batches before %s", self.config.table, sum(counts), len(counts), until)
        return sum(counts)

    def _store(self, frame: DataFrame, run_date: date) -> int:
        """Write one batch, then move the marks; a state that is derived from the written table needs no look at the batch."""
        rows = self.sink.write(stamp(frame, run_date, datetime.now(UTC)), table=self.config.table, natural_key=list(self.source.schema.natural_key))
        if not self.state.derived:
            for mark in watermarks(frame).collect():  # a row for each symbol of the batch
                self.state.set_watermark(self.SOURCE, mark.symbol, mark.max_date)
        self.sleep(self.config.sleep_seconds)
        return rows
