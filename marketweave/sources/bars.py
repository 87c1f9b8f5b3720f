"""Bar sources: a Spark data source over a vendor client, and stored bars."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator
from datetime import date
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marketweave.config import BarConfig
from marketweave.errors import TransientError
from marketweave.operators.ingest import FetchRequest
from marketweave.schemas import MINUTE_OHLCV, OHLCV, RecordSchema

#: client(symbols, start, end, interval) -> rows in the schema's column order.
Client = Callable[[tuple[str, ...], date, date, str], Iterator[tuple]]


class _Chunk(InputPartition):
    def __init__(self, symbols: tuple[str, ...]):
        super().__init__(symbols)
        self.symbols = symbols


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.client: Client = pickle.loads(bytes.fromhex(options["client"]))
        self.symbols = tuple(x for x in options["symbols"].split(",") if x)
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.interval, self.size, self.attempts = options.get("interval", "1d"), int(options.get("batch_size", 100)), int(options.get("attempts", 3))

    def partitions(self) -> list[_Chunk]:
        """One task for each chunk of symbols."""
        return [_Chunk(c) for c in batched(self.symbols, self.size)]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        for k in range(self.attempts):
            try:
                # a whole answer first, so that a retry can't repeat rows
                rows = list(self.client(partition.symbols, self.start, self.end, self.interval) or ())
                break
            except TransientError:
                if k == self.attempts - 1:
                    raise
                time.sleep(min(2**k, 30))
        yield from rows


class VendorBars(DataSource):
    """format("vendor_bars") with options client (pickled, hex), symbols, start, end, interval, batch_size."""

    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self):
        return MINUTE_OHLCV.fields if self.options.get("interval", "1d") == "1m" else OHLCV.fields

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class VendorBarSource:
    """One frame a chunk of symbols, empty answers left out. Pure reading: no state, no pause."""

    def __init__(self, spark: SparkSession, client: Client, config: BarConfig):
        self.spark, self.client, self.config = spark, client, config
        self.schema: RecordSchema = MINUTE_OHLCV if config.interval == "1m" else OHLCV
        spark.dataSource.register(VendorBars)

    def scan(self, request: FetchRequest) -> DataFrame:
        """The whole request as one lazy frame, chunks in parallel."""
        from pyspark import cloudpickle

        options = {"client": cloudpickle.dumps(self.client).hex(), "symbols": ",".join(request.symbols), "start": request.start.isoformat(), "end": request.end.isoformat()}
        options |= {"interval": request.interval, "batch_size": str(self.config.batch_size)}
        return self.schema.validate(self.spark.read.format("vendor_bars").options(**options).load())

    def fetch(self, request: FetchRequest) -> Iterator[DataFrame]:
        for chunk in batched(request.symbols, self.config.batch_size):
            frame = self.scan(FetchRequest(tuple(chunk), request.start, request.end, request.interval)).cache()
            try:
                if not frame.isEmpty():
                    yield frame
            finally:
                frame.unpersist()


class StoredBarSource:
    """Bars that are stored as a table: symbols and window reach the scan as filters."""

    def __init__(self, spark: SparkSession, path: str, config: BarConfig, schema: RecordSchema = OHLCV):
        self.spark, self.path, self.config, self.schema = spark, path, config, schema

    def scan(self, request: FetchRequest) -> DataFrame:
        rows = self.schema.validate(self.spark.read.parquet(self.path))
        return rows.where(F.col("symbol").isin(*request.symbols) & (F.col("date") >= F.lit(request.start)) & (F.col("date") < F.lit(request.end)))

    def fetch(self, request: FetchRequest) -> Iterator[DataFrame]:
        for chunk in batched(request.symbols, self.config.batch_size):
            frame = self.scan(FetchRequest(tuple(chunk), request.start, request.end, request.interval))
            if not frame.isEmpty():
                yield frame


def read_symbol(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """All stored bars of one symbol; the filter is pushed into the scan."""
    return spark.read.parquet(path).where(F.col("symbol") == symbol)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A relational table; filters and maxima are pushed to the database."""
    return spark.read.option("pushDownAggregate", "true").jdbc(url, table, properties=properties or {})
