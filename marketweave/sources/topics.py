"""Keyed JSON topics: three message kinds, produced and consumed in batch or as streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.errors import PermanentError
from marketweave.schemas import EDGAR_FACTS, MARKET_1M, NEWS, RecordSchema


@dataclass(frozen=True)
class Topic:
    name: str
    key: str
    schema: RecordSchema
    partitions: int
    retention_days: int

    def message(self) -> T.StructType:
        return T.StructType([f for f in self.schema.fields if not f.name.startswith("_")])


#: Fixed: names, keys, partitions and retention.
BARS = Topic("market.ohlcv.1m", "ticker", MARKET_1M, 6, 7)
FILINGS = Topic("edgar.filings", "cik", EDGAR_FACTS, 3, 30)
NEWS_ITEMS = Topic("news.sentiment", "ticker", NEWS, 3, 7)
TOPICS = (BARS, FILINGS, NEWS_ITEMS)


def encode(rows: DataFrame, topic: Topic) -> DataFrame:
    """Messages (key, value) of rows."""
    names = [f.name for f in topic.message()]
    return rows.select(F.col(topic.key).alias("key"), F.to_json(F.struct(*names)).alias("value"))


def decode(messages: DataFrame, topic: Topic) -> DataFrame:
    """Rows of messages; values that aren't JSON objects drop out."""
    parsed = messages.select(F.from_json(F.col("value").cast("string"), topic.message()).alias("m"))
    return parsed.where(F.col("m").isNotNull() & F.col(f"m.{topic.key}").isNotNull()).select("m.*")


class TopicSource:
    """A stream of one topic: from a broker if an address is given, else from a folder of JSON lines."""

    def __init__(self, topic: Topic, folder: str | None = None, servers: str | None = None, files_per_trigger: int | None = None):
        if not (folder or servers):
            raise PermanentError("a topic needs a folder or a broker")
        self.topic, self.folder, self.servers, self.files = topic, folder, servers, files_per_trigger
        self.schema, self.symbols, self.open = topic.schema, None, True

    def subscribe(self, symbols: Sequence[str]) -> None:
        self.symbols = list(symbols)

    def stream(self, spark: SparkSession) -> DataFrame:
        if not self.open:
            raise PermanentError("the source is closed")
        if self.servers:  # needs the broker connector on the class path
            raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.servers).option("subscribe", self.topic.name).load()
            rows = decode(raw, self.topic)
        else:
            reader = spark.readStream.schema("key STRING, value STRING")
            if self.files:
                reader = reader.option("maxFilesPerTrigger", self.files)
            rows = decode(reader.json(self.folder), self.topic)
        return rows if self.symbols is None else rows.where(F.col(self.topic.key).isin(*self.symbols))

    def close(self) -> None:
        self.open = False


def publish(rows: DataFrame, topic: Topic, folder: str) -> None:
    """Append messages as JSON lines; a key's messages share a file, so their order is kept."""
    encode(rows, topic).repartition(topic.partitions, "key").write.mode("append").json(folder)
