"""Record schemas: declared columns, table names and natural keys of the landing tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.errors import SchemaMismatchError


@dataclass(frozen=True)
class RecordSchema:
    """One landing table. Immutable; attribute names map to external column names through ``aliases``."""

    name: str
    table: str
    fields: T.StructType
    natural_key: tuple[str, ...]
    aliases: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if not set(self.natural_key) <= set(self.fields.names):
            raise SchemaMismatchError(f"{self.name}: the key {self.natural_key} is not among the columns")

    def columns(self) -> list[str]:
        """External column names, in declared order."""
        return list(self.fields.names)

    def missing(self, df: DataFrame) -> list[str]:
        return sorted(set(self.columns()) - set(df.columns))

    def validate(self, df: DataFrame) -> DataFrame:
        """df with exactly the declared columns in declared order; raises if some are missing.

        Only the presence of columns is checked (no pass over the data); extra columns go.
        """
        if missing := self.missing(df):
            raise SchemaMismatchError(f"the frame lacks {missing}, which {self.name} declares")
        return df.select(*(F.col(f"`{c}`") for c in self.columns()))

    def rename_attributes(self, df: DataFrame) -> DataFrame:
        """df with attribute names replaced by their external column names."""
        return df.withColumnsRenamed({k: v for k, v in self.aliases if k in df.columns})


_TYPES = {"DATE": T.DateType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BIGINT": T.LongType(), "TIMESTAMP": T.TimestampType(), "MAP<STRING DOUBLE>": T.MapType(T.StringType(), T.DoubleType())}


def _schema(ddl: str) -> T.StructType:
    """The columns of a short DDL text (Spark's own parser would need a running session)."""
    columns = (c.strip() for c in ddl.split(", "))
    split = (c[1:].split("` ", 1) if c.startswith("`") else c.split(" ", 1) for c in columns)
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in split])


OHLCV = RecordSchema(
    "OhlcvBar",
    "ohlcv_1d",
    _schema("date DATE, symbol STRING, `Adj Close` DOUBLE, Close DOUBLE, Dividends DOUBLE, High DOUBLE, Low DOUBLE, Open DOUBLE, `Stock Splits` DOUBLE, Volume DOUBLE"),
    ("date", "symbol"),
    (("adj_close", "Adj Close"), ("close", "Close"), ("dividends", "Dividends"), ("high", "High"), ("low", "Low"), ("open", "Open"), ("stock_splits", "Stock Splits"), ("volume", "Volume")),
)
MINUTE_OHLCV = RecordSchema("OhlcvMinuteBar", "ohlcv_1min", T.StructType([T.StructField("date", T.TimestampType()), *OHLCV.fields.fields[1:]]), OHLCV.natural_key, OHLCV.aliases)
MARKET_1M = RecordSchema(
    "MarketBar", "market_ohlcv_1m", _schema("ticker STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, _ingested_at TIMESTAMP"), ("ticker", "ts")
)
EDGAR_FACTS = RecordSchema(
    "EdgarFact",
    "edgar_facts",
    _schema("ticker STRING, cik STRING, metric STRING, value DOUBLE, period_end DATE, filed_date DATE, form_type STRING, accession_no STRING, _ingested_at TIMESTAMP"),
    ("cik", "metric", "period_end", "form_type", "accession_no"),
)
NEWS = RecordSchema(
    "NewsSentiment",
    "news_sentiment",
    _schema("ticker STRING, ts TIMESTAMP, headline STRING, source STRING, sentiment STRING, intensity DOUBLE, url STRING, _ingested_at TIMESTAMP"),
    ("source", "url", "ts"),
)
COMPANY = RecordSchema("CompanyMeta", "company_meta", _schema("ticker STRING, cik STRING, company_name STRING, sector STRING"), ("ticker",))
FILING_INDEX = RecordSchema(
    "FilingIndexRow", "filing_index", _schema("cik STRING, company_name STRING, form_type STRING, date_filed DATE, filename STRING, full_url STRING"), ("cik", "filename")
)
DECISIONS = RecordSchema(
    "Decision", "decisions", _schema("ts TIMESTAMP, ticker STRING, signal STRING, score DOUBLE, model_version STRING, top_features MAP<STRING DOUBLE>"), ("ts", "ticker")
)
ALL = (OHLCV, MINUTE_OHLCV, MARKET_1M, EDGAR_FACTS, NEWS, COMPANY, FILING_INDEX, DECISIONS)
