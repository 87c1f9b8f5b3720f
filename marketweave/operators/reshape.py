"""Wide vendor frames to tidy bars and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.errors import SchemaMismatchError
from marketweave.functions.columns import nan_to_null

SEPARATOR = "|"


def wide_to_long(wide: DataFrame, ids: Sequence[str] = ("date",)) -> DataFrame:
    """Columns named field|symbol become rows (ids, symbol, field, value); other columns go."""
    encoded = [c for c in wide.columns if SEPARATOR in c]
    typed = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in encoded])
    long = typed.unpivot(list(ids), [F.col(f"`{c}`") for c in encoded], "name", "value")
    parts = F.split("name", r"\|", 2)
    return long.select(*ids, parts[1].alias("symbol"), parts[0].alias("field"), "value")


def long_to_tidy(long: DataFrame, fields: Sequence[str], ids: Sequence[str] = ("date", "symbol"), strict: bool = False) -> DataFrame:
    """One row of ids, one column of each field: the mean of repeated values.

    Null and NaN values are left out first, so rows without any value vanish. The list of
    fields is given: no extra job looks for them, and a field without any value is a null
    column (with strict, it raises as a missing column).
    """
    present = long.withColumn("value", nan_to_null(F.col("value"))).where("value is not null")
    tidy = present.groupBy(*ids).pivot("field", list(fields)).agg(F.avg("value"))
    if strict:
        found = {r.field for r in present.select("field").distinct().collect()}  # at most the vendor's few field names
        if missing := sorted(set(fields) - found):
            raise SchemaMismatchError(f"missing columns {missing}")
    return tidy


def tidy_to_wide(tidy: DataFrame, fields: Sequence[str], symbols: Sequence[str], at: str = "date") -> DataFrame:
    """The vendor's shape: one row a day, columns named field|symbol."""
    aggs = [F.avg(F.when(F.col("symbol") == s, F.col(f"`{f}`"))).alias(f"{f}{SEPARATOR}{s}") for f in fields for s in symbols]
    return tidy.groupBy(at).agg(*aggs)
