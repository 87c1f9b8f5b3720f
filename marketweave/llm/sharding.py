"""Sharding by a permutation-filled lookup table (consistent hashing by turns).

Each shard has its own permutation of the slots of a prime-sized table. Shards take
turns; on its turn a shard claims the first slot of its permutation that is still
free. Rows hash to a slot, and the broadcast table gives the shard in constant time.
Adding or removing one shard moves few rows, and shares differ by about 1 %.

The table's size depends on the number of shards alone, never on the data, so the
broadcast has a fixed bound (MAX_SLOTS rows). Rows are placed by DataFrame functions
only; there is no shuffle.

Defined cases: a null key is placed like the empty text; repeated keys share a shard;
an empty input gives an empty result; input columns named as the result's ``slot`` or
``shard`` are refused rather than overwritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.common import md5_long, table

SHARDS = 64
SLOTS_PER_SHARD = 100
MAX_SLOTS = 1_000_003


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def fill_table(names: Sequence[str], slots: int | None = None) -> list[int]:
    """slot -> index of the shard that claimed it."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and be distinct")
    size = slots or next_prime(SLOTS_PER_SHARD * len(names))
    if size != next_prime(size) or not len(names) <= size <= MAX_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_hash(f"{n}/offset") % size for n in names]
    step = [_hash(f"{n}/skip") % (size - 1) + 1 for n in names] if size > 2 else [1] * len(names)
    owner = [-1] * size
    for turn in range(size):
        k = turn % len(names)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % size
        owner[at[k]] = k
    return owner


def lookup(spark: SparkSession, names: Sequence[str], slots: int | None = None) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    owner = fill_table(names, slots)
    owners = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(len(owner)).select(
        F.col("id").alias("slot"), F.element_at(owners, (F.col("id") + 1).cast("int")).cast("int").alias("shard")
    )


def place(df: DataFrame, key: str, names: Sequence[str], slots: int | None = None) -> DataFrame:
    """df with columns slot (long) and shard (int): a map-side join with the table.

    Input columns of these names, in any case, keep their values as input_slot and input_shard
    (with one more input_ while such a name is taken too).
    """
    size = slots or next_prime(SLOTS_PER_SHARD * len(names))
    wanted = md5_long(F.coalesce(F.col(key).cast("string"), F.lit(""))) % size
    taken = {c.lower() for c in df.columns}
    kept = []
    for name in df.columns:
        alias = name
        while alias.lower() in ("slot", "shard") or alias != name and alias.lower() in taken:
            alias = f"input_{alias}"
        kept.append(F.col(f"`{name}`").alias(alias))
    keyed = df.select(wanted.alias("slot"), *kept)
    return keyed.join(F.broadcast(lookup(df.sparkSession, names, size)), "slot", "left")


def write_shards(df: DataFrame, key: str, names: Sequence[str], path: str, files_per_shard: int = 1) -> None:
    """Write df partitioned by shard; rows of a hot key spread over files_per_shard tasks."""
    placed = place(df, key, names)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files_per_shard))
    placed.repartition(len(names) * files_per_shard, "shard", spread).drop("slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", shard_names(SHARDS)).select("doc_id", "slot", "shard")


_SLOTS = next_prime(SHARDS * SLOTS_PER_SHARD)

#: The table is filled again in SQL, turn by turn, over a bit string of claimed slots.
SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i::INT AS i,
         ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 4, '0') || '/offset'), 1, 15))::BIGINT % {_SLOTS} AS first_slot,
         ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 4, '0') || '/skip'), 1, 15))::BIGINT % {_SLOTS - 1} + 1 AS step
  FROM range({SHARDS}) t(i)
), prefs AS (
  SELECT list(first_slot ORDER BY i) AS ats, list(step ORDER BY i) AS steps FROM shards
), turns AS (
  SELECT 0 AS turn, repeat('0', {_SLOTS})::BIT AS taken, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, set_bit(taken, next::INT, 1), next
  FROM (
    SELECT turn, taken,
           list_extract(list_filter(list_transform(range({_SLOTS}), lambda j: (ats[turn % {SHARDS} + 1] + j * steps[turn % {SHARDS} + 1]) % {_SLOTS}),
                                    lambda s: get_bit(taken, s::INT) = 0), 1) AS next
    FROM turns, prefs WHERE turn < {_SLOTS}
  )
)
SELECT d.doc_id, t.slot, ((t.turn - 1) % {SHARDS})::INT AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {_SLOTS} AS slot FROM documents) d
JOIN turns t ON t.slot = d.slot AND t.turn > 0
"""
