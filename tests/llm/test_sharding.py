from collections import Counter

import pytest

from marketweave.llm import sharding as S


def test_turns_claim_every_slot_evenly():
    names = S.shard_names(7)
    owner = S.fill_table(names, 701)
    shares = Counter(owner)
    assert len(owner) == 701 and set(shares) == set(range(7))
    assert max(shares.values()) - min(shares.values()) <= 1


def test_adding_a_shard_moves_few_slots():
    size = S.next_prime(2000)
    before, after = S.fill_table(S.shard_names(9), size), S.fill_table(S.shard_names(10), size)
    moved = sum(a != b and b != 9 for a, b in zip(before, after))
    assert moved < 0.15 * size


def test_bad_parameters():
    for names, slots in (([], None), (["a", "a"], None), (["a", "b"], 4), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            S.fill_table(names, slots)


def test_place_nulls_repeats_empty_and_clashes(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (5, None)], "doc_id long, extra string")
    out = S.place(df, "doc_id", S.shard_names(3))
    rows = out.collect()
    assert len(rows) == 4 and {"extra", "slot", "shard", "doc_id"} == set(out.columns)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    owner, size = S.fill_table(S.shard_names(3)), S.next_prime(300)
    for r in rows:
        assert r.slot == S._hash("" if r.doc_id is None else str(r.doc_id)) % size and r.shard == owner[r.slot]
    assert S.place(df.limit(0), "doc_id", S.shard_names(3)).count() == 0
    clash = df.select("doc_id", df.extra.alias("Slot"), df.extra.alias("shard"), df.extra.alias("input_Slot"))
    same = S.place(clash, "doc_id", S.shard_names(3))
    assert set(same.columns) == {"doc_id", "slot", "shard", "input_input_Slot", "input_shard", "input_Slot"}
    assert sorted((r.slot, r.shard) for r in same.collect()) == sorted((r.slot, r.shard) for r in rows)
    assert {r.input_shard for r in same.collect()} == {"x", "y", "z", None}


def test_plan_is_native_and_without_shuffle(spark):
    df = spark.createDataFrame([(1,)], "doc_id long")
    plan = S.place(df, "doc_id", S.shard_names(64))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan


def test_write_shards_round_trip(spark, tmp_path):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    S.write_shards(df, "doc_id", S.shard_names(4), str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
