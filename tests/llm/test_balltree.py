import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketweave.llm import balltree as B

NAN, INF = float("nan"), float("inf")


def brute(rows, every, k):
    ok = {(i, tuple(np.floor(256 * np.array(v, float)).tolist())) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, qv in ok:
        if q % every == 0:
            found = sorted({(-int(sum(int(a) * int(b) for a, b in zip(qv, v))), i) for i, v in ok if i != q and len(v) == len(qv)})
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    return sorted(tuple(r) for r in B.top_k(df, df.where(f"vec_id % {every} = 0"), k).collect())


def test_against_brute_force_with_odd_rows(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(160)]
    same = [0.5, -0.25, 0.5, 1.0, 0.0, 0.25]
    rows += [(i, same) for i in range(160, 230)] + [(3, rows[3][1])]
    rows += [(300, None), (305, [NAN] * 6), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (315, [INF] * 6), (None, same), (320, []), (325, [1.0, 2.0]), (326, [2.0, 2.0])]
    monkeypatch.setattr(B, "QUERY_BLOCK", 7)
    assert run(spark, rows) == brute(rows, 5, 5)


def test_rows_repeated_across_shards_of_a_task_take_one_place(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(1, 60)] + [(0, [1.0, 1.0, 1.0, 1.0])]
    top = [(100 + i, [9.0 + i, 9.0, 9.0, 9.0]) for i in range(3)]
    rows = top + rows[:30] + top + rows[30:] + top
    monkeypatch.setattr(B, "SHARD_ROWS", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(tuple(r) for r in B.top_k(df, df.where("vec_id % 60 = 0"), 5).collect())
    assert got == brute(rows, 60, 5)


def test_an_id_with_two_vectors_of_one_score_takes_one_place():
    own, points = np.array([0, 1, 1, 2, 3]), np.array([[1.0, 0.0], [9.0, 1.0], [9.0, 2.0], [8.0, 0.0], [7.0, 0.0]])
    assert B._floors(own, points, 2)[0] == 8


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    assert run(spark, rows, 1) == brute(rows, 1, 5)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])], 1) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**22 + i), float(2**22 - 3 * i)]) for i in range(12)]
    assert run(spark, rows, 1, 3) == brute(rows, 1, 3)


@given(st.integers(0, 10_000), st.integers(1, 5), st.integers(1, 9), st.booleans())
@settings(max_examples=40, deadline=None)
def test_search_is_exact_and_ties_go_to_smaller_ids(seed, dim, leaf, ties):
    rng = np.random.default_rng(seed)
    points = np.floor(rng.normal(size=(60, dim)) * (2 if ties else 500))
    ids = rng.permutation(60)
    queries, own = np.floor(rng.normal(size=(8, dim)) * 30), np.arange(8)
    best = B.Best(own, [None] * 8, 4)
    distinct, names = B._distinct(ids, points, 4)
    B.search(best, queries, distinct, names, leaf)
    for q in range(8):
        want = sorted((-int(queries[q] @ p), int(i)) for i, p in zip(ids, points) if i != own[q])[:4]
        assert sorted(best.rows[q])[:4] == want


def test_bounds_prune_clustered_data():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 8)) * 100
    points = np.floor(np.repeat(centers, 50, axis=0) + rng.normal(size=(2000, 8)))
    best = B.Best(np.array([-1]), [None], 5)
    visits = B.search(best, points[:1], *B._distinct(np.arange(2000), points, 5))
    assert visits < 0.5 * 2000 / B.LEAF


def test_scores_beyond_64_bits_are_the_nearest_long(spark):
    big = [(0, [1e18, 1e18]), (5, [1e18, 1e18]), (3, [-1e18, 0.0]), (4, [1e150, 1e150]), (6, [1.0, 1.0]), (7, [1e307, 1.0])]
    least, most = -(2**63), 2**63 - 1
    e = {i: [int(np.floor(256 * x)) for x in v] for i, v in big if i != 7}  # 256 * 1e307 is no finite double
    want = []
    for q in (0, 5):
        score = lambda i: max(least, min(most, sum(a * b for a, b in zip(e[q], e[i]))))
        found = sorted((-score(i), i) for i in e if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert run(spark, big, 5) == sorted(want)


def test_a_tree_is_built_once_a_shard_however_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(B, "QUERY_BLOCK", 5)
    monkeypatch.setattr(B, "SHARD_ROWS", 40)
    monkeypatch.setattr(B, "GROUP", 2)
    blocks = B.query_blocks(B.valid(df.where("vec_id % 2 = 0"), "vec_id", "embedding"), 256)
    assert len(blocks) >= 20
    built = []
    monkeypatch.setattr(B, "BallTree", lambda points, leaf=64, make=B.BallTree: built.append(len(points)) or make(points, leaf))
    base = B.valid(df, "vec_id", "embedding").toArrow().combine_chunks().to_batches()
    found = list(B.searcher(blocks, spark.sparkContext.broadcast({}), 5, 256)(iter(base)))
    assert sum(built) == 200 and max(built) <= 40 and len(built) <= 2 * 200 // 40
    assert len({(b, q) for t in found for b, q in zip(t["block"].to_pylist(), t["q"].to_pylist())}) == 100


def test_queries_need_not_be_candidates(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(20)]
    asked = spark.createDataFrame([(50 + j, [1.0, 2.0 * j]) for j in range(9)], "vec_id long, embedding array<double>")
    got = B.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asked, 3).collect()
    want = []
    for j in range(9):
        found = sorted((-int(65536 * (v[0] + 2 * j * v[1])), i) for i, v in rows)[:3]
        want += [(50 + j, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_wide_vectors_make_smaller_shards(spark, monkeypatch):
    rows = [(i, [float(i - 4)] * 16) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cuts = [t.num_rows for t in B._shards(iter(B.valid(df, "vec_id", "embedding").toArrow().to_batches()), 8, 64)]
    assert sum(cuts) == 10 and max(cuts) <= 4
    monkeypatch.setattr(B, "SHARD_VALUES", 64)
    assert run(spark, rows) == brute(rows, 5, 5)
