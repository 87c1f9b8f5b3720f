import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from marketweave.llm import simhash as S


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def check(spark, prints, **args):
    fps = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = S.links(df, **args)
    got = {r.node: r.root for r in S.components(edges).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    groups = slow_components(fps)
    want = {}
    for g in set(groups):
        members = [signed[i] for i in range(len(fps)) if groups[i] == g]
        want |= {m: min(members) for m in members}
    assert {f: got.get(f, f) for f in signed} == want


@given(st.lists(st.sampled_from(["a", "B", "é", "Zz", "\x85", " ", "\t", "\n", "x y z", "İ"]), max_size=40))
@settings(max_examples=80, deadline=None)
def test_fingerprint_matches_definition(parts):
    text = " ".join(parts)
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_fingerprint_null_empty_and_long():
    assert S.fingerprint(None) == S.fingerprint(b"") == S.fingerprint(b" \n") == 0
    text = " ".join(f"w{i % 1700}" for i in range(S.BLOCK + 999))
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def random_prints(seed, centers, spread, n):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(centers)]
    out = []
    for _ in range(n):
        f = rnd.choice(base)
        for _ in range(rnd.randrange(spread)):
            f ^= 1 << rnd.randrange(64)
        out.append(f)
    return out


def test_links_against_brute_force(spark):
    check(spark, random_prints(1, 30, 6, 400))


def test_hot_buckets_lose_no_link(spark):
    check(spark, random_prints(2, 3, 7, 300), bucket=4)


def test_every_pair_within_two_bits_shares_a_viable_start(spark):
    rnd, rows = random.Random(3), []
    for i in range(64):
        for j in range(i, 64):
            a = rnd.getrandbits(64)
            rows.append((a, a ^ (1 << i) ^ (1 << j) if i != j else a ^ (1 << i)))
    s64 = lambda x: int(np.uint64(x).astype(np.int64))
    pairs = {tuple(sorted((s64(a), s64(b)))) for a, b in rows}
    df = spark.createDataFrame([(f,) for p in pairs for f in p], "fp long").distinct()
    assert pairs <= {(r.u, r.v) for r in S.links(df).collect()}


def test_chain_makes_one_component(spark):
    fps, f = [0], 0
    for i in range(0, 60, 2):
        f ^= 3 << i
        fps.append(f)
    check(spark, fps)


def test_documents_edge_cases(spark):
    rows = [(9, "A b c d"), (3, "a B c d"), (3, "a B c d"), (None, None), (7, ""), (8, "one two"), (None, "a b c d")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.fp, r.component_id) for r in S.near_duplicates(df).collect())
    want = []
    for i, t in rows:
        f = slow_fingerprint(t)
        same = [j for j, u in rows if j is not None and (slow_fingerprint(u) ^ f).bit_count() <= 2]
        want.append((i or -1, int(np.uint64(f).astype(np.int64)), min(same)))
    assert got == sorted(want)
    assert S.near_duplicates(df.limit(0)).count() == 0


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_groups(rows):
    """(links between distinct sets, component number of each row)"""
    sets = [slow_set(t) for _, t in rows]
    links = {(a, b) for a in set(sets) for b in set(sets) if a != b and len(a & b) >= 0.8 * len(a | b) - 1e-9}
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return links, [find(s) for s in sets], sets


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def near_copies(seed, groups, copies, edits, length=120):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rnd.randrange(3000)}" for _ in range(length)]
        rows += [(len(rows) + k, edited(rnd, words, rnd.randrange(edits))) for k in range(copies)]
    rnd.shuffle(rows)
    return rows


def held_against_slow(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, groups, sets = slow_groups(rows)
    got = {r.doc_id: r.component_id for r in S.similar_groups(df).collect()}
    of = {s: got[i] for (i, _), s in zip(rows, sets)}
    slow = {}
    for (i, _), g in zip(rows, groups):
        slow.setdefault(g, set()).add(i)
    for (i, _), g in zip(rows, groups):
        assert got[i] in slow[g]  # no false link
    found = sum(of[a] == of[b] for a, b in links)
    assert found >= least * len(links)
    return got


def test_near_copies_are_found(spark):
    held_against_slow(spark, near_copies(1, 60, 5, 4), 0.95)


def test_pairs_near_the_threshold(spark):
    rnd, rows = random.Random(5), []
    for g in range(150):  # pairs that differ in one stretch: 0.8 to 0.85 alike
        words = [f"w{rnd.randrange(10**5)}" for _ in range(100)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[: 100 - rnd.randrange(8, 11)] + [f"n{rnd.randrange(10**6)}" for _ in range(10)]))]
    held_against_slow(spark, rows, 0.9)


def test_one_large_group_of_near_copies_and_what_stands_apart(spark):
    rows = near_copies(2, 1, 300, 3)
    rows += [(10_000 + i, t) for i, t in near_copies(3, 40, 2, 6, 60)]
    got = held_against_slow(spark, rows, 0.95)
    assert len({got[i] for i, _ in rows if i < 10_000}) == 1


def test_blocks_link_what_pairs_link(spark, monkeypatch):
    rows = near_copies(6, 2, 70, 14, 90)  # most copies are just above or below the similarity
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "layout", lambda *a: S.Layout(8, 8, 12, 0.8))
    want = held_against_slow(spark, rows, 0.95)
    monkeypatch.setattr(S, "PAIRED", 2)
    monkeypatch.setattr(S, "BLOCK_SETS", 10)
    assert {r.doc_id: r.component_id for r in S.similar_groups(df).collect()} == want


def test_keep_one_decides_by_row(spark):
    rnd = random.Random(8)
    a, b = ([f"w{rnd.randrange(10**5)}" for _ in range(80)] for _ in range(2))
    near, other = edited(rnd, a, 1), " ".join(b)
    rows = [(3, " ".join(a)), (5, near), (5, other)]
    orders = [(20 * k, [0, 1, 2][k:] + [0, 1, 2][:k]) for k in range(3)]  # each in its own words, all in one table
    turned = lambda t, k: " ".join(f"{w}t{k}" for w in t.split())
    table = [(rows[x][0] + by, turned(rows[x][1], by)) for by, order in orders for x in order]
    got = sorted((r.doc_id, r.text) for r in S.keep_one(spark.createDataFrame(table, "doc_id long, text string").coalesce(1)).collect())
    assert got == [(i + by, turned(t, by)) for by, _ in orders for i, t in (rows[0], rows[2])]
    rows += [(5, other), (None, near), (None, "only here"), (None, "only here"), (7, None), (8, " \n"), (9, "ONLY here")]
    df = spark.createDataFrame([(i, t, {"k": "v"}, "x", "y") for i, t in rows], "doc_id long, text string, extra map<string,string>, mark string, _kept string")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, rows[0][1]), (5, other), (7, None), (9, "ONLY here")]
    assert kept.schema == df.schema and S.keep_one(df.limit(0)).count() == 0
    bare = spark.createDataFrame([(None, "a b"), (None, "a  b"), (None, "a b")], "doc_id string, text string")
    assert S.keep_one(bare).count() == 1


def test_keep_one_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    rows = near_copies(4, 5, 4, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = S.keep_one(df)
    assert "BroadcastExchange" not in plan._jdf.queryExecution().optimizedPlan().toString()
    links, groups, _ = slow_groups(rows)
    assert plan.count() == len(set(groups))


def test_layout_keeps_its_recall_at_every_size():
    for n in (1, 10**3, 10**6, 10**9):
        shape = S.layout(n)
        agree = 1 - np.arccos(1.6 / 1.8) / np.pi
        assert 1 - (1 - agree**shape.bits) ** (shape.per * shape.words) >= 0.95 and shape.bits >= min(np.log2(n), 40)


def test_texts_go_to_python_in_short_batches(spark, monkeypatch):
    name, seen, stored = "spark.sql.execution.arrow.maxBytesPerBatch", [], S.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(S, "stored", lambda df, label: (seen.append((label, spark.conf.get(name))), stored(df, label))[1])
    df = spark.createDataFrame(near_copies(9, 4, 3, 2), "doc_id long, text string")
    assert S.similar_groups(df).count() == 12
    assert {"simhash-sets", "simhash-grams"} <= {label for label, _ in seen} and {size for _, size in seen} == {str(S.BATCH_BYTES)}
    assert spark.conf.get(name) == before


def test_long_text_sketch():
    text = " ".join(f"w{i}" for i in range(100_000)).encode()
    s = S.shingle_set(text)
    assert len(s) == 99_996 and len(S.wide_fingerprint(s, 3)) == 3
    assert S.shingle_set(b"a b").tolist() == S.shingle_set(b"A\tb").tolist() and len(S.shingle_set(b"a b")) == 1 and len(S.shingle_set(None)) == 0


def test_each_segment_moves_once(spark, monkeypatch):
    seen, stored = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, label: (seen.setdefault(label, df._jdf.queryExecution().executedPlan().toString()), stored(df, label))[1])
    held_against_slow(spark, near_copies(9, 4, 3, 2), 0.95)
    plan = seen["simhash-segments"]
    assert plan.count("Exchange hashpartitioning(key") == 1 and "Join" not in plan
    assert "Join" not in seen["simhash-mixed"].split("Exchange hashpartitioning(key")[0]


def test_segment_words_tell_sizes_and_rings_apart(spark):
    rnd = random.Random(12)
    for shape in (S.Layout(16, 4, 2, 0.8), S.Layout(18, 3, 2, 0.8), S.Layout(40, 1, 2, 0.8), S.Layout(32, 2, 2, 0.5)):
        used = shape.bits * shape.per
        rows = []
        for i in range(60):  # each with a partner that has some other bits and another size
            fp, n = [rnd.getrandbits(64) for _ in range(2)], rnd.choice([0, 1, 5, 100, 10**4, 10**9])
            near = [f ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 5))) for f in fp]
            rows += [(2 * i, n, fp), (2 * i + 1, int(n * rnd.choice([0.3, shape.similarity, 0.9, 1])) if n > 1 else n, near)]
        signed = [(i, n, [int(np.uint64(f % 2**64).astype(np.int64)) for f in fp]) for i, n, fp in rows]
        got = S._segments(spark.createDataFrame(signed, "sid long, n long, fp array<long>"), shape)
        a, b = (got.selectExpr("key", "sid as s" + x, "word as w" + x) for x in "ab")
        pairs = a.join(b, "key").where("sa % 2 = 0 and sb = sa + 1").select("key", "sa", S._within_ring(S.F.col("wa"), S.F.col("wb"), shape).alias("ok")).collect()
        of, keys = {i: (n, fp) for i, n, fp in rows}, {(r.key, r.sa): r.ok for r in pairs}
        for i in range(60):
            (n, fp), (m, near) = of[2 * i], of[2 * i + 1]
            for t in range(2 * shape.per):
                w, j = divmod(t, shape.per)
                ring = lambda f: [f[w] >> (j * shape.bits + k) % used & 1 for k in range(used)]  # noqa: B023, E731
                x, y = ring(fp), ring(near)
                key = t << shape.bits | sum(v << k for k, v in enumerate(x[: shape.bits]))
                ok = keys.get((key, 2 * i))
                assert (ok is not None) == (x[: shape.bits] == y[: shape.bits])
                if ok is not None:
                    chains = all(sum(p != q for p, q in zip(x[: shape.bits * k], y[: shape.bits * k])) <= int(S.RATIO * shape.bits * k) for k in range(2, shape.per + 1))
                    sized = min(n, m) >= shape.similarity * max(n, m) - 1e-9
                    assert ok or not (chains and sized)
                    assert not ok or chains and min(n, m) >= 0.9 * shape.similarity * max(n, m) - 1
