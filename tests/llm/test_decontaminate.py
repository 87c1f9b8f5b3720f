import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketweave.llm import decontaminate as D


def slow_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(text, items, window=13):
    words, hit, found = slow_words(text), set(), set()
    for item, t in items:
        iw = slow_words(t)
        n = min(len(iw), window)
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if n and tuple(words[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(1, 5))
@settings(max_examples=400, deadline=None)
def test_automaton_against_brute_force(items, words, window):
    named = [(k, " ".join(w)) for k, w in enumerate(items)]
    machine = D.Automaton(((str(k), [x.encode() for x in w]) for k, w in enumerate(items)), window)
    spans, found, longest = machine.hits([w.encode() for w in words])
    text = " ".join(words)
    _, hit, n, _, _ = slow(text, named, window)
    assert sum(b - a for a, b in spans) == hit and len(found) == n
    assert all(a < b <= c < d for (a, b), (c, d) in zip(spans, spans[1:]) for b, c in [(b, c)])
    runs = [w for w in items]
    best = max((j - i for i in range(len(words)) for j in range(i, len(words) + 1) if any(words[i:j] == r[k : k + j - i] for r in runs for k in range(len(r)))), default=0)
    assert longest == best


def test_words_follow_the_pattern():
    text = "Ab-c_d E1É\x85x y Ｚ «q» 9"
    assert [w.decode() for w in D.words_of(text.encode())] == slow_words(text)


def rows_and_items():
    rnd = random.Random(3)
    pool = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rnd.choice(pool) for _ in range(n))) for k, n in enumerate([20, 13, 12, 30, 3])] + [(5, None), (6, ""), (7, "!!!"), (None, "lonely short item")]
    items.append((8, items[0][1]))
    items.append((0, items[0][1]))
    rows = []
    for i in range(30):
        words = [rnd.choice(pool) for _ in range(rnd.randrange(300))]
        for _ in range(rnd.randrange(3)):
            source = rnd.choice([t for _, t in items if t]).split()
            at = rnd.randrange(len(words) + 1)
            words[at:at] = source[rnd.randrange(3) :]
        rows.append((i, ", ".join(words)))
    rows += [(90, None), (91, ""), (None, items[1][1]), (92, items[1][1].upper()), (92, items[1][1].upper()), (93, "x " * 50_000 + items[0][1])]
    return rows, items


def test_report_against_brute_force_and_blocks(spark, make_docs, monkeypatch):
    rows, items = rows_and_items()
    docs, bench = make_docs(rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    named = [(i, t) for i, t in items if t is not None]
    want = []
    for i, t in rows:
        n, hit, _, _, bad = slow(t, named)
        _, _, k, digest, _ = slow(t, [x for x in named if x[0] is not None])
        want.append((i if i is not None else -1, n, hit, k, digest, bad))
    for limit in (D.BLOCK_WORDS, 25):
        real = D.blocks
        monkeypatch.setattr(D, "blocks", lambda a, b, c, limit=limit: real(a, b, c, limit))
        got = D.report(docs, bench).drop("spans", "longest_match").collect()
        monkeypatch.undo()
        assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == sorted(want)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect() if r.text) == sorted((i if i is not None else -1, t) for (i, t), w in zip(rows, want) if t and not w[-1])
    assert D.report(docs.limit(0), bench).count() == 0 and D.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_strip_removes_only_hit_words(spark, make_docs):
    rows, items = rows_and_items()
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(i, t) for i, t in items if t]
    out = D.clean(make_docs(rows), bench, strip=True).collect()
    assert len(out) == len(rows)
    for r, (_, t) in zip(out, rows):
        n, hit, *_ = slow(t, named)
        assert len(slow_words(r.text)) == n - hit and (hit or r.text == t)


@pytest.mark.parametrize("strip", [False, True])
def test_many_blocks_equal_one(spark, make_docs, monkeypatch, strip):
    rnd = random.Random(17)
    pool = [f"w{i}" for i in range(500)]
    items = [(k, " ".join(rnd.choice(pool) for _ in range(rnd.choice([2, 7, 13, 14, 40])))) for k in range(120)]
    rows = []
    for i in range(150):
        words = [rnd.choice(pool) for _ in range(rnd.randrange(120))]
        for _ in range(rnd.choice([0, 0, 1, 3])):
            words += rnd.choice(items)[1].split()
        rows.append((i, " ".join(words)))
    rows += [(900 + k, rows[3][1]) for k in range(60)] + [(1000, None), (1001, ""), (None, items[2][1])]
    docs, bench = make_docs(rows).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda df: sorted(((str(r[0]), *r[1:]) for r in df.drop("spans").collect()))
    texts = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)
    want, left = plain(D.report(docs, bench)), texts(D.clean(docs, bench, strip=strip))
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    real = D.blocks
    monkeypatch.setattr(D, "blocks", lambda a, b, c: real(a, b, c, 100))
    detector = D._detector(bench, "item_id", "text", D.WINDOW)
    assert isinstance(detector, D.Blocks) and detector.items.select("block").distinct().count() >= 20
    assert plain(D.report(docs, bench)) == want
    out = D.clean(docs, bench, strip=strip)
    assert texts(out) == left and out.schema == docs.schema


def test_a_task_builds_a_block_once(spark, monkeypatch):
    """Counted on the rows that a task sees: items stand before the texts of their block."""
    monkeypatch.setattr(D, "BLOCK_WORDS", 13)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(13))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = D.Blocks(bench, "item_id", "text", 13)
    docs = spark.createDataFrame([(k, k, items[k % 40][1].encode() + f" tail{k}".encode()) for k in range(400)], "doc_id long, mark long, text binary")
    passed = blocks.passed(docs)
    assert blocks.items.select("block").distinct().count() >= 20
    found = blocks.found(passed).collect()
    assert len(found) == 400 and all(r["items"] == [str(r.mark % 40)] and [tuple(s) for s in r.spans] == [(0, 13)] and r.longest == 13 for r in found)


def test_window_hashes_are_those_of_the_runs():
    words = [f"w{i % 7}".encode() for i in range(30)]
    one, three, far = D.window_hashes(words, 13, [1, 3, 31])
    assert len(one) == 30 and len(three) == 28 and not len(far)
    (again,) = D.window_hashes(words[5:8], 13, [3])
    assert again[0] == three[5] and len(set(three.tolist())) == 7
