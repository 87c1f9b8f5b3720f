import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marketweave.llm import classlm as L


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    nouns, verbs, rare = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)], [f"r{i}x" for i in range(300)]
    rows = [(i, " ".join(f"The {rnd.choice(nouns)} {rnd.choice(verbs)} {rnd.choice(rare) if rnd.random() < 0.2 else rnd.choice(nouns)} ." for _ in range(rnd.randrange(1, 25)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "q" * 5000), (5, "repeated id"), (5, "repeated id"), (None, "no id é É")]


def test_exchange_never_lowers_the_likelihood_and_keeps_its_tables():
    rng = np.random.default_rng(2)
    m = rng.poisson(0.7, size=(60, 60)) * (rng.random((60, 60)) < 0.4)
    of, trail = L.exchange(m, classes=7, end_unit=59, sweeps=6)
    assert all(b >= a - 1e-6 for a, b in zip(trail, trail[1:])) and trail[-1] > trail[0]
    assert of[59] == 6 and (of[:59] < 6).all()
    hot = np.eye(7)[of]
    pairs = hot.T @ m @ hot
    x = lambda v: float((v * np.log(np.maximum(v, 1))).sum())
    assert trail[-1] == pytest.approx(x(pairs) - x(pairs.sum(0)) - x(pairs.sum(1)))


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(3)
    m = np.zeros((31, 31))
    for a in range(30):
        for b in range(30):
            if (a % 3 + 1) % 3 == b % 3:
                m[a, b] = rng.poisson(20)
    m[30, 0] = m[29, 30] = 1
    of, _ = L.exchange(m, classes=4, end_unit=30, sweeps=20)
    assert all(len(set(of[k:30:3])) == 1 for k in range(3))


@pytest.fixture(params=[262_144, 15])
def head(request, monkeypatch):
    monkeypatch.setattr(L, "HEAD", request.param)
    monkeypatch.setattr(L, "UNITS", L.UNITS)
    return request.param


def test_scores_against_brute_force(spark, make_docs, head):
    rows = corpus()
    docs = make_docs(rows).repartition(3)
    texts = docs.where(L.crc_mod(docs.doc_id, 5) != 1).select("text")
    vocab = L.stored(L.count_words(texts), "t")
    model = L.learn(texts, vocab)
    out = L.score(docs, model, vocab).collect()
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, types = sum(counts.values()), len(counts)
    assert {bytes(r.word).decode(): r.n for r in vocab.collect()} == {w: n for w, n in counts.items() if w is not None}
    units = L.Units((w, k) for k, w in enumerate(model.units))
    cls = lambda w: L.END_CLASS if w is None else int(model.of[units[w.encode()]])

    def chance(before, w):
        if w is None:
            return model.move[before, L.END_CLASS]
        if w not in counts:
            return model.unknown[before]
        return model.move[before, cls(w)] + math.log10((counts[w] - 0.5) / model.mass[cls(w)])

    want = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        score = sum(chance(cls(b), w) for b, w in zip([None, *ws], ws))
        want.append((i or -1, held(i), len(ws), sum(w in counts for w in ws), total, round(base, 6), round(score, 6)))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out) == sorted(want)
    far = [r for r in out if r.held_out]
    assert sum(r.score for r in far) > sum(r.base_score for r in far)
    # the model is a distribution over the known words, the end and an unknown word
    for before in range(L.CLASSES):
        if model.mass[before]:
            assert sum(10 ** chance(before, w) for w in counts) + 10 ** model.unknown[before] == pytest.approx(1, abs=1e-3)


def test_words_outside_the_seeds_have_classes_of_their_own(spark, make_docs, monkeypatch):
    monkeypatch.setattr(L, "UNITS", 30)
    monkeypatch.setattr(L, "ALL", 30 + L.BINS + 1)
    monkeypatch.setattr(L, "END_UNIT", 30 + L.BINS)
    monkeypatch.setattr(L.exchange, "__defaults__", (L.CLASSES, 30 + L.BINS, L.SWEEPS))
    rnd = random.Random(8)
    a, b = [f"a{i}same" for i in range(60)], [f"b{i}same" for i in range(60)]  # one ending, two uses
    rows = []
    for i in range(400):
        rows.append((i, " ".join(f"left{rnd.randrange(3)} {rnd.choice(a)} right{rnd.randrange(3)} up{rnd.randrange(3)} {rnd.choice(b)} down{rnd.randrange(3)}" for _ in range(12))))
    docs = make_docs(rows).repartition(3)
    texts = docs.where(L.crc_mod(docs.doc_id, 5) != 1).select("text")
    vocab = L.stored(L.count_words(texts), "t")
    model = L.learn(texts, vocab)
    words = {w for i, t in rows if not held(i) for w in t.split()}
    assert {w.decode() for w in model.units} == words  # each by itself, however many there are
    of = {w.decode(): int(c) for w, c in zip(model.units, model.of)}
    rest = [w for w in words if w not in {x.decode() for x in model.classes.words[:30]}]
    assert not {of[w] for w in rest if w[0] == "a"} & {of[w] for w in rest if w[0] == "b"}
    key = lambda df: sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    assert key(L.score_all(docs)) == key(L.score(docs, model, vocab))


def test_the_head_is_filled_among_words_of_equal_count(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 1000)
    vocab = spark.range(3000).selectExpr("cast(cast(id as string) as binary) as word", "case when id < 40 then 9L else 2L end as n")
    words, counts, inside = L.head_of(vocab)
    assert 960 <= len(words) <= 1000 and counts[:40].tolist() == [9] * 40
    assert {bytes(r.word) for r in vocab.where(inside).collect()} == set(words)
    assert vocab.where(~inside).count() == 3000 - len(words)
    assert L.head_of(vocab.where("n = 0"))[0] == []


def test_sums_and_lists_of_neighbours_give_one_table(spark, make_docs, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 200)
    monkeypatch.setattr(L, "UNITS", 30)
    monkeypatch.setattr(L, "ALL", 30 + L.BINS + 1)
    monkeypatch.setattr(L, "END_UNIT", 30 + L.BINS)
    monkeypatch.setattr(L.exchange, "__defaults__", (L.CLASSES, 30 + L.BINS, L.SWEEPS))
    long_word = "=" * 100  # longer than a word of the head may be, in every text
    texts = make_docs([(i, f"{t or ''} {long_word} x{(i or 0) % 7}") for i, t in corpus()]).repartition(3).select("text")
    vocab = L.stored(L.count_words(texts), "t")
    found = []
    for hot in (10**9, 2):
        monkeypatch.setattr(L, "HOT", hot)
        found.append(L.classify(texts, vocab))
    a, b = (sorted((bytes(r.word), r.n, r.cls) for r in c.table.collect()) for c in found)
    assert a == b and L.short(long_word.encode()) in found[0].words
    assert {w: n for w, n, _ in a} == {bytes(r.word): r.n for r in vocab.collect() if bytes(r.word) not in found[0].words[:30]}


def test_empty_and_no_training(spark, make_docs):
    assert L.score_all(make_docs([]).select("doc_id", "text")).count() == 0
    only = [i for i in range(60) if held(i)][:3]
    rows = L.score_all(make_docs([(i, "a b") for i in only])).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in rows)
