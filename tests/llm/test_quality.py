import itertools
import random
import zlib

import numpy as np
import pytest

from marketweave.llm import quality as Q


def brute_chain(scores, pairs):
    n, total, good, both = len(scores), 0.0, np.zeros(len(scores)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(s for s, k in zip(scores, y) if k) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
        for a, b in zip(y, y[1:]):
            both[a, b] += p
    return good / total, both / total, np.log(total)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 4, 2, 7, 1, 3])
    scores, pairs = rng.normal(size=sizes.sum()) * 3, rng.normal(size=(2, 2))
    good, both, log_z = Q.forward_backward(scores, pairs, sizes)
    at = 0
    for k, n in enumerate(sizes):
        g, b, z = brute_chain(scores[at : at + n], pairs)
        assert np.allclose(good[at : at + n], g) and np.allclose(both[k], b) and np.isclose(log_z[k], z)
        at += n


def rows(n=400):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        bad = rnd.random() < 0.3
        lines = []
        for _ in range(rnd.randrange(1, 9)):
            words = [rnd.choice(["alpha", "beta", "gamma", "Delta", "epsilon"]) for _ in range(rnd.randrange(3, 20))]
            lines.append(" ".join(w + rnd.choice(["%%%", "***"]) for w in words) if bad and rnd.random() < 0.8 else " ".join(words) + ".")
        out.append((i, "\n".join(lines), int(not bad)))
    return out


def test_held_out_accuracy_and_edges(spark, make_docs):
    data = rows()
    odd = [(None, "fine words here."), (1000, None), (1001, ""), (1002, "\n \n"), (1003, "word " * 200_000), (3, data[3][1])]
    docs = make_docs([(i, t) for i, t, _ in data] + odd)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(1, 1 - data[1][2], 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    out = Q.scored(docs, model).collect()
    assert len(out) == len(data) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = {i: q for i, _, q in data}
    far = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in far]) > 0.9
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert Q.scored(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, make_docs):
    data = rows(120)
    docs = make_docs([(i, t) for i, t, _ in data])
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q
    a = Q.train(docs, spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int"))
    b = Q.train(docs, spark.createDataFrame([(i, flip(i, q)) for i, _, q in data], "doc_id long, quality int"))
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope


@pytest.mark.parametrize(("marks", "want"), [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_one_sided_labels(spark, make_docs, marks, want):
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = make_docs([(i, "some text") for i in ids[:3]])
    labels = spark.createDataFrame(list(zip(ids, marks)), "doc_id long, quality int")
    assert {r.score for r in Q.scored(docs, Q.train(docs, labels)).collect()} == {want}


def test_bounds_of_the_sample(spark, make_docs):
    data = rows(150)
    docs, labels = make_docs([(i, t) for i, t, _ in data]), spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    assert Q.train(docs, labels, max_docs=20, max_lines=40).weights.any()
