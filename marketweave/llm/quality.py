"""Document quality by a linear-chain conditional random field over lines.

Every line gets one of two labels, bad (0) or good (1). A line's features are bins of
what its bytes look like (shares of capitals, symbols, digits and so on, length,
repetition), each taken from the line itself, the line before and the line after. The
field has a weight for each bin and for each pair of neighbouring labels.

Training: a bounded sample of labelled documents (TRAIN_DOCS documents and TRAIN_LINES
lines at most, the first by a hash of the id, passing over those that no longer fit) whose lines carry their document's label;
the conditional likelihood is climbed on the driver with exact forward-backward
gradients. Scoring: forward-backward gives each line's chance of being good; their mean
weighted by length is the document's quality, mapped to a probability by a two-parameter
logistic curve that is fitted on the same sample. Scoring reads every line of every
text, without a shuffle.

Defined cases: a null or empty text is one empty line; blank lines are skipped where
others exist; repeated rows each get a row; null ids are scored like others and never
sampled; ids with conflicting labels and null labels are not learned from; without any
usable label, or with labels of one kind only, every score is the share of label 1
(0.5 if there are none); columns other than id and text are not read by the score.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.common import crc_mod, table

TRAIN_DOCS = 4000
TRAIN_LINES = 100_000
THRESHOLD = 0.7
FOLDS, HELD = 4, 2
STEPS = 120
RATE = 0.2
RIDGE = 2e-3

BINS = 9  # the last: no such neighbour
KINDS = 14
_CUTS = (0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = bytes(range(0x30, 0x3A))
_MARKS = b",.;:'\"-()?"
_SPACES = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(0x80, 0x100))
_SYMBOLS = bytes(b for b in range(0x80) if b not in _UPPER + _LOWER + _DIGIT + _MARKS + _SPACES)


def line_features(line: bytes, seen: set[bytes]) -> list[int]:
    """KINDS bins below BINS - 1."""
    size = len(line)
    n = size or 1
    upper, symbols = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _SYMBOLS))
    digits, marks = size - len(line.translate(None, _DIGIT)), size - len(line.translate(None, _MARKS))
    high, shouts = size - len(line.translate(None, _HIGH)), line.count(b"!")
    words = line.split()
    m = len(words) or 1
    share = [bisect_right(_CUTS, x / n) for x in (upper, symbols, digits, marks, high)]
    again = line in seen
    seen.add(line)
    return [
        *share,
        bisect_right(_CUTS, min(1.0, shouts / m)),
        min(7, len(words).bit_length()),
        min(7, int(8 * len(set(words)) / m) if words else 0),
        min(7, size // m // 2),
        bisect_right(_CUTS, symbols / m / 4),
        int(line[-1:] in (b".", b"?", b"!", b'"', b":")),
        int(line[:1].isupper()),
        int(again),
        bisect_right(_CUTS, sum(map(eq, words, words[1:])) / m),
    ]


def lines_of(text: bytes | None) -> list[bytes]:
    return [x for x in (text or b"").split(b"\n") if x.strip()] or [b""]


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins of each line [lines, KINDS], length of each line)"""
    lines, seen = lines_of(text), set()
    rows = np.array([line_features(x, seen) for x in lines], np.uint8)
    return rows, np.array([len(x) + 1 for x in lines], np.int64)


class Batch(NamedTuple):
    """Lines of several documents: ``index`` [lines, 3 * KINDS] into the weights, document starts, lengths."""

    index: np.ndarray
    sizes: np.ndarray
    lengths: np.ndarray


def batch_of(documents: list[tuple[np.ndarray, np.ndarray]]) -> Batch:
    sizes = np.array([len(r) for r, _ in documents], np.int64)
    own = np.concatenate([r for r, _ in documents]).astype(np.int64)
    ends = np.cumsum(sizes)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[ends - sizes] = BINS - 1
    after[ends - 1] = BINS - 1
    index = np.concatenate([before, own, after], axis=1) + np.arange(3 * KINDS) * BINS
    return Batch(index, sizes, np.concatenate([n for _, n in documents]))


class Model(NamedTuple):
    weights: np.ndarray  # [3 * KINDS * BINS], in favour of good
    pairs: np.ndarray  # [2, 2], of neighbouring labels
    slope: float
    offset: float
    constant: float | None = None


def forward_backward(scores: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of good of each line, summed pair marginals [documents, 2, 2], log partition of each document).

    All documents advance together, a line at a time; messages are normalised.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    n, live = sizes[order], np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
    unary = np.stack([np.zeros_like(scores), scores], axis=1)
    top = unary.max(axis=1, keepdims=True)
    unary, log_z = np.exp(unary - top), np.zeros(len(sizes))
    move = np.exp(pairs - pairs.max())
    alpha = np.empty_like(unary)
    beta = np.ones_like(unary)
    for t, k in enumerate(live):
        at = starts[:k] + t
        a = unary[at] * (alpha[at - 1] @ move if t else 1.0)
        z = a.sum(axis=1, keepdims=True)
        alpha[at] = a / z
        log_z[:k] += np.log(z[:, 0]) + top[at, 0] + (pairs.max() if t else 0.0)
    both = np.zeros((len(sizes), 2, 2))
    for t in range(len(live) - 1, 0, -1):
        k = live[t]
        at = starts[:k] + t
        into = unary[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * move * into[:, None, :]
        both[:k] += joint / joint.sum(axis=(1, 2), keepdims=True)
        b = into @ move.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    back = np.empty(len(sizes), np.int64)
    back[order] = np.arange(len(sizes))
    return post[:, 1] / post.sum(axis=1), both[back], log_z[back]


def marginals(model: Model, batch: Batch) -> np.ndarray:
    return forward_backward(model.weights[batch.index].sum(axis=1), model.pairs, batch.sizes)[0]


def aggregate(batch: Batch, good: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, for each document."""
    starts = np.cumsum(batch.sizes) - batch.sizes
    return np.add.reduceat(good * batch.lengths, starts) / np.add.reduceat(batch.lengths, starts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def score(model: Model, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if model.constant is not None or not documents:
        return np.full(len(documents), model.constant or 0.0)
    batch = batch_of(documents)
    x = _logit(aggregate(batch, marginals(model, batch)))
    return 1 / (1 + np.exp(-(model.slope * x + model.offset)))


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    """Climb the conditional likelihood of the lines' labels (Adam, fixed steps), then fit the curve."""
    weights, pairs = np.zeros(3 * KINDS * BINS), np.zeros((2, 2))
    if len(set(labels)) < 2:
        return Model(weights, pairs, 1.0, 0.0, float(np.mean(labels)) if labels else 0.5)
    batch, y = batch_of(documents), np.array(labels, np.float64)
    line_y = np.repeat(y, batch.sizes)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (batch.sizes[y == 0] - 1).sum(), (batch.sizes[y == 1] - 1).sum()
    lines, flat = len(line_y), batch.index.ravel()
    state = [np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)]
    for step in range(1, STEPS + 1):
        good, both, _ = forward_backward(weights[batch.index].sum(axis=1), pairs, batch.sizes)
        error = np.repeat(line_y - good, batch.index.shape[1])
        grad = np.concatenate([np.bincount(flat, error, len(weights)), (seen - both.sum(axis=0)).ravel()]) / lines
        grad -= RIDGE * np.concatenate([weights, pairs.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights, pairs = weights + move[:-4], pairs + move[-4:].reshape(2, 2)
    x = _logit(aggregate(batch, marginals(Model(weights, pairs, 1.0, 0.0), batch)))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((y - p) * x).sum() - 0.1 * (slope - 1), (y - p).sum() - 0.1 * offset])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        slope, offset = slope + np.clip(d[0], -1, 1), offset + np.clip(d[1], -1, 1)
    return Model(weights, pairs, max(float(slope), 1e-3), float(offset))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> Model:
    """Fit on labelled documents outside the held-out fold; only bins of the bounded sample reach the driver."""
    picked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    sure = picked.where(crc_mod(F.col("doc_id"), FOLDS) != HELD).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    rows = sure.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    if not rows:
        return fit([], [])
    known = {r.doc_id: int(r.y > 0) for r in rows}
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_features(t.as_py()) for t in batch.column(1)]
            # a document of more lines than the whole bound can't be used: one line more tells so
            columns = [batch.column(0), pa.array([r[: max_lines + 1].tobytes() for r, _ in found], pa.binary()), pa.array([n[: max_lines + 1].tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "bins", "lengths"])

    # at most max_docs ids are broadcast; only their texts leave the scan
    chosen = docs.sparkSession.createDataFrame([(i,) for i in known], f"doc_id {labels.schema[doc_id].dataType.simpleString()}")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")
    sample = texts.mapInArrow(run, f"doc_id {kind}, bins binary, lengths binary").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    documents, marks, lines = [], [], 0
    for r in sample.toLocalIterator():
        bins, lengths = np.frombuffer(r.bins, np.uint8).reshape(-1, KINDS), np.frombuffer(r.lengths, np.int64)
        if lines + len(bins) > max_lines:
            continue  # the bound is on all lines: a long document must not end the sample
        lines += len(bins)
        documents.append((bins, lengths))
        marks.append(known[r.doc_id])
    return fit(documents, marks)


def _scores(model: Model, texts: list[bytes | None]) -> np.ndarray:
    return score(model, [document_features(t) for t in texts])


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(shared.value, batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(shared.value, batch.column(place).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
