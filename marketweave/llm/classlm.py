"""Language-model scoring with Brown class-based bigrams.

The model: P(word | previous) = P(class | previous class) * P(word | class).

Counting covers all training texts. The counts of all words are a table in the shared
folder. Classes come in two steps:

* Seeds. Each of the UNITS most frequent words is a unit by itself, and every other word
  stands in the bin of its ending (a fixed hash of its last bytes). Unit bigrams are counted in
  every training text; exchange clustering on their matrix, which has a fixed size, moves
  one unit after another to the class that most raises the class-bigram likelihood, until
  no move helps or SWEEPS are over.
* All other training words, each by itself. The classes before and after every occurrence are
  brought together by word in Spark, and each word moves to the class under which these
  neighbours and the word itself are likeliest, the seeds' class bigrams being held fixed: one block
  of distributed exchange moves. The table of classes has a row for every such word, so it grows
  with the corpus. Only words unseen in training keep the class of their ending. Words of the head
  with at least HOT occurrences are summed as (word, side and class) counts, so no row holds all the
  neighbours of a frequent word.

The class bigrams of the model are then counted anew over all training texts.

Smoothing: class transitions are interpolated with the class frequencies (weight
PRIOR); within each class every word's count is discounted by DISCOUNT, and the mass
set free is the chance of an unknown word. The end of a text is a class of its own and the
context of the first word.

Texts are coded as a class for each word in one pass with a broadcast of fixed size: the HEAD
most frequent words with their counts and classes, cut by a hash among words of about equal
count. Words of more than WORD_BYTES bytes go by a digest of 17 bytes that begins with a space, which
no word holds, so that they take part whatever their length. Words outside the head are joined with
the table of classes (a shuffle by word; none of these words is frequent in training,
and Spark splits a partition that a word outside training makes large) and put in
their places by text. Bigrams and scores are read off the codes.

Defined cases: null and empty texts are one end token; repeated rows each get a row; a
null doc_id is hashed as the empty text for its fold; without training texts every token
has log10 probability 0 in both models (one type); other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.common import crc_mod, discard, lower_words, stored, table

FOLDS, HELD = 5, 1
UNITS = 1535
BINS = 512
ALL = UNITS + BINS + 1
END_UNIT = ALL - 1
ENDING = 3
CLASSES = 64
END_CLASS = CLASSES - 1
SWEEPS = 8
PRIOR = 20.0
DISCOUNT = 0.5
HEAD = 262_144
CELLS = 65_536
HOT = 4_096
WORD_BYTES = 64
FLUSH = 250_000
CODES = 1 << 20
STEP = 1 << 18
UNKNOWN = 64  # flag beside a class in the code of a word unseen in training


def short(word: bytes) -> bytes:
    """The word, or the digest that a long one goes by."""
    return word if len(word) <= WORD_BYTES else b" " + hashlib.md5(word).digest()


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, long ones as their digests."""
    words = lower_words(text)
    return list(map(short, words)) if words and max(map(len, words)) > WORD_BYTES else words


def unit_bin(word: bytes) -> int:
    """Place of the word's bin, from the end: the same whatever the number of words before the bins."""
    if len(word) > WORD_BYTES:
        word = short(word)
    return -2 - zlib.crc32(word[-ENDING:]) % BINS


class Units(dict):
    """Word -> unit; other words than those it is given go by their ending."""

    def __missing__(self, word: bytes) -> int:
        return unit_bin(word)


class Places(dict):
    """Word -> place in the head, or -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of flat cut at ends (from 0 on) as an Arrow array."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (word, n) over all texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            counts.clear()
            for a in range(0, len(items), 50_000):
                part = items[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(t))
                if len(counts) >= FLUSH:
                    yield from out()
        yield from out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_unit_pairs(texts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Matrix [ALL, ALL] of unit bigrams over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units((w, i) for i, w in enumerate(shared.value))
        matrix = np.zeros(ALL * ALL, np.int64)
        codes: list[int] = []

        def add() -> None:
            u = np.array(codes, np.int64) % ALL
            codes.clear()
            if len(u):
                np.add.at(matrix, np.concatenate([[END_UNIT], u[:-1]]) * ALL + u, 1)

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                codes.extend(map(units.__getitem__, words_of(t)))
                codes.append(END_UNIT)  # the next text begins after an end
                if len(codes) >= CODES:
                    add()
        add()
        rows = [(u, row) for u, row in enumerate(matrix.reshape(ALL, ALL)) if row.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in rows], pa.int32()), pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() for _, r in rows], pa.binary()), pa.array([r[r > 0].tobytes() for _, r in rows], pa.binary())],
            ["unit", "at", "n"],
        )

    def total(group: pa.Table) -> pa.Table:
        row = np.zeros(ALL, np.int64)
        for at, n in zip(group.column("at").to_pylist(), group.column("n").to_pylist()):
            row[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        return pa.table({"unit": group.column("unit")[:1], "n": pa.array([row.tobytes()], pa.binary())})

    counted = texts.select("text").mapInArrow(run, "unit int, at binary, n binary").groupBy("unit").applyInArrow(total, "unit int, n binary")
    matrix = np.zeros((ALL, ALL), np.int64)
    for r in counted.toLocalIterator():  # ALL rows of a fixed size
        matrix[r.unit] = np.frombuffer(r.n, np.int64)
    return matrix


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(matrix: np.ndarray, classes: int = CLASSES, end_unit: int = END_UNIT, sweeps: int = SWEEPS) -> tuple[np.ndarray, list[float]]:
    """(class of each unit, likelihood after each sweep). The end keeps the last class to itself."""
    m = matrix.astype(np.float64)
    n = len(m)
    mass = m.sum(axis=1) + m.sum(axis=0)
    order = [u for u in np.argsort(-mass, kind="stable").tolist() if u != end_unit]
    free = classes - 1
    of = np.zeros(n, np.int64)
    for place, u in enumerate(order):
        of[u] = place if place < free else place % free
    of[end_unit] = classes - 1
    hot = np.zeros((n, classes))
    hot[np.arange(n), of] = 1.0
    right, left = m @ hot, hot.T @ m  # unit -> class, class -> unit
    pairs = hot.T @ right
    own, trail = np.diag(m).copy(), []

    def likelihood() -> float:
        return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())

    trail.append(likelihood())
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not mass[u]:
                continue
            a = of[u]
            r, l, s = right[u].copy(), left[:, u].copy(), own[u]
            r[a] -= s  # neighbours other than u itself
            l[a] -= s
            pairs[a] -= r
            pairs[:, a] -= l
            pairs[a, a] -= s
            hx = _xlogx(pairs)
            rows, cols = _xlogx(pairs + r) - hx, _xlogx(pairs + l[:, None]) - hx
            d = np.diag(pairs)
            gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + _xlogx(d + r + l + s) - _xlogx(d)
            out, into = pairs.sum(axis=1), pairs.sum(axis=0)
            ru, lu = r.sum() + s, l.sum() + s
            gain -= _xlogx(out + ru) - _xlogx(out) + _xlogx(into + lu) - _xlogx(into)
            # each other class gains a neighbour whatever the class of u is: the rest is constant
            b = int(gain[:free].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += r
            pairs[:, b] += l
            pairs[b, b] += s
            if b != a:
                moved += 1
                of[u] = b
                right[:, a] -= m[:, u]
                right[:, b] += m[:, u]
                left[a] -= m[u]
                left[b] += m[u]
        trail.append(likelihood())
        if not moved:
            break
    return of, trail


class Classes(NamedTuple):
    """The class of every training word: the head's here, all others' in ``table``."""

    seeds: int  # the first so many words of the head
    of: np.ndarray  # class of each unit
    words: list[bytes]  # the head
    counts: np.ndarray
    cls: np.ndarray  # class of each word of the head
    inside: Column  # over columns word and n: the word is one of the head
    table: DataFrame  # rows (word, n, cls) of every training word but the seeds


class Model:
    def __init__(self, classes: Classes, move: np.ndarray, unknown: np.ndarray, mass: np.ndarray, tokens: int, types: int, ends: int):
        self.classes = classes
        self.move = move  # log10 P(class | previous class)
        self.unknown = unknown  # log10 P(an unknown word | previous class)
        self.mass = mass  # count of each class
        self.tokens, self.types, self.ends = tokens, types, ends

    @cached_property
    def _named(self) -> tuple[list[bytes], np.ndarray]:
        c, rows = self.classes, self.classes.table.select("word", "cls").collect()
        of = np.concatenate([c.of[: c.seeds], np.array([r.cls for r in rows], np.int64), c.of[UNITS:]])
        return c.words[: c.seeds] + [bytes(r.word) for r in rows], of

    @property
    def units(self) -> list[bytes]:
        """All training words, gathered for a look at small models; learning and scoring don't use it."""
        return self._named[0]

    @property
    def of(self) -> np.ndarray:
        """Class of each of ``units``, of the bins and of the end."""
        return self._named[1]


def head_of(vocab: DataFrame) -> tuple[list[bytes], np.ndarray, Column]:
    """The most frequent words, at most HEAD, by count, and the condition that a word is one of them.

    A histogram of counts by sixteenths of an octave gives the bins that fit whole. The bin that
    HEAD falls into gives the words of its first hash cells, as many as fit (all but less than
    a cell of them), however many words share a count. So nothing is sorted and only the
    head itself reaches the driver.
    """
    size, cell = F.floor(F.log2("n") * 16), F.pmod(F.xxhash64("word"), F.lit(CELLS))
    inside, kept = F.lit(False), 0
    for r in sorted(vocab.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        if kept + r.words > HEAD:
            cells, cut = vocab.where(size == r.size).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("words")).collect(), 0
            for c in sorted(cells):  # at most CELLS rows
                if kept + c.words > HEAD:
                    break
                cut, kept = c.cell + 1, kept + c.words
            inside = inside | ((size == r.size) & (cell < cut))
            break
        inside, kept = size >= r.size, kept + r.words
    found = vocab.where(inside).select("word", "n").toArrow()
    words, counts = found.column("word").to_pylist(), found.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    return [words[k] for k in order], counts[order].astype(np.int64), inside


def _smoothed(pairs: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """P(class | previous class)."""
    return (pairs + PRIOR * mass / max(mass.sum(), 1.0)) / (pairs.sum(axis=1, keepdims=True) + PRIOR)


def neighbours(texts: DataFrame, head: list[bytes], seeds: int, hot: int, of: np.ndarray) -> DataFrame:
    """Rows of all words but the seeds, several for a word: (word, around), a class byte before and one after each
    occurrence, in a row; for the head's words from the seeds up to hot (word, cell, n), how often a
    class stands on a side (cell: class, CLASSES more after it).
    """
    by_ending = [of[unit_bin(w)] for w in head[seeds:]]
    full = np.concatenate([of[:seeds], np.array(by_ending, of.dtype), of[UNITS:]]).astype(np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast((head, full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of = shared.value
        names, units = pa.array(head, pa.binary()), Units((w, i) for i, w in enumerate(head))
        around: defaultdict[bytes, bytearray] = defaultdict(bytearray)  # words outside the head
        places: list[np.ndarray] = []  # the head's words with the bytes beside them
        beside: list[np.ndarray] = []
        cells: list[np.ndarray] = []
        words: list[bytes] = []
        codes: list[int] = []
        seen = 0

        def take() -> None:
            u = np.array(codes, np.int64)
            c = of[u]
            near = np.column_stack([np.concatenate([[END_CLASS], c[:-1]]), np.concatenate([c[1:], [END_CLASS]])]).astype(np.uint8)
            flat = near.tobytes()
            for k in np.flatnonzero(u < -1).tolist():  # -1 is the end
                around[words[k]] += flat[2 * k : 2 * k + 2]
            at = np.flatnonzero(u >= hot)
            places.append(u[at].astype(np.int32))
            beside.append(near[at])
            at = np.flatnonzero((u >= seeds) & (u < hot))
            cells.extend(u[at] * (2 * CLASSES) + side * CLASSES + near[at, side] for side in (0, 1))
            codes.clear()
            words.clear()

        def rows(words: pa.Array, cell=None, n=None, near=None) -> Iterator[pa.RecordBatch]:
            size, kinds = len(words), (pa.int32(), pa.int64(), pa.binary())
            columns = [words, *(pa.nulls(size, kind) if x is None else pa.array(x, kind) for x, kind in zip((cell, n, near), kinds))]
            whole = pa.RecordBatch.from_arrays(columns, ["word", "cell", "n", "around"])
            for a in range(0, size, 50_000):
                yield whole.slice(a, 50_000)

        def out() -> Iterator[pa.RecordBatch]:
            take()
            yield from rows(pa.array(list(around), pa.binary()), near=list(map(bytes, around.values())))
            around.clear()
            u = np.concatenate(places)
            by = np.argsort(u, kind="stable")
            near, u = np.concatenate(beside)[by], u[by]
            last = np.flatnonzero(np.append(u[1:] != u[:-1], True)) if len(u) else np.zeros(0, np.int64)
            yield from rows(names.take(pa.array(u[last])), near=binaries(near, 2 * (last + 1)))
            found, n = np.unique(np.concatenate(cells), return_counts=True)
            yield from rows(names.take(pa.array(found // (2 * CLASSES))), found % (2 * CLASSES), n)
            for x in (places, beside, cells):
                x.clear()

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                found = words_of(t)
                words += found
                words.append(b"")
                codes.extend(map(units.__getitem__, found))
                codes.append(-1)
                seen += len(found)
                if len(codes) >= STEP:
                    take()
                if len(around) >= FLUSH or seen >= 4 * CODES:
                    yield from out()
                    seen = 0
        yield from out()

    return texts.select("text").mapInArrow(run, "word binary, cell int, n long, around binary")


def assign(near: DataFrame, pairs: np.ndarray) -> DataFrame:
    """Rows (word, n, cls): for each word the class that makes it and its neighbours likeliest, the class bigrams fixed."""
    mass = pairs.sum(axis=0)
    with np.errstate(divide="ignore"):
        move = np.log(np.maximum(_smoothed(pairs, mass), 1e-300))
        weight = np.where(mass > 0, np.log(np.maximum(mass, 1.0)), np.inf)
    weight[END_CLASS] = np.inf

    def from_lists(batch: pa.RecordBatch) -> np.ndarray:
        lines = [b"".join(x) for x in batch.column(1).to_pylist()]
        n = np.fromiter(map(len, lines), np.int64, len(lines)) // 2
        codes = np.frombuffer(b"".join(lines), np.uint8).reshape(-1, 2)
        at = np.repeat(np.arange(len(lines)) * CLASSES, n)
        return np.stack([np.bincount(at + codes[:, k], minlength=len(lines) * CLASSES).reshape(-1, CLASSES) for k in (0, 1)], axis=1)

    def from_cells(batch: pa.RecordBatch) -> np.ndarray:
        sides = np.zeros((batch.num_rows, 2 * CLASSES), np.int64)
        for k, found in enumerate(batch.column(1).to_pylist()):
            for c in found:
                sides[k, c["cell"]] = c["n"]
        return sides.reshape(-1, 2, CLASSES)

    def moved(gathered: DataFrame, sides_of) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 4096):
                    batch = whole.slice(a, 4096)
                    sides = sides_of(batch)
                    n = sides[:, 0].sum(axis=1)
                    chance = sides[:, 0] @ move + sides[:, 1] @ move.T - n[:, None] * weight
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(chance.argmax(axis=1).astype(np.int32))], ["word", "n", "cls"])

        return gathered.mapInArrow(run, "word binary, n long, cls int")

    lists = near.where("around is not null").groupBy("word").agg(F.collect_list("around").alias("around"))
    cells = near.where("cell is not null").groupBy("word", "cell").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return moved(lists, from_lists).unionByName(moved(cells, from_cells))


def classify(texts: DataFrame, vocab: DataFrame) -> Classes:
    """A class for every training word; vocab: rows (word, n) of all of them."""
    words, counts, inside = head_of(vocab)
    seeds = words[:UNITS]
    hot = max(len(seeds), int((counts >= HOT).sum()))
    matrix = count_unit_pairs(texts, seeds)
    of, _ = exchange(matrix)
    ones = np.zeros((ALL, CLASSES))
    ones[np.arange(ALL), of] = 1.0
    near = stored(neighbours(texts, words, len(seeds), hot, of), "classlm-neighbours")
    table = stored(assign(near, ones.T @ matrix @ ones), "classlm-classes")
    discard(near)
    cls = np.zeros(len(words), np.int64)
    cls[: len(seeds)] = of[: len(seeds)]
    if len(words) > len(seeds):
        found = table.where(inside).select("word", "cls").toArrow()
        by_word = dict(zip(found.column("word").to_pylist(), found.column("cls").to_pylist()))
        cls[len(seeds) :] = [by_word[w] for w in words[len(seeds) :]]
    return Classes(len(seeds), of, words, counts, cls, inside, table)


def coded(docs: DataFrame, classes: Classes) -> DataFrame:
    """Rows (doc_id, codes, known, counted, based), one for each row of docs.

    codes: a byte for each word, its class, with UNKNOWN added for a word unseen in training (the
    class of its ending). known: words seen; counted and based: sums of log10(n - DISCOUNT)
    over these and of log10(n + 0.5) over all.
    """
    shared = docs.sparkSession.sparkContext.broadcast((classes.words, classes.counts, classes.cls.astype(np.uint8), classes.of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, cls, of = shared.value
        place = Places((w, i) for i, w in enumerate(names)).__getitem__
        counted, based = np.log10(counts - DISCOUNT), np.log10(counts + 0.5)
        seq, part = 0, TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64()]
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch, rows = whole.slice(a, 500), []
                outside: list[bytes] = []
                where: list[bytes] = []
                ends = [0]
                for t in batch.column(1).cast(pa.binary()).to_pylist():
                    words = words_of(t)
                    at = np.fromiter(map(place, words), np.int64, len(words))
                    known = at[at >= 0]
                    codes = np.zeros(len(words), np.uint8)
                    codes[at >= 0] = cls[known]
                    tail: defaultdict[bytes, list[int]] = defaultdict(list)
                    new = np.flatnonzero(at < 0)
                    codes[new] = of[np.fromiter((unit_bin(words[k]) for k in new.tolist()), np.int64, len(new))] + UNKNOWN
                    for k in new.tolist():
                        tail[words[k]].append(k)
                    outside += tail
                    where += [array("I", x).tobytes() for x in tail.values()]
                    ends.append(len(outside))
                    missing = (len(words) - len(known)) * math.log10(0.5)
                    rows.append((part << 33 | seq, codes.tobytes(), len(known), float(counted[known].sum()), float(based[known].sum()) + missing))
                    seq += 1
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                entries = pa.StructArray.from_arrays([pa.array(outside, pa.binary()), pa.array(where, pa.binary())], ["word", "at"])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "row", "codes", "known", "counted", "based", "tail"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                lines = batch.column(1).to_pylist()
                ends = np.cumsum([len(x) for x in lines])
                line, starts = np.frombuffer(b"".join(lines), np.uint8).copy(), np.concatenate([[0], ends[:-1]])
                known, counted, based = (batch.column(k).to_numpy().copy() for k in (2, 3, 4))
                at, n, cls = batch.column(5).flatten().flatten()
                at, n = at.to_pylist(), n.to_numpy()
                rows = np.repeat(np.arange(len(lines)), batch.column(5).value_lengths().fill_null(0).to_numpy())
                times = np.fromiter(map(len, at), np.int64, len(at)) // 4
                line[np.repeat(starts[rows], times) + np.frombuffer(b"".join(at), np.uint32)] = np.repeat(cls.to_numpy(), times)
                total = lambda x: np.bincount(rows, x, len(lines))
                known += total(times).astype(np.int64)
                counted += total(times * np.log10(n - DISCOUNT))
                based += total(times * (np.log10(n + 0.5) - math.log10(0.5)))
                yield pa.RecordBatch.from_arrays([batch.column(0), binaries(line, ends), *map(pa.array, (known, counted, based))], ["doc_id", "codes", "known", "counted", "based"])

    picked = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    first = stored(picked.mapInArrow(run, f"doc_id {kind}, row long, codes binary, known long, counted double, based double, tail array<struct<word:binary,at:binary>>"), "classlm-texts")
    outside = classes.table.where(~classes.inside)
    found = first.select("row", F.inline("tail")).join(outside, "word").groupBy("row").agg(F.collect_list(F.struct("at", "n", "cls")).alias("found"))
    whole = first.drop("tail").join(found, "row", "left").select("doc_id", "codes", "known", "counted", "based", "found")
    return stored(whole.mapInArrow(placed, f"doc_id {kind}, codes binary, known long, counted double, based double"), "classlm-codes")


def count_class_pairs(codes: DataFrame) -> np.ndarray:
    """Matrix [CLASSES, CLASSES] of class bigrams over all coded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, cells = bytes([END_CLASS]), np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            c = np.frombuffer(end + b"".join(x + end for x in batch.column(0).to_pylist()), np.uint8).astype(np.int64) % UNKNOWN
            cells += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    pairs = np.zeros(CLASSES * CLASSES)
    for r in codes.select("codes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        pairs[r.cell] = r.n
    return pairs.reshape(CLASSES, CLASSES)


def fit(classes: Classes, codes: DataFrame) -> Model:
    """The model of the classes; codes: the coded training texts."""
    pairs = count_class_pairs(codes)
    ends = int(pairs[:, END_CLASS].sum())
    mass, types = pairs.sum(axis=0), np.bincount(classes.cls[: classes.seeds], minlength=CLASSES)
    for r in classes.table.groupBy("cls").agg(F.count(F.lit(1)).alias("types")).collect():
        types[r.cls] += r.types
    total = max(mass.sum(), 1.0)
    move = _smoothed(pairs, mass)
    free = np.where(mass > 0, DISCOUNT * types / np.maximum(mass, 1), 0.0)
    tiny = 0.5 / (total + 0.5)  # only where nothing at all was discounted
    with np.errstate(divide="ignore"):
        unknown = np.log10(np.maximum(move @ free, tiny * 1e-3))
        log_move = np.log10(np.maximum(move, 1e-300))
    return Model(classes, log_move, unknown, mass, int(mass.sum()), int(types.sum()) + (ends > 0), ends)


def learn(texts: DataFrame, vocab: DataFrame) -> Model:
    """The model of the texts; vocab: rows (word, n) of all training words."""
    classes = classify(texts, vocab)
    return fit(classes, coded(texts.select(F.lit(None).cast("long").alias("doc_id"), "text"), classes))


def scored(codes: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each coded text."""
    shared = codes.sparkSession.sparkContext.broadcast((model.move, model.unknown, model.mass, model.tokens, model.types, model.ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, unknown, mass, tokens, types, ends = shared.value
        log_mass, spread = np.log10(np.maximum(mass, 1.0)), math.log10(tokens + 0.5 * (types + 1))
        for batch in batches:
            rows = []
            for line, known, counted, based in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                code = np.append(np.frombuffer(line, np.uint8), np.uint8(END_CLASS)).astype(np.int64)
                c, new = code % UNKNOWN, code >= UNKNOWN
                before = np.concatenate([[END_CLASS], c[:-1]])
                chance = np.where(new, unknown[before], move[before, c])
                score = chance.sum() + counted - log_mass[c[:-1][~new[:-1]]].sum()
                base = based + math.log10(ends + 0.5) - len(c) * spread
                rows.append((len(c), known + (ends > 0), tokens, base if tokens else 0.0, float(score) if tokens else 0.0))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    kind = codes.schema["doc_id"].dataType.simpleString()
    out = codes.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model, vocab: DataFrame | None = None) -> DataFrame:
    """``scored`` of docs; the model's own table has the counts of vocab."""
    return scored(coded(docs, model.classes), model)


def score_all(docs: DataFrame) -> DataFrame:
    """Learn from the training folds of docs and score all its rows; texts are coded once."""
    texts = docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD).select(F.col("text").cast("string").alias("text"))
    classes = classify(texts, stored(count_words(texts), "classlm-words"))
    codes = coded(docs, classes)
    return scored(codes, fit(classes, codes.where(crc_mod(F.col("doc_id"), FOLDS) != HELD)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_all(table(spark, sf_dir, "documents").select("doc_id", "text"))
