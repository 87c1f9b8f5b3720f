"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items (words of letters and digits, A-Z lower-cased) go into one
generalised suffix automaton over words. Training texts are streamed through it word by
word: the automaton keeps, for each position, the longest match that ends there. A match
of at least ``window`` words means that the last ``window`` words are a window of some
item; an item shorter than a window counts as a whole, and is found as a suffix of the
match along the suffix links. The words inside such occurrences are hit. A document
whose hit words are at least ``1 / share`` of its words is contaminated.

Items of at most BLOCK_WORDS words are one automaton, which is broadcast; the documents stream through it and
are never shuffled. More items are dealt into blocks of about that size. Then a document goes only to the
blocks of which it holds a window (or a whole short item):

* all windows are marked by their hashes in a bitmap of FILTER_BITS bits, which is broadcast (its size is fixed);
* the documents are streamed past it, and the hashes of their own windows that are marked are joined with the table of
  the items' windows, which names the blocks; texts without a mark stay where they are;
* each distinct text left over goes to its blocks (dealt by block and a salt). A task builds a block's automaton once, from
  the items that are sorted before the block's texts, and holds one at a time.

A longest match is reported only for texts that hold a window or a whole item (0 for others), whatever the number of blocks.

Defined cases: null and empty texts have no words and no hits; null or empty items take
no part; repeated item rows count once; an item without an id marks words but isn't
counted or listed; repeated document rows each get a row; null doc_ids are kept; other
columns are not read by the report and kept by the filters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.common import stored, table

WINDOW = 13
SHARE = 20
BLOCK_WORDS = 100_000
FILTER_BITS = 1 << 28
SALTS = 8

#: Fixed: bytes that separate words; every byte of a character beyond ASCII is part of a word.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_REPORT = {
    "doc_id": "", "n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "longest_match": "long", "spans": "array<struct<start:int,end:int>>",
}


class Found(NamedTuple):
    """What one text holds."""

    words: int
    spans: list[tuple[int, int]]  # hit, in order, merged
    items: set
    longest: int


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = [(i, w) for i, w in items if w]
        for _, words in kept:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: dict[int, set] = {}
        self.whole: dict[int, dict[int, set]] = {}
        for item, words in kept:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][w]
                if n >= window:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    self.windows.setdefault(state, set()).add(item)
            if len(words) < window:
                self.whole.setdefault(state, {}).setdefault(len(words), set()).add(item)
        self.marked = self._nearest_marked() if self.whole else []

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _nearest_marked(self) -> list[int]:
        """For each state, the nearest of itself and its suffix links that ends a whole item; 0 if none."""
        near = [0] * len(self.next)
        for s in sorted(range(1, len(near)), key=self.length.__getitem__):
            near[s] = s if s in self.whole else near[self.link[s]]
        return near

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans [start, end) in order, merged; the items found; the longest match."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[list[int]] = []
        found: set = set()
        state = matched = longest = 0
        marked = self.marked
        for i, w in enumerate(words, 1):
            to = nxt[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    matched = 0
                    continue
                matched = length[state] + 1
            else:
                matched += 1
            state = to
            if matched > longest:
                longest = matched
            if matched >= window:
                # the match may go on beyond the items' window states: cut it to its last window
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.windows[at]
                _add(spans, i - window, i)
            if marked:
                at = marked[state]
                while at:
                    for n, ids in self.whole[at].items():
                        if n <= matched:
                            found |= ids
                            _add(spans, i - n, i)
                    at = marked[link[at]]
        return [(a, b) for a, b in spans], found, longest


def _add(spans: list[list[int]], a: int, b: int) -> None:
    """Add a span that ends no earlier than those before; earlier ones that it covers join it."""
    while spans and a <= spans[-1][1]:
        last = spans.pop()
        a, b = min(a, last[0]), max(b, last[1])
    spans.append([a, b])


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of a bounded number of words, streamed to the driver."""
    picked = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    block, size = [], 0
    for row in picked.toLocalIterator():
        n = len(words_of(row.t.encode()))
        if n and block and size + n > limit:
            yield block
            block, size = [], 0
        if n:
            block.append((row.i, row.t.encode()))
            size += n
    if block:
        yield block


class Detector:
    """One block's automaton, built once in each Python worker."""

    built: dict[str, Automaton] = {}

    def __init__(self, spark: SparkSession, block: list[tuple[str | None, bytes]], window: int):
        self.window, self.block = window, spark.sparkContext.broadcast(block)
        self.key = hashlib.sha256(repr((window, sorted(block, key=repr))).encode()).hexdigest()

    def automaton(self) -> Automaton:
        if self.key not in Detector.built:
            Detector.built.clear()
            Detector.built[self.key] = Automaton(((i, words_of(t)) for i, t in self.block.value), self.window)
        return Detector.built[self.key]

    def reports(self, texts: Iterable[bytes | None]) -> Iterator[Found]:
        """One text's words are held at a time."""
        machine = self.automaton()
        for text in texts:
            words = words_of(text)
            yield Found(len(words), *machine.hits(words))


def window_hashes(words: list[bytes], window: int, sizes: Iterable[int]) -> Iterator[np.ndarray]:
    """Hashes of all runs of so many words, for each of the sizes (ascending, up to the window)."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    run, done = np.zeros(len(words), np.uint64), 0
    for size in sizes:
        while done < size and done < len(words):
            n = len(words) - done
            x = (run[:n] ^ hashes[done:]) * _MIX[0]
            run, done = (x ^ (x >> np.uint64(29))) * _MIX[1], done + 1
        yield run ^ (run >> np.uint64(32)) if done == size else run[:0]


def _marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of the bitmap, its bits): two marks in one word for each hash."""
    one = np.uint64(1)
    bits = (one << (hashes & np.uint64(63))) | (one << ((hashes >> np.uint64(6)) & np.uint64(63)))
    return ((hashes >> np.uint64(12)) % np.uint64(FILTER_BITS // 64)).astype(np.int64), bits


class Blocks:
    """Items in many blocks, as tables: rows (block, item, text) and (hash, block)."""

    def __init__(self, items: DataFrame, item_id: str, text: str, window: int):
        self.window = window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if words := words_of(t):
                        size = min(window, len(words))
                        (hashes,) = window_hashes(words, window, [size])
                        rows.append((i, t, len(words), size, np.unique(hashes).view(np.int64)))
                kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["item", "text", "words", "size", "hashes"])

        picked = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").cast("binary").alias("text")).where("text is not null").distinct()
        found = stored(picked.mapInArrow(run, "item string, text binary, words long, size int, hashes array<long>"), "decontaminate-items")
        total, sizes = found.agg(F.sum("words"), F.sort_array(F.collect_set("size"))).first()
        self.sizes = list(sizes)  # at most as many as a window has words
        count = max(2, math.ceil(total / BLOCK_WORDS))
        dealt = found.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)).cast("int"))
        self.items = dealt.select("block", "item", "text")
        self.index = stored(dealt.select(F.explode("hashes").alias("hash"), "block").distinct(), "decontaminate-windows")
        self.bitmap = found.sparkSession.sparkContext.broadcast(self._bitmap(self.index.select("hash").distinct()))

    @staticmethod
    def _bitmap(hashes: DataFrame) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, bits = _marks(batch.column(0).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], ["word", "bits"])

        out = np.zeros(FILTER_BITS // 64, np.uint64)
        found = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return out

    def passed(self, texts: DataFrame) -> DataFrame:
        """Rows (doc_id, mark, n_words, hashes, text) of rows (doc_id, mark, text): the marked hashes, and the text if there are any."""
        window, sizes, bitmap = self.window, self.sizes, self.bitmap

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch, counts, marked, kept = whole.slice(at, 256), [], [], []
                    for t in batch.column(2):
                        words = words_of(t.as_py())
                        hashes = np.unique(np.concatenate([*window_hashes(words, window, sizes), np.zeros(0, np.uint64)]))
                        at_, bits = _marks(hashes)
                        hashes = hashes[bitmap.value[at_] & bits == bits]
                        counts.append(len(words))
                        marked.append(hashes.view(np.int64))
                        kept.append(t.as_py() if len(hashes) else None)
                    columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(marked, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_words", "hashes", "text"])

        return stored(texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, mark long, n_words long, hashes array<long>, text binary"), "decontaminate-passed")

    def found(self, passed: DataFrame) -> DataFrame:
        """Rows (mark, spans, items, longest) of each distinct text in which an item's window occurs."""
        window = self.window
        texts = passed.where("text is not null")
        one = texts.groupBy("mark").agg(F.first("text").alias("text"))
        goes = texts.select("mark", F.explode("hashes").alias("hash")).distinct().join(self.index, "hash").select("mark", "block").distinct()
        salt = F.pmod("mark", F.lit(SALTS)).cast("int")
        dealt = one.join(goes, "mark").select("block", salt.alias("salt"), F.lit(1).alias("kind"), "mark", F.lit(None).cast("string").alias("item"), "text")
        items = self.items.select("block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("mark"), "item", "text")
        rows = items.unionByName(dealt).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, first, held, machine = None, None, [], None
            for batch in batches:
                out = []
                for block, salt, kind, mark, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if block != at:
                        at, first, held, machine = block, salt, [], None
                    if kind == 0:
                        if salt == first:  # the same block under the next salt needs no second automaton
                            held.append((item, words_of(text)))
                        continue
                    machine = machine or Automaton(held, window)
                    spans, found, longest = machine.hits(words_of(text))
                    if spans:
                        out.append((mark, _structs(spans), list(found), longest))
                kinds = [pa.int64(), _SPANS, pa.list_(pa.string()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["mark", "spans", "items", "longest"])

        parts = rows.mapInArrow(run, "mark long, spans array<struct<start:int,end:int>>, items array<string>, longest long")
        # a text has one row a block that it holds a window of
        whole = parts.groupBy("mark").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                joined = []
                for spans in batch.column(1).to_pylist():
                    line: list[list[int]] = []
                    for s in sorted(spans, key=lambda s: s["end"]):
                        _add(line, s["start"], s["end"])
                    joined.append(_structs(line))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, _SPANS), batch.column(2), batch.column(3)], ["mark", "spans", "items", "longest"])

        return stored(whole.mapInArrow(merge, whole.schema), "decontaminate-found")


def _structs(spans: Iterable) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


def _detector(items: DataFrame, item_id: str, text: str, window: int) -> Detector | Blocks:
    """The items' one automaton, or their blocks if they are more than one block can hold."""
    cut = blocks(items, item_id, text)
    first = next(cut, [])
    return Detector(items.sparkSession, first, window) if next(cut, None) is None else Blocks(items, item_id, text, window)


def _verdict(n: int, spans: list[tuple[int, int]], share: int) -> tuple[int, bool]:
    hit = sum(b - a for a, b in spans)
    return hit, hit > 0 and share * hit >= n


def report(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE
) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, spans), one for each row of docs."""
    detector = _detector(items, item_id, item_text, window)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch, reports: Iterable[Found]) -> pa.RecordBatch:
        out = []
        for n, spans, found, longest in reports:
            hit, bad = _verdict(n, spans, share)
            ids = sorted(i for i in found if i is not None)
            out.append((n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bad, longest if spans else 0, _structs(spans)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), _SPANS]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], list(_REPORT))

    schema = f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in list(_REPORT.items())[1:])
    if isinstance(detector, Detector):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, detector.reports(t.as_py() for t in batch.column(1)))

        return picked.select("doc_id", "text").mapInArrow(run, schema)
    passed = detector.passed(picked)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, found, longest = (batch.column(k).to_pylist() for k in range(1, 5))
            yield rows(batch, (Found(a, [(s["start"], s["end"]) for s in b or ()], set(c or ()), d or 0) for a, b, c, d in zip(n, spans, found, longest)))

    return passed.join(detector.found(passed), "mark", "left").select("doc_id", "n_words", "spans", "items", "longest").mapInArrow(join, schema)


def strip_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and what stands between the words of a span)."""
    folded, places, at = text.translate(_FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join([*out, text[done:]])


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, strip: bool = False
) -> DataFrame:
    """docs without the contaminated rows; with strip, the hit spans are cut out of them instead, and out of all others.

    Without strip, the texts of the rows that stay are unchanged. Other columns are kept as they are.
    """
    detector = _detector(items, item_id, item_text, window)
    place, schema = docs.columns.index(text), docs.schema

    def cut(batch: pa.RecordBatch, spans: Iterable[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts = [None if t is None else strip_spans(t, s).decode("utf-8", "replace") if s else t.decode("utf-8", "replace") for t, s in zip(batch.column(place).cast(pa.binary()).to_pylist(), spans)]
        columns = [pa.array(texts, pa.string()).cast(c.type) if k == place else c for k, c in enumerate(batch.columns[: len(schema)])]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    if isinstance(detector, Detector):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(detector.reports(t.as_py() for t in batch.column(place).cast(pa.binary())))
                yield cut(batch, [f.spans for f in found]) if strip else batch.filter(pa.array([not _verdict(f.words, f.spans, share)[1] for f in found], pa.bool_()))

        return docs.mapInArrow(run, schema)
    mark = F.xxhash64(F.col(text).cast("string"))
    passed = detector.passed(docs.select(F.lit(None).cast("int").alias("doc_id"), mark.alias("mark"), F.col(text).cast("string").cast("binary").alias("text")))
    found = detector.found(passed).join(passed.groupBy("mark").agg(F.first("n_words").alias("n_words")), "mark")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    if not strip:
        bad = found.where((hit > 0) & (share * hit >= F.col("n_words"))).select(F.col("mark").alias("_mark"))
        return docs.join(bad, mark == F.col("_mark"), "left_anti")

    def strip_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch, [[(s["start"], s["end"]) for s in spans or ()] for spans in batch.column(len(schema)).to_pylist()])

    spans = found.select(F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    return docs.join(spans, mark == F.col("_mark"), "left").select(*[docs[f"`{c}`"] for c in docs.columns], "_spans").mapInArrow(strip_found, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "longest_match")


_FOLDED = r"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[p : p + least(len(ws), {WINDOW}) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS p FROM iw WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), occ AS (
  SELECT k, n, p, array_to_string(ws[p : p + n - 1], ' ') AS w
  FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, sizes WHERE len(ws) >= n)
), hit AS (
  SELECT k, p, occ.n, item_id FROM occ JOIN win ON occ.w = win.w AND occ.n = win.n
), pos AS (
  SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, p, n FROM hit)) GROUP BY k
), its AS (
  SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS i FROM hit) GROUP BY k
)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * n_hit >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""
