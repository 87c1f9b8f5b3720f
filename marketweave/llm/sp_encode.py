"""SentencePiece encoding and decoding by suffix-array matching.

For each Arrow batch, the distinct chunks (words with the space before them) that are
not known yet are concatenated and indexed by a suffix array, sorted as deep as the
longest piece; chunks over LONG characters are first cut at all places that no piece crosses. All pieces of the vocabulary are binary-searched in it at once, one
character deeper each time; a piece's range holds its occurrences, which are edges from
a start to an end position. Edges are sorted by their end's offset from the last place that no
piece crosses and relaxed in that order, all edges of an offset at once (one by one where only few are left): an edge is taken if its piece may follow the last piece of the
output up to its start (see bpe.py), which holds for exactly one edge into each
position. Walking back from each chunk's end gives its pieces. Characters without a
piece become their bytes' pieces. The ids equal the library's.

Decoding joins the pieces' bytes and drops the dummy prefix's space. It returns the
text, but for U+2581, which the model writes as a space.

Cost: in proportion to the text, also for words without an end (a stretch without any uncrossed place is
indexed whole, so its length bounds the memory).

Defined cases: null texts encode as null ids with 0 tokens and decode to null; empty
texts as an empty list; repeated rows each get a row; null ids are kept; columns other
than id and text are not read. Memory is bounded by the batch, and by MAX_KNOWN chunks,
MAX_PAIRS pairs and HELD_WORDS words that a worker keeps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.bpe import Vocabulary, default_model, vocabulary
from marketweave.llm.common import table

MAX_KNOWN = 120_000
MAX_PAIRS = 300_000
INDEX_CHARS = 200_000
HELD_WORDS = 200_000
ROWS_OUT = 512
LONG = 64
FEW = 16
SCALARS = 20_000
SLOTS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_END = 0x110000


class Index(NamedTuple):
    """A suffix array, with the leading ``packed`` codes of each suffix as one sorted number."""

    codes: np.ndarray
    order: np.ndarray
    letters: np.ndarray
    width: int
    packed: int
    keys: np.ndarray

    def key(self, letters: np.ndarray) -> np.ndarray:
        """Numbers of rows of letter ranks (0: none), as far as they are packed."""
        out = np.zeros(len(letters), np.int64)
        for d in range(self.packed):
            out = (out << self.width) | (letters[:, d] if d < letters.shape[1] else 0)
        return out


def suffix_array(codes: np.ndarray, depth: int) -> Index:
    """Suffixes sorted by at least ``depth`` leading codes.

    The first round packs as many codes as a word holds; then prefix doubling.
    """
    letters = np.unique(codes)
    rank = (np.searchsorted(letters, codes) + 1).astype(np.int64)
    width = int(len(letters) + 1).bit_length()
    first = done = max(1, min(depth, 62 // width))
    packed = np.zeros_like(rank)
    for k in range(done):
        packed <<= width
        packed[: max(0, len(rank) - k)] |= rank[k:]
    leading, order = packed, np.argsort(packed)
    while True:
        ordered = packed[order]
        if done >= depth:
            return Index(codes, order, letters, width, first, leading[order])
        rank = np.empty_like(packed)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - done)] = rank[done:] + 1
        packed = rank * (len(codes) + 2) + after
        order = np.argsort(packed)
        done *= 2


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, int] = {}  # the number of each chunk that is kept
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)  # ids of all of them, and where each one's end
        names = sorted(vocab.ids)
        self.names, self.ids = names, np.array([vocab.ids[p] for p in names])
        self.lengths = np.array([len(p) for p in names])
        self.codes = np.zeros((len(names), vocab.longest), np.int64)
        for i, p in enumerate(names):
            self.codes[i, : len(p)] = [ord(c) for c in p]
        self.by_id = dict(zip(self.ids.tolist(), names))
        self.pair: dict[int, bool] = {}
        # the answers of ``pair`` again, each in the one slot its code has: read without a loop
        self.slot_code, self.slot_ok = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.beside = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in vocab.beside], np.int64))

    def ranges(self, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, the range of the suffix array whose suffixes begin with it.

        The packed leading codes settle most pieces at once; the longer ones are then searched
        a character deeper each time.
        """
        order, n = index.order, index.packed
        places = np.minimum(np.searchsorted(index.letters, self.codes), len(index.letters) - 1)
        ranks = np.where(index.letters[places] == self.codes, places + 1, 0)
        inside = np.arange(self.codes.shape[1]) < self.lengths[:, None]
        possible = ((ranks > 0) | ~inside).all(axis=1)
        least = index.key(np.where(inside, ranks, 0))
        beyond = least + (np.int64(1) << (index.width * np.maximum(n - self.lengths, 0)))
        low, high = np.searchsorted(index.keys, least), np.searchsorted(index.keys, beyond)
        high = np.where(possible, high, low)
        padded = np.concatenate([index.codes, np.full(self.vocab.longest + 1, _END)])
        for d in range(n, self.vocab.longest):
            live = np.flatnonzero((self.lengths > d) & (low < high))
            want = self.codes[live, d]
            edges = []
            for strict in (False, True):  # first suffix not below the character; first above it
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
                    right = open_ & ((seen <= want) if strict else (seen < want))
                    a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
                edges.append(a)
            low[live], high[live] = edges
        return low, high

    def _may_follow(self, code: int) -> bool:
        """Whether the piece may follow; the code is (last piece + 1) * (size + 1) + piece."""
        ok = self.pair.get(code)
        if ok is None:
            if len(self.pair) >= MAX_PAIRS:
                self.pair.clear()
            last, piece = divmod(code, self.vocab.size + 1)
            ok = self.pair[code] = self.vocab._fits(self.by_id.get(last - 1), self.by_id[piece])
        return ok

    def _fits(self, codes: np.ndarray) -> np.ndarray:
        """``_may_follow`` of each code."""
        at = (codes.view(np.uint64) * _SPREAD) >> np.uint64(64 - SLOTS)
        out, other = self.slot_ok[at], np.flatnonzero(self.slot_code[at] != codes)
        if len(other):
            distinct, back = np.unique(codes[other], return_inverse=True)
            found = np.fromiter(map(self._may_follow, distinct.tolist()), bool, len(distinct))
            out[other] = found[back]
            self.slot_code[at[other]], self.slot_ok[at[other]] = codes[other], found[back]
        return out

    def _starts(self, codes: np.ndarray, chunk_starts: np.ndarray) -> np.ndarray:
        """Whether a stretch starts at each place: a chunk, or what follows a place that no piece crosses."""
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        out = np.concatenate([[True], self.beside[at] != pairs])
        out[chunk_starts] = True
        return out

    def learn(self, chunks: list[str]) -> None:
        """Index the chunks' text and keep the ids of each."""
        text = "\0".join(chunks) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(c) for c in chunks], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        codes[starts + sizes] = _END
        index = suffix_array(codes, self.vocab.longest)
        low, high = self.ranges(index)
        count = np.maximum(high - low, 0)
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        start, piece, length = index.order[at].astype(np.int32), np.repeat(self.ids.astype(np.int32), count), np.repeat(self.lengths.astype(np.int32), count)
        del at, index
        covered = np.zeros(len(codes), bool)
        covered[start[length == 1]] = True
        bare = np.flatnonzero(~covered & (codes != _END)).astype(np.int32)
        unknown = self.vocab.size
        start = np.concatenate([start, bare])
        piece = np.concatenate([piece, np.full(len(bare), unknown, np.int32)])
        end = start + np.concatenate([length, np.ones(len(bare), np.int32)])
        fresh = self._starts(codes, starts)
        origin = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0)).astype(np.int32)
        offset = end - origin[start]
        by = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 1 << 16 else offset, kind="stable")
        start, piece, end, offset = start[by], piece[by], end[by], offset[by]
        # last[i]: piece that ends at i in the output up to i; -1: nothing that matters before i
        last, came = np.full(len(codes) + 1, -1, np.int32), np.zeros(len(codes) + 1, np.int32)
        cuts = np.flatnonzero(np.diff(offset, prepend=0)).tolist() + [len(offset)]
        base, done = self.vocab.size + 1, 0
        for a, b in zip(cuts, cuts[1:]):
            if b - a < FEW:
                break
            s, p, e = start[a:b], piece[a:b], end[a:b]
            ok = p == unknown
            part = ~ok
            before = np.where(fresh[s[part]], 0, last[s[part]].astype(np.int64) + 1)
            ok[part] = self._fits(before * base + p[part])
            last[e[ok]], came[e[ok]] = np.where(p[ok] == unknown, -1, p[ok]), s[ok]
            done = b
        if done < len(offset):
            rest = slice(done, None)
            edges = zip(start[rest].tolist(), piece[rest].tolist(), end[rest].tolist(), fresh[start[rest]].tolist())
            last_, came_ = (last, came) if len(offset) - done < SCALARS else (last.tolist(), came.tolist())
            for s, p, e, new in edges:
                if p == unknown or self._may_follow((0 if new else int(last_[s]) + 1) * base + p):
                    last_[e], came_[e] = -1 if p == unknown else p, s
            last, came = np.asarray(last_, np.int32), np.asarray(came_, np.int32)
        self._keep(chunks, starts, sizes, last, came)

    def _keep(self, chunks: list[str], starts: np.ndarray, sizes: np.ndarray, last: np.ndarray, came: np.ndarray) -> None:
        """Keep the ids of all chunks: short ones of pieces only by walking back in all of them at once, others one by one."""
        short, at, steps = sizes <= LONG, starts + sizes, []
        live = np.flatnonzero(short)
        while len(live):
            ids = last[at[live]]
            short[live[ids < 0]] = False
            live, ids = live[ids >= 0], ids[ids >= 0]
            steps.append((live, ids))
            at[live] = came[at[live]]
            live = live[at[live] > starts[live]]
        count, other = np.zeros(len(chunks), np.int64), {}
        for live, _ in steps:
            count[live] += 1
        if not short.all():
            last_, came_ = last.tolist(), came.tolist()
            for k in np.flatnonzero(~short).tolist():
                s, out = int(starts[k]), []
                at = s + len(chunks[k])
                while at > s:
                    if last_[at] >= 0:
                        out.append(last_[at])
                    else:
                        out.extend(reversed(self.vocab.bytes_of(chunks[k][at - 1 - s])))
                    at = came_[at]
                other[k], count[k] = out[::-1], len(out)
        ends = np.cumsum(count)
        flat = np.empty(int(count.sum()), np.int32)
        for k, (live, ids) in enumerate(steps):
            mine = short[live]
            flat[ends[live[mine]] - 1 - k] = ids[mine]
        for k, ids in other.items():
            flat[ends[k] - count[k] : ends[k]] = ids
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.ends = np.concatenate([self.ends, ends + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])

    def arrays(self, texts: Iterable[str | None]) -> Iterator[np.ndarray | None]:
        """Ids of each text; chunks that are new are indexed for several texts at once."""
        held: list[list[str] | None] = []
        new: dict[str, None] = {}
        chars = words = 0
        for text in texts:
            parts = None if text is None else self.vocab.chunks(text)
            if parts and len(text) > LONG and max(map(len, parts)) > LONG:
                parts = list(chain.from_iterable(self.vocab.apart(c) if len(c) > LONG else (c,) for c in parts))
            held.append(parts)
            words += len(parts or ())
            for c in set(parts or ()).difference(self.known):
                if c not in new:
                    new[c] = None
                    chars += len(c) + 1
            if chars >= INDEX_CHARS or words >= HELD_WORDS:
                yield from self._flush(held, new)
                held, new, chars, words = [], {}, 0, 0
        yield from self._flush(held, new)

    def _flush(self, held: list, new: dict) -> Iterator[np.ndarray | None]:
        if new:
            self.learn(list(new))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(p for p in held if p)), np.int64)
        a, n = self.ends[numbers], np.diff(self.ends)[numbers]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(a - ends + n, n) + np.arange(int(n.sum()))]
        ends, at, done = np.concatenate([[0], ends]), 0, 0
        for parts in held:
            if parts is None:
                yield None
                continue
            at += len(parts)
            yield ids[done : ends[at]]
            done = ends[at]
        if len(self.known) > MAX_KNOWN:
            self.known, self.flat, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[list[int] | None]:
        """Ids of each text as a list."""
        for ids in self.arrays(texts):
            yield None if ids is None else ids.tolist()

    def decode(self, ids: Iterable[int] | None) -> str | None:
        if ids is None:
            return None
        out = b"".join(map(self.vocab.output.__getitem__, ids))
        return out[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, token_ids, round_trip); no shuffle.

    round_trip: decoding the ids gives the text again (U+2581 counts as the space it is written as).
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for whole in batches:
            slices = [whole.slice(at, ROWS_OUT) for at in range(0, whole.num_rows, ROWS_OUT)]
            coded = coder.arrays(t for batch in slices for t in batch.column(1).to_pylist())
            for batch in slices:
                ids, same = [], []
                for t in batch.column(1).to_pylist():
                    found = next(coded)
                    same.append(None if t is None else coder.decode(found.tolist()) == t.replace("▁", " "))
                    ids.append(found)
                counts = pa.array([0 if i is None else len(i) for i in ids], pa.int64())
                columns = [batch.column(0), counts, pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "token_ids", "round_trip"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(coded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """Rows (doc_id, text) from ids."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
