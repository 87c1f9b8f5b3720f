"""Token counts by a compiled finite-state transducer.

The tokenizer is compiled, state by state as texts need them, into a deterministic
transducer over characters. A state holds, for each start from which a piece may still
grow, the trie node reached, the last piece before that start, and the count there
relative to the count here. A transition carries the change of the number of emitted
tokens for the text so far (at times negative, as a longer piece replaces several);
the sum of the changes is the number of tokens.

Where two characters stand side by side in no piece, nothing crosses, and the state is
the start state's successor whatever came before. So the state map of a chunk of text
is: the characters up to the first such place, still to be run from whatever state
comes in, then a constant. These maps compose associatively; a text's count is the
last element of a prefix scan over its chunks' maps. For the usual chunk, a word with
the space before it, the map is a constant that is kept by word.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get
a row; null ids are kept; columns other than id and text are not read; texts are never
cut (a very long word is run in blocks that compose).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.bpe import SPACE, Vocabulary, default_model, vocabulary
from marketweave.llm.common import table

LIMIT = 4096
BLOCK = 4096
MAX_STATES = 200_000
MAX_WORDS = 300_000

State = tuple


class StateMap(NamedTuple):
    """What a chunk does to a state: run ``head`` from it; then, if ``state`` is given, go there with ``count`` more."""

    head: str
    count: int = 0
    state: State | None = None


class Transducer:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in vocab.ids:
            node = 0
            for c in p:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                node = nxt
            self.piece[node] = p
        self.start: State = ((0, None, 0),)
        self.steps: dict[tuple[State, str], tuple[State, int]] = {}
        self.states: dict[State, State] = {self.start: self.start}

    def step(self, state: State, char: str) -> tuple[State, int]:
        """(next state, emitted tokens)"""
        found = self.steps.get((state, char))
        if found is None:
            if len(self.states) > MAX_STATES:
                self.steps.clear()
                self.states = {self.start: self.start}
            nxt, emitted = self._compile(state, char)
            nxt = self.states.setdefault(nxt, nxt)
            found = self.steps[state, char] = nxt, emitted
        return found

    def _compile(self, state: State, char: str) -> tuple[State, int]:
        last = state[-1][1]
        if last is not None and last[-1] + char not in self.vocab.beside:
            return self.step(self.start, char)
        if char not in self.children[0]:
            return self.start, len(char.encode())
        live, token, count = [], None, 0
        for node, before, rel in state:
            nxt = self.children[node].get(char)
            if nxt is None:
                continue
            piece = self.piece[nxt]
            if token is None and piece is not None and self.vocab.fits(before, piece):
                token, count = piece, rel + 1
            if self.children[nxt]:
                live.append((nxt, before, rel))
        if token is None:
            raise AssertionError("every prefix ends in a piece")
        return (*((n, b, r - count) for n, b, r in live), (0, token, 0)), count

    def run(self, state: State, text: str) -> tuple[State, int]:
        total, steps = 0, self.steps
        for c in text:
            found = steps.get((state, c)) or self.step(state, c)
            state = found[0]
            total += found[1]
        return state, total

    def state_map(self, chunk: str) -> StateMap:
        """The map of one chunk, from any state."""
        beside = self.vocab.beside
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in beside:
                state, count = self.run(self.start, chunk[i:])
                return StateMap(chunk[:i], count, state)
        return StateMap(chunk)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b; associative, with StateMap("") as its unit."""
        if a.state is None:
            return StateMap(a.head + b.head, b.count, b.state)
        state, count = self.run(a.state, b.head)
        if b.state is None:
            return StateMap(a.head, a.count + count, state)
        return StateMap(a.head, a.count + count + b.count, b.state)

    def scan(self, maps: Iterable[StateMap]) -> StateMap:
        """The last element of the prefix scan, folded as a balanced tree."""
        level = list(maps) or [StateMap("")]
        while len(level) > 1:
            level = [reduce(self.compose, level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    def apply(self, m: StateMap) -> int:
        _, count = self.run(self.start, m.head)
        return count if m.state is None else count + m.count

    def count_chunk(self, chunk: str) -> int:
        if len(chunk) <= BLOCK:
            return self.run(self.start, chunk)[1]
        return self.apply(self.scan(self.state_map(chunk[i : i + BLOCK]) for i in range(0, len(chunk), BLOCK)))


class WordCounts(dict):
    """Counts of words that have one space before them, kept within a bound."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count_chunk(SPACE + word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def compiled(path: str) -> tuple[Transducer, WordCounts]:
    machine = Transducer(vocabulary(path))
    return machine, WordCounts(machine)


def count_tokens(text: str | None, path: str) -> int:
    if not text:
        return 0
    machine, words = compiled(path)
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return sum(map(words.__getitem__, parts))
    return sum(words[c[1:]] if c[1:2] != SPACE else machine.count_chunk(c) for c in machine.vocab.chunks(text))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit); no shuffle."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                sizes.append(len(t or b""))
                counts.append(count_tokens((t or b"").decode("utf-8", "replace"), path))
            over = [n > limit for n in counts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
