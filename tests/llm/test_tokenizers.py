import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from marketweave.llm import bpe, sp_encode, tokencount

PATH = bpe.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", "▁", " ", "  ", "   ", "é", "🙂", "日", "\n", "\t", "-", "=", "#", "the", "ing", "tion", "\x00", "①", '"', ".", "x", "A", "0", "1", "ß", "<s>", "</s>", "<unk>", "<0x0A>", "{", "\\", "ﬁ", "́", "‍"]
FIXED = ["", " ", "a" * 9000, " " * 999, "-" * 1001, "=-" * 300, "the" * 4000, " a" * 5 + " ", "<s> </s> <unk>", "▁x▁▁y", "﻿x\r\n", "日本語" * 2000]


@given(st.lists(st.sampled_from(PARTS), max_size=50))
@settings(max_examples=300, deadline=None)
def test_counts_and_ids_equal_the_library(parts):
    text = "".join(parts)
    want = LIBRARY.encode(text)
    assert tokencount.count_tokens(text, PATH) == len(want)
    coder = sp_encode.encoder(PATH)
    (ids,) = coder.encode_batch([text])
    assert ids == want and coder.decode(ids) == text.replace("▁", " ")


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_unicode(text):
    want = LIBRARY.encode(text)
    assert tokencount.count_tokens(text, PATH) == len(want)
    assert list(sp_encode.encoder(PATH).encode_batch([text])) == [want]


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(text):
    want = LIBRARY.encode(text)
    assert tokencount.count_tokens(text, PATH) == len(want)
    assert list(sp_encode.encoder(PATH).encode_batch([text, None, text])) == [want, None, want]


def test_chunk_maps_compose_to_the_whole():
    machine, _ = tokencount.compiled(PATH)
    rnd = random.Random(7)
    for _ in range(60):
        text = "▁" + "".join(rnd.choice(PARTS) for _ in range(80)).replace(" ", "▁")
        cuts = sorted(rnd.randrange(len(text) + 1) for _ in range(6))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        maps = [machine.state_map(c) for c in chunks]
        total = machine.run(machine.start, text)[1]
        assert machine.apply(machine.scan(maps)) == total
        left = machine.compose(machine.compose(maps[0], maps[1]), maps[2])
        right = machine.compose(maps[0], machine.compose(maps[1], maps[2]))
        assert machine.apply(left) == machine.apply(right)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_STATES", 50)
    monkeypatch.setattr(tokencount, "MAX_WORDS", 5)
    monkeypatch.setattr(sp_encode, "MAX_KNOWN", 3)
    monkeypatch.setattr(sp_encode, "INDEX_CHARS", 20)
    machine = tokencount.Transducer(bpe.vocabulary(PATH))
    coder = sp_encode.Encoder(bpe.vocabulary(PATH))
    texts = ["some words and words again", "entirely different tokens", "some words and words again"]
    for t in texts:
        assert sum(machine.count_chunk(c) for c in machine.vocab.chunks(t)) == len(LIBRARY.encode(t))
    assert list(coder.encode_batch(texts)) == LIBRARY.encode(texts)


def test_suffix_array_sorts_suffixes():
    import numpy as np

    for text in ("banana", "aaaa", "abracadabra" * 3, "z"):
        codes = np.array([ord(c) for c in text])
        order = sp_encode.suffix_array(codes, len(text)).order
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))


def test_tables(spark, make_docs):
    rows = [(1, "the cat"), (1, "the cat"), (None, "x"), (2, None), (3, ""), (4, "a " * 5000)]
    docs = make_docs(rows)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs).collect())
    want = sorted((i or 0, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for i, t in rows)
    assert got == want
    coded = sp_encode.encode(docs)
    found = sorted(((r.doc_id or 0, r.n_tokens, r.token_ids and list(r.token_ids), r.round_trip) for r in coded.collect()), key=str)
    assert found == sorted(((i or 0, len(LIBRARY.encode(t or "")), None if t is None else LIBRARY.encode(t), None if t is None else True) for i, t in rows), key=str)
    back = sorted(((r.doc_id or 0, r.text) for r in sp_encode.decode(coded).collect()), key=str)
    assert back == sorted(((i or 0, t) for i, t in rows), key=str)
    assert tokencount.token_counts(docs.limit(0)).count() == sp_encode.encode(docs.limit(0)).count() == 0
