import random

import pytest

from marketweave.llm import licenses as L

PREPARED = L.prepare(L.TEMPLATES)


def brute(text):
    words, out = L.words_of(text), []
    for t in sorted(PREPARED, key=lambda t: t.name):
        spans = set()
        for a, b in L.windows(max(0, len(words) - t.size + 1), t.width):
            found = [i for i in range(a, b) if tuple(words[i : i + t.size]) in t.shingles]
            share = len({tuple(words[i : i + t.size]) for i in found}) / len(t.shingles)
            if share >= 0.8:
                spans.add((min(found), max(found) + t.size, share))
        runs = []
        for a, b, s in sorted(spans):
            if runs and a < runs[-1][1]:
                runs[-1][1:] = [max(runs[-1][1], b), max(runs[-1][2], s)]
            else:
                runs.append([a, b, s])
        out += [L.Match(t.name, s, a, b) for a, b, s in runs]
    return out


def texts(n=150):
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(300)]
    for _ in range(n):
        words = [rnd.choice(pool) for _ in range(rnd.randrange(200))]
        for _ in range(2):
            t = rnd.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t))] = "zzz"
            at = rnd.randrange(len(words) + 1)
            words[at:at] = t
        yield " ".join(words).encode()


@pytest.mark.parametrize("block", [64, L.BLOCK])
def test_against_exact_containment(block, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", max(block, 64))
    found = 0
    for t in texts():
        got = L.scan(t, PREPARED)
        assert got == brute(t)
        found += len(got)
    assert found > 100


def test_every_template_is_found_anywhere():
    for name, text in L.TEMPLATES.items():
        for lead in range(0, 70, 3):
            got = [m for m in L.scan(("pad " * lead + text.upper() + " tail" * 9).encode(), PREPARED) if m.license == name]
            assert got and got[0].containment == 1.0 and got[0].start == lead


def test_windows_cover_every_run():
    for width in (1, 2, 4, 8, 32):
        for n in range(0, 150):
            spans = L.windows(n, width)
            for a in range(0, n):
                b = min(n, a + width)
                assert any(s <= a and b <= e for s, e in spans)


def test_table(spark, make_docs):
    rows = [(1, "x\nReleased under the MIT License. y"), (1, "x\nReleased under the MIT License. y"), (None, "released under the mit license"), (2, None), (3, ""), (4, "plain"), (5, "pad " * 60_000 + "Licensed under CC BY-NC 4.0.")]
    out = L.license_scan(make_docs(rows))
    assert sorted((r.doc_id or 0, r.license_id, r.start_word) for r in out.collect()) == [(0, "mit-line", 0), (1, "mit-line", 1), (1, "mit-line", 1), (5, "cc-by-nc-4.0-line", 60_000)]
    assert L.license_scan(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        L.prepare({"none": "..."})
