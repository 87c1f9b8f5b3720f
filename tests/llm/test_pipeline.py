"""Each stage of the corpus pipeline against a plain version of its decision."""

import random

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from marketweave.llm import bpe, decontaminate, quality, simhash


def corpus():
    rnd = random.Random(11)
    pool = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    bench = [(k, " ".join(rnd.choice(pool) for _ in range(30))) for k in range(5)]
    for i in range(200):
        bad = rnd.random() < 0.25
        words = [rnd.choice(pool) for _ in range(rnd.randrange(20, 160))]
        lines = [" ".join(w + "%%%" if bad else w for w in words[a : a + 15]) + ("" if bad else ".") for a in range(0, len(words), 15)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    good = [i for i, q, _ in labels if q]
    for k, i in enumerate(good[:20]):
        rows.append((1000 + k, rows[i][1]))
    rows += [(2000 + k, rows[good[30 + k]][1] + "\n" + bench[k][1]) for k in range(5)]
    rows += [(good[60], rows[good[60]][1]), (None, rows[good[61]][1]), (3000, None), (3001, "")]
    return rows, labels, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, bench = corpus()
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "encoding"] and pipeline.ORACLE_SQL is None


def test_run_against_plain_stages(spark, folder):
    rows, labels, bench = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, by_stage = docs.columns, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        by_stage.append(docs)
        assert k == 3 or docs.columns == columns
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(i, t) for i, t in rows if quality.score(model, [quality.document_features((t or "").encode())])[0] >= 0.7]
    assert ids(by_stage[0]) == sorted((i for i, _ in kept), key=str)
    bad = {i for i, q, _ in labels if not q}
    assert not bad & {i for i, _ in kept}
    shingles = {(i, t): simhash.shingle_set((t or "").encode()).tolist() for i, t in kept}
    root = {tuple(f): tuple(f) for f in shingles.values()}
    find = lambda f: f if root[f] == f else find(root[f])
    for a in root:
        for b in root:
            if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
                root[find(a)] = find(b)
    least = {}
    for (i, t), f in shingles.items():
        if i is not None:
            least[find(tuple(f))] = min(least.get(find(tuple(f)), i), i)
    stay = {i for (i, _), f in shingles.items() if i is not None and least[find(tuple(f))] == i}
    stay |= {i for (i, _), f in shingles.items() if i is None and find(tuple(f)) not in least}
    assert ids(by_stage[1]) == sorted(stay, key=str)
    machine = decontaminate.Automaton((str(k), decontaminate.words_of(t.encode())) for k, t in bench)
    text = dict(kept)
    clean = []
    for i in stay:
        words = decontaminate.words_of((text[i] or "").encode())
        hit = sum(b - a for a, b in machine.hits(words)[0])
        if not (hit and 20 * hit >= len(words)):
            clean.append(i)
    assert ids(by_stage[2]) == sorted(clean, key=str) and not {2000 + k for k in range(5)} & set(clean)
    library = sentencepiece.SentencePieceProcessor(model_file=bpe.default_model())
    out = pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted(clean, key=str)
    for r in out:
        want = library.encode(text[r.doc_id] or "")
        assert r.n_tokens == len(want) and list(r.token_ids or []) == want and r.round_trip in (True, None)
