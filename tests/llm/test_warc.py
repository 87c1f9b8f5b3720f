import hashlib
import io

import pytest
import zstandard

from marketweave.llm import warc as W
from marketweave.llm.common import shared_path

PAGES = [
    (5, "http://a/ü b\r\nX: 1", "<p>" + "same " * 40),
    (2, "http://b", "<p>" + "same " * 40),
    (9, None, "<p>" + "same " * 40),
    (9, None, "<p>" + "same " * 40),
    (None, "http://n", "<p>" + "same " * 40),
    (7, "http://c", "short"),
    (8, "http://c", "short"),
    (10, "http://e", None),
    (11, "http://e", ""),
    (12, "http://f", "\r\n\r\n" * 30 + "é" * 60),
    (13, "http://g", "x" * 99),
    (14, "http://g", "x" * 99),
    (15, "http://g", "x" * 100),
    (16, "http://g", "x" * 100),
    (17, "http://long", "longer 🙂 " * 200_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(3)


def want():
    out = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        same = [j for j, _, g in PAGES if j is not None and (g or "").encode() == body]
        first = min(same) if len(body) >= 100 and same else None
        refers = first if first is not None and first != i else None
        out.append((i if i is not None else -1, len(body), digest, "response" if refers is None else "revisit", refers if refers is not None else -1))
    return sorted(out)


def test_round_trip(spark):
    folder = shared_path(spark, "warc-test")
    manifest = W.write_archives(pages(spark), folder)
    rows = W.read_archives(manifest, with_payload=True).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3], r[4] if r[4] is not None else -1) for r in rows) == want()
    bodies = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(bytes(r.payload) == bodies[r.page_id] for r in rows if r.record_type == "response")
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_empty_table(spark):
    manifest = W.write_archives(pages(spark).limit(0), shared_path(spark, "warc-none"))
    assert manifest.count() == 0 and W.read_archives(manifest).count() == 0


def records(n=400):
    for k in range(n):
        body = b"<html>" + b"words of page %d " % (k % 37) * 20
        yield W.page_record(k, f"http://h/{k}", body, hashlib.sha256(body).hexdigest(), None)


def test_dictionary_leads_and_each_record_is_a_frame():
    data = W.write_one(records(3000))
    assert data[:4] == W.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    assert zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], 1 << 20)[:4] == (0xEC30A437).to_bytes(4, "little")
    found = list(W.read_archive(io.BytesIO(data)))
    assert len(found) == 3000 and found[7].headers["warc-record-id"] == "<urn:x-page:7>"
    plain = sum(len(zstandard.ZstdCompressor(level=W.LEVEL).compress(r)) for r in records(3000))
    assert len(data) < plain


def test_uncompressed_dictionary_and_none():
    samples = [bytes(r) for r in records(3000)]
    dictionary = W.train(samples)
    raw = dictionary.as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    data = W.SKIPPABLE + len(raw).to_bytes(4, "little") + raw + b"".join(map(packer.compress, samples[:3]))
    assert len(list(W.read_archive(io.BytesIO(data)))) == 3
    assert len(list(W.read_archive(io.BytesIO(W.write_one(list(records(3))))))) == 3
    assert list(W.read_archive(io.BytesIO(b""))) == []


def test_small_reads(monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 7)
    assert len(list(W.read_archive(io.BytesIO(W.write_one(records(60)))))) == 60


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"HARC/1.1"),
        lambda r: r.replace(b"Content-Length: 4", b"Content-Length: 5", 1),
        lambda r: r[:-2],
        lambda r: r + b"x",
        lambda r: r.replace(b"WARC-Date", b"X-Date"),
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type response"),
        lambda r: r.replace(b"words", b"werds"),
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
        lambda r: b"",
    ],
)
def test_invalid_records_raise(change):
    (record,) = records(1)
    W.parse_record(record)
    with pytest.raises(W.InvalidArchive):
        W.parse_record(change(record))


def test_broken_archives_raise():
    data = W.write_one(records(40))
    for bad in (data[:-3], data[: len(data) // 2], data[:6], data[:-10] + b"\0" * 10):
        with pytest.raises(W.InvalidArchive):
            list(W.read_archive(io.BytesIO(bad)))
