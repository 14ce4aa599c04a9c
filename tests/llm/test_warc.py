import hashlib
import io
import struct

import pytest
import zstandard

from orbitmill.llm import warc as w

from .conftest import as_set

BIG, SMALL = "<p>same</p>" * 200, "<p>s</p>"
PAGES = [
    (1, "http://a/1", BIG), (7, "http://a/7", BIG), (3, "http://a/3\r\nX: y é", BIG), (2, None, SMALL), (4, "http://a/4", SMALL), (5, "http://a/5", None), (6, "http://a/6", ""),
    (8, "u", "ü" * 499 + "x"), (9, "u", "ü" * 499 + "x"), (10, "u", "ü" * 500), (11, "u", "ü" * 500), (12, "v", "z" * 300_000), (None, "n", BIG), (None, "m", "q" * 2000), (None, "m", "q" * 2000),
    (13, "r", "r" * 1500), (13, "r", "r" * 1500), (14, "c", "\r\n\r\nWARC/1.1\r\n\r\n" * 80),
]


def brute(pages):
    most = {}
    for i, _, h in pages:
        h = h or ""
        if i is not None and len(h.encode()) >= 1000:
            most[h] = max(most.get(h, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = most.get(h or "")
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), *(("response", None) if to is None or to == i else ("revisit", to))))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(make_pages):
    assert as_set(w.archive_round_trip(make_pages(PAGES).repartition(3)), *COLUMNS) == brute(PAGES)


def test_many_archives(make_pages, monkeypatch, tmp_path):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 3000)
    names = w.write_archives(make_pages(PAGES).coalesce(1), f"file://{tmp_path}/a")
    assert names.count() > 3
    assert as_set(w.read_archives(names, f"file://{tmp_path}/a"), *COLUMNS) == brute(PAGES)


def test_files_hold_a_dictionary_and_single_records(make_pages, tmp_path):
    names = w.write_archives(make_pages(PAGES).coalesce(1), str(tmp_path / "b")).collect()
    assert sum(r["n_records"] for r in names) == len(PAGES)
    data = open(names[0]["path"], "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    first = unpack.decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: re") and first.endswith(b"\r\n\r\n") and first.count(b"WARC-Record-ID") == 1
    assert sum(1 for _ in w.frames(io.BytesIO(data), chunk=7)) == names[0]["n_records"]


def test_damage_is_noticed():
    made = w.record(5, "u", b"payload", None)
    assert w.parse(made)["payload"] == b"payload"
    with pytest.raises(ValueError):
        w.parse(made.replace(b"payload", b"PAYLOAD"))
    pack = zstandard.ZstdCompressor().compress(made)
    whole = w.leading_frame(w.train([made]).as_bytes()) + pack
    assert len(list(w.frames(io.BytesIO(whole)))) == 1
    with pytest.raises(ValueError):
        list(w.frames(io.BytesIO(whole[:-5])))
    with pytest.raises(ValueError):
        list(w.frames(io.BytesIO(pack)))


def test_trained_dictionary_helps():
    records = [w.record(i, f"http://a/{i}", (f"<html><body class='x'><p>text {i * 7919}</p></body></html>" * 3).encode(), None) for i in range(300)]
    plain = zstandard.ZstdCompressor(level=3)
    known = zstandard.ZstdCompressor(level=3, dict_data=w.train(records[:200]))
    assert sum(len(known.compress(r)) for r in records[200:]) < 0.6 * sum(len(plain.compress(r)) for r in records[200:])


def test_names_of_object_stores():
    kind = lambda folder: (type(w.store_of(folder)[0]).__name__, w.store_of(folder)[1])
    assert kind("s3a://bucket/a/b?region=x") == ("S3FileSystem", "bucket/a/b")
    assert kind("file:///tmp/a") == kind("/tmp/a") == ("LocalFileSystem", "/tmp/a")


def test_empty_table(make_pages):
    assert w.archive_round_trip(make_pages([])).count() == 0
