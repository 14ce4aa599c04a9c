import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitmill.llm import suffix_dedup as d
from orbitmill.llm import suffix_sort

from .conftest import TEXTS, as_set

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def removed(texts, length=50):
    """For each text, the mask of bytes to remove."""
    least = {}
    data = [(i if i is not None else d.LAST, (t or "").encode()) for i, t in texts]
    for i, b in data:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                mask[k : k + length] = b"\1" * length
        out.append(mask)
    return out


def brute(texts, length=50):
    out = []
    for (i, t), mask in zip(texts, removed(texts, length), strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force(documents):
    assert as_set(d.dedup_report(documents), *COLUMNS) == brute(TEXTS)


def test_mosaics(spark, make_documents, monkeypatch):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 90))) for _ in range(8)]
    texts = [(rng.randint(0, 25), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for _ in range(40)]
    docs = make_documents(texts)
    assert as_set(d.dedup_report(docs), *COLUMNS) == brute(texts)
    monkeypatch.setattr(d, "MOST_SEGMENTS", 2)
    spans = d.removals(docs, most_segments=2)  # hashes with many segments go the other way
    total = sum(r[2] for r in brute(sorted(set(texts))))
    got = 0
    for r in spans.collect():
        a, b = d.merged(np.array([s["a"] for s in r["spans"]]), np.array([s["b"] for s in r["spans"]]))
        got += int((b - a).sum())
    assert got == total


def thue_morse_pair():
    """Two texts of 2,848 bytes for which sums of powers of any odd base modulo 2**64 are equal."""
    rng = random.Random(9)
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    letters = [rng.choice("acegikmoqsuwy") for _ in range(32)]
    before, after = ("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(400)) for _ in range(2))
    return [before + "".join(chr(ord(letters[i // 64]) + (b ^ flip)) for i, b in enumerate(bits)) + after for flip in (0, 1)]


def test_equal_sums_are_not_equal_texts(make_documents, monkeypatch):
    texts = list(enumerate(thue_morse_pair()))
    for bits in (3, 9):  # short stretches, and such as hold the whole pattern
        monkeypatch.setattr(d, "CUT_BITS", bits)
        assert as_set(d.dedup_report(make_documents(texts)), *COLUMNS) == brute(texts)
    data = [t.encode() for _, t in texts]
    assert len({d.digests(b, np.array([0]), np.array([len(b)])).tobytes() for b in data}) == 2


def test_long_runs_make_bounded_segments(make_documents):
    texts = [(1, "a" + "=" * 3000 + "b"), (2, "=" * 700 + "c"), (3, "q" * 49 + "=" * 60), (4, "-" * 49 + "q" + "=" * 20)]
    assert as_set(d.dedup_report(make_documents(texts)), *COLUMNS) == brute(texts)
    s = d.Segments(np.frombuffer(b"=" * 9000, np.uint8), np.array([0, 9000]), 50, d.GRAM)
    assert s.size.max() == d.WINDOWS + 49 and (s.size - 49).sum() == 9000 - 49


@pytest.mark.parametrize("bits", [12, 20])  # a bitmap that is all but full, and a roomy one
def test_copies_of_copies(make_documents, monkeypatch, bits):
    monkeypatch.setattr(d, "bits_for", lambda total: bits)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    page = [" ".join(word() for _ in range(120)) for _ in range(6)]
    texts = []
    for i in range(90):  # whole copies, copies with a word changed, and shared passages in own text
        kind, t = i % 3, rng.choice(page)
        if kind == 1:
            w = t.split()
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 2:
            a = rng.randrange(300)
            t = " ".join(word() for _ in range(30)) + t[a : a + rng.randint(20, 400)] + " ".join(word() for _ in range(30))
        texts.append((rng.randint(0, 80), t))
    assert as_set(d.dedup_report(make_documents(texts).repartition(5)), *COLUMNS) == brute(texts)


def test_any_column_names(spark, make_documents):
    texts = [(1, "x" * 120), (2, "x" * 60), (3, "own text")]
    docs = make_documents(texts)
    for name in ("__spans", "__text_key", "__doc", "__Key"):
        docs = docs.withColumn(name, F.lit("kept"))
    cut = d.remove_repeats(docs)
    assert cut.schema == docs.schema
    assert as_set(cut, "doc_id", "text", "__spans", "__Key") == [(1, "x" * 120, "kept", "kept"), (2, "", "kept", "kept"), (3, "own text", "kept", "kept")]


def test_text_is_cut_whole(spark, documents, make_documents):
    cut = d.remove_repeats(documents)
    assert cut.schema == documents.schema and cut.count() == len(TEXTS)
    expected = []
    for (i, t), mask in zip(TEXTS, removed(TEXTS), strict=True):
        expected.append((i, None if t is None else bytes(x for x, m in zip(t.encode(), mask, strict=True) if not m).decode("utf-8", "ignore")))
    assert as_set(cut, "doc_id", "text") == sorted(expected, key=repr)


def test_empty_table(no_documents):
    assert d.dedup_report(no_documents).count() == 0
    assert d.remove_repeats(no_documents).count() == 0


def test_long_rows_are_cut_between_windows():
    text = bytes(range(32, 120)) * 40
    values = pa.array([b"", text, b"short", text[:70]], pa.binary())
    for piece in (64, 500, 1 << 20):
        starts = {}
        for buf, off, rows, base in d.pieces(values, 50, piece):
            for k in range(len(rows)):
                n = int(off[k + 1] - off[k])
                for w in range(n - 49):
                    at = (int(rows[k]), int(base[k]) + w)
                    assert at not in starts
                    starts[at] = buf[off[k] + w : off[k] + w + 50].tobytes()
        assert len(starts) == len(text) - 49 + 21
        assert all(text[i : i + 50] == w for (r, i), w in starts.items())


@pytest.mark.parametrize("alphabet", [b"ab", b"a", b"abc\x00", bytes(range(200))])
def test_two_stage_sort(alphabet):
    rng = random.Random(1)
    for depth in (8, 9, 16, 50):
        for _ in range(15):
            base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(4)]
            pieces = []
            for _ in range(rng.randint(0, 20)):
                b = rng.choice(base)
                i = rng.randint(0, len(b))
                pieces.append(b[i : i + rng.randint(0, 100)])
            owner = np.array([rng.randint(0, 50) for _ in pieces], np.int64)
            off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
            least, _ = suffix_sort.least_by_window(np.frombuffer(b"".join(pieces), np.uint8), off, owner, depth)
            want = {}
            for p, o in zip(pieces, owner, strict=True):
                for i in range(len(p) - depth + 1):
                    want[p[i : i + depth]] = min(want.get(p[i : i + depth], 99), o)
            assert least.tolist() == [want[p[i : i + depth]] for p in pieces for i in range(len(p) - depth + 1)]


def test_order_is_that_of_suffixes():
    text = np.frombuffer(b"mississippi and mississippi", np.uint8) + 1
    text = np.append(text, 0).astype(np.uint8)
    words = suffix_sort.eight_bytes(text, 50)
    order = suffix_sort.suffix_order(text, np.ones(len(text), bool), words, 50)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


def test_parts_are_sorted_by_whole_hashes():
    rng = random.Random(8)
    rows = []
    for h in range(12):  # equal windows have equal hashes: an alphabet for each
        parts = ["".join(rng.choice("abc") for _ in range(30)) + chr(100 + h) for _ in range(3)]
        for n in range(rng.randint(1, 9)):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(2, 5))).encode()
            rows.append((rng.randint(0, 6), n, 100 * h, (1 << 63) - 1 - h if h % 2 else h - (1 << 63), text))
    rng.shuffle(rows)
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, ["doc", "text_key", "a", "hash", "segment"])

    def ranges(most):
        found = d._sorted_parts(50, most)(iter([batch.slice(0, 20), batch.slice(20)]))
        return sorted(tuple(r.values()) for b in found for r in b.to_pylist())

    least = {}
    for doc, _, _, _, text in rows:
        for k in range(len(text) - 49):
            least[text[k : k + 50]] = min(least.get(text[k : k + 50], doc), doc)
    covered = {(doc, key, a, k) for doc, key, a, _, text in rows for k in range(len(text) - 49) if least[text[k : k + 50]] < doc}
    told = {(doc, key, a // 100 * 100, k - a // 100 * 100) for doc, key, a, b in ranges(1) for k in range(a, b - 49)}
    assert covered and {(doc, key, k + a) for doc, key, a, k in covered} == {(doc, key, k + a) for doc, key, a, k in told}
    assert ranges(1) == ranges(500) == ranges(1 << 20)


def test_shuffle_files_go_with_their_query(spark, make_documents):
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {str(p) for f in folders for p in Path(f).rglob("shuffle_*.data")}
    before = files()
    d.removals(make_documents([(i, f"{i} " + "word passage text " * 20) for i in range(30)]))
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_hashes_fill_bitmaps_evenly():
    rng = np.random.default_rng(3)
    s = d.Segments(rng.integers(97, 123, 200_000).astype(np.uint8), np.array([0, 200_000]), d.LENGTH, d.GRAM)
    share = np.bincount((s.hash >> np.uint64(60)).astype(np.int64), minlength=16) / len(s.hash)
    assert share.max() < 0.08  # of the sixteenths of their range; least hashes as they are had over half in the first


def test_what_hits_full_bitmaps_is_not_shuffled(make_documents, monkeypatch):
    monkeypatch.setattr(d, "bits_for", lambda total: 12)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    pages = [" ".join(word() for _ in range(100)) for _ in range(2)]
    texts = []
    for i in range(300):
        words = [word() for _ in range(100)] if i % 2 else rng.choice(pages).split()
        words[rng.randrange(100)] = word()
        texts.append((i, " ".join(words)))
    sizes = []
    table = d.Scratch.table

    def seen(self, df, tag, *names):
        out = table(self, df, tag, *names)
        if tag == "hashes-to-sort":
            sizes.append(out.agg(F.sum("size")).collect()[0][0])
        return out

    monkeypatch.setattr(d.Scratch, "table", seen)
    assert as_set(d.dedup_report(make_documents(texts).repartition(5)), *COLUMNS) == brute(texts)
    whole = sum(len(t) for _, t in texts)
    assert len(sizes) == 1 and sizes[0] < whole / 4
