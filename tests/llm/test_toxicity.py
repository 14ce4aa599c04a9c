import random
import zlib

import numpy as np
import pytest

from orbitmill.llm import toxicity as t

from .conftest import TEXTS, as_set


def corpus(n, seed=1):
    rng = random.Random(seed)
    common = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad, stem = ["grobian", "lump", "wicht"], "schuf"
    out = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(3, 200))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice([*bad, stem + rng.choice(common)]))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def trained():
    rows = corpus(500)
    return t.train([x.encode() for _, x, _ in rows], [y for _, _, y in rows])


def score(model, texts):
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return t.scores(model, np.frombuffer(b"".join(texts), np.uint8), off)


def test_learns_words_and_stems(trained):
    rows = corpus(300, seed=9)
    got = score(trained, [x.encode() for _, x, _ in rows]) >= 0.5
    assert np.mean(got == np.array([y for _, _, y in rows], bool)) > 0.9


def test_every_window_counts(trained):
    calm = " ".join(corpus(1, seed=3)[0][1].split()[:40])
    long = " ".join([calm] * 60)
    assert score(trained, [long.encode()])[0] < 0.5
    for at in (0, 1000, len(long.split()) - 1):
        words = long.split()
        words[at : at + 1] = ["grobian", "lump", "wicht", "grobian"]
        assert score(trained, [" ".join(words).encode()])[0] >= 0.5


def test_scores_do_not_depend_on_the_batch(trained):
    texts = [x.encode() for _, x, _ in corpus(20, seed=4)] + [b"", b"one"]
    alone = np.array([score(trained, [x])[0] for x in texts])
    assert np.allclose(alone, score(trained, texts), atol=1e-5)


def test_gradient():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in t.start_weights(rng).items()}
    words, v = t._many([b"some words in a text", b"and others yet in a longer text than that", b"x"])
    text, start, size = t.window_starts(np.diff(words.first))
    start = words.first[text] + start
    odds = [rng.normal(0, 1, 1 << t.WORD_BITS).astype(np.float32), *[rng.normal(0, 1, 1 << t.GRAM_BITS).astype(np.float32) for _ in t.GRAMS]]
    label = np.array([1, 0, 1], np.float32)

    def loss(m):
        x = t.inputs(v, odds, m)
        z = t.logits({k: w.astype(np.float32) for k, w in m.items()}, t.word_gates(m, x), v.index, start, size).astype(float)
        return np.mean(np.log1p(np.exp(-z * (2 * label - 1))))

    g = t.gradient(model, v, t.inputs(v, odds, model), start, size, label)
    for name in ("xf", "xb", "hf", "hb", "bf", "bb", "v", "w", "c", "word", "gram"):
        flat = np.argsort(-np.abs(g[name]).ravel())[:2]
        for k in flat:
            ends = []
            for step in (1e-2, -1e-2):
                m = {n: w.copy() for n, w in model.items()}
                m[name].ravel()[k] += step
                ends.append(loss(m))
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[name].ravel()[k], rel=0.08, abs=2e-4), name


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        _, start, size = t.window_starts(np.array([n]))
        covered = {i for a, k in zip(start, size, strict=True) for i in range(a, a + k)}
        assert covered == set(range(n)) and (size <= t.WINDOW).all()


def labelled(spark, make_documents, rows):
    docs = make_documents([(i, x) for i, x, _ in rows])
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_query(spark, make_documents, documents):
    docs, labels = labelled(spark, make_documents, corpus(400))
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema))
    out = t.score_documents(docs, labels).collect()
    truth = {i: y for i, _, y in corpus(400)}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out if r["held_out"]]) > 0.85
    odd = t.score_documents(documents, labels).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    kept = t.drop_toxic(docs, labels)
    assert kept.schema == docs.schema
    assert as_set(kept, "doc_id") == sorted(((r["doc_id"],) for r in out if not r["predicted"]), key=repr)


def test_without_labels(spark, documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in t.score_documents(documents, none).collect()} == {(0.0, 0)}
    assert t.score_documents(no_documents, none).count() == 0


def test_sample_is_bounded_and_not_held_out(spark, make_documents):
    docs, labels = labelled(spark, make_documents, corpus(400))
    texts, found = t.training_sample(docs, labels, most=20)
    assert sum(found) == 20 and len(found) == 40
    held = {x.encode() for i, x, _ in corpus(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & set(texts)
