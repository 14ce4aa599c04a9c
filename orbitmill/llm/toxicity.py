"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network by word inputs (the odds of its hash among toxic and
clean training texts, and a learned embedding) and character inputs (the
highest and mean odds of its character grams, and a learned embedding of
those). Two gated recurrent layers read a window of ``WINDOW`` words from
either end, attention pools their states, and a logistic unit scores the
window. Windows overlap, a new one every ``STRIDE`` words, and cover whole
texts; a document's score is that of its highest window, calibrated on the
training texts.

Training takes a bounded sample of labelled rows: the first ``SAMPLE`` of each
class by a hash of doc_id, of at most ``SAMPLE_BYTES`` bytes each, and none
whose crc32(doc_id as text) modulo ``FOLDS`` is 0. Odds that train the network
come from the other half of the sample than the text they are used on. Only
texts are inputs of a score. The sample is in one order and the seed is fixed,
so reruns agree.

Defined results: null text is an empty text; a text without words gets the
score of an empty window; a null doc_id counts as an empty text in the hash of
held_out; labels that are null or without doc_id are not used, and of several
labels of one document the greatest holds; of texts that share a doc_id the
least trains; without labels of both classes every
score is 0; repeated rows are scored alike; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, U64, Words, free_name, packed, slices, utf8

WINDOW, STRIDE = 48, 32
FOLDS = 5
SAMPLE = 1500
SAMPLE_BYTES = 1 << 16
SEED = 7
HIDDEN = 8
WORD_BITS, GRAM_BITS, EMBED_BITS = 18, 16, 12
GRAMS = (3, 5)
EMBED = 4
STEADY = 1.0
EPOCHS, BATCH, RATE = 6, 128, 0.01
PIECE = 1 << 20
#: Windows run at once.
ROWS = 2048


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(FOLDS) == 0


class Vocabulary:
    """The distinct words of some texts: hash, buckets of word and character grams."""

    def __init__(self, words: Words):
        hashes = words.hashes()
        self.hashes, at, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        start, size = words.start[at], words.end[at] - words.start[at]
        self.word = (self.hashes >> U64(64 - WORD_BITS)).astype(np.int64)
        self.embed = (self.hashes & U64((1 << EMBED_BITS) - 1)).astype(np.int64)
        # every distinct word between blanks, with more of them where a gram needs room
        room = size + 2
        edge = np.zeros(len(room) + 1, np.int64)
        np.cumsum(np.maximum(room, max(GRAMS)), out=edge[1:])
        text = np.full(edge[-1], 32, np.uint8)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(edge[:-1] + 1, size) + inside] = words.text[np.repeat(start, size) + inside]
        self.grams = []
        for n in GRAMS:
            code = np.zeros(max(0, len(text) - n + 1), U64)
            for i in range(n):
                code = code * U64(0x100000001B3) + text[i : len(text) - n + 1 + i]
            code = (code * U64(0x9E3779B97F4A7C15)) >> U64(64 - GRAM_BITS)
            count = np.maximum(room - n + 1, 1)  # a word shorter than the gram has the one that begins at its blank
            first = edge[:-1]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            where = np.minimum(np.repeat(first, count) + step, max(len(code) - 1, 0))
            bucket = code[where].astype(np.int64) if len(code) else np.zeros(len(where), np.int64)
            self.grams.append((bucket, np.cumsum(count) - count, count))


class Odds:
    """Log odds of word and gram buckets between two classes of texts."""

    def __init__(self):
        self.word = np.zeros((2, 1 << WORD_BITS), np.float32)
        self.gram = [np.zeros((2, 1 << GRAM_BITS), np.float32) for _ in GRAMS]
        self.texts = np.zeros(2)

    def add(self, vocabulary: Vocabulary, label: int) -> None:
        self.texts[label] += 1
        self.word[label, np.unique(vocabulary.word)] += 1
        for table, (bucket, _, _) in zip(self.gram, vocabulary.grams, strict=True):
            table[label, np.unique(bucket)] += 1

    def tables(self) -> list[np.ndarray]:
        n0, n1 = self.texts
        logs = lambda t: np.clip(np.log((t[1] + STEADY) / (n1 + 2 * STEADY)) - np.log((t[0] + STEADY) / (n0 + 2 * STEADY)) - np.log((n0 + 2 * STEADY) / (n1 + 2 * STEADY)), -4, 4).astype(np.float32)
        return [logs(self.word), *map(logs, self.gram)]


N_ODDS = 1 + 2 * len(GRAMS)
N_IN = N_ODDS + 2 * EMBED


def inputs(vocabulary: Vocabulary, odds: list[np.ndarray], embeddings: dict[str, np.ndarray]) -> np.ndarray:
    """A row of N_IN numbers for every distinct word."""
    out = np.zeros((len(vocabulary.hashes), N_IN), np.float32)
    if not len(out):
        return out
    out[:, 0] = odds[0][vocabulary.word]
    for k, (table, (bucket, first, count)) in enumerate(zip(odds[1:], vocabulary.grams, strict=True)):
        values = table[bucket]
        out[:, 1 + 2 * k] = np.maximum.reduceat(values, first)
        out[:, 2 + 2 * k] = np.add.reduceat(values, first) / count
    out[:, N_ODDS : N_ODDS + EMBED] = embeddings["word"][vocabulary.embed]
    bucket, first, count = vocabulary.grams[-1]
    out[:, N_ODDS + EMBED :] = np.add.reduceat(embeddings["gram"][bucket >> (GRAM_BITS - EMBED_BITS)], first, axis=0) / count[:, None]
    return out


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    out = {"word": draw(1 << EMBED_BITS, EMBED, scale=0.05), "gram": draw(1 << EMBED_BITS, EMBED, scale=0.05)}
    for d in "fb":
        out[f"x{d}"] = draw(N_IN, 3 * HIDDEN, scale=0.4)
        out[f"h{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
        out[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
    return out | {"v": draw(2 * HIDDEN, scale=0.3), "w": draw(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: each window's text, first word in it and length. Empty texts have one of length 0."""
    n = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(step * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return text, start, np.minimum(counts[text], WINDOW)


def _gru(x: np.ndarray, recur: np.ndarray, live: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States (T, B, HIDDEN) of one direction; x is the input part of the gates (T, B, 3 * HIDDEN)."""
    steps, rows, _ = x.shape
    out = np.empty((steps, rows, HIDDEN), np.float32)
    h = np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps):
        a = h @ recur
        gate = np.tanh((x[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]) * np.float32(0.5))
        gate *= np.float32(0.5)
        gate += np.float32(0.5)
        r, z = gate[:, :HIDDEN], gate[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if live is not None:
            new = np.where(live[t][:, None], new, h)
        if keep is not None:
            keep.append((h, r, z, n, a[:, 2 * HIDDEN :]))
        out[t] = h = new
    return out


def _positions(start: np.ndarray, size: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Word indices forward and backward (T, B), and which of them are within the window (None: all)."""
    t = np.arange(steps)[:, None]
    live = t < size
    last = start + np.maximum(size - 1, 0)
    forward = np.minimum(start + t, last)
    backward = np.maximum(last - t, start)
    return forward, backward, None if live.all() else live


def _pool(states: np.ndarray, model: dict, live: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, attention and pooled states."""
    score = states @ model["v"]
    if live is not None:
        score = np.where(live, score, np.float32(-1e9))
    score = np.exp(score - score.max(axis=0))
    if live is not None:
        score = score * live
    attention = score / np.maximum(score.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tb,tbh->bh", attention, states)
    return pooled @ model["w"] + model["c"], attention, pooled


def _backward_order(states: np.ndarray, size: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """States of the backward layer at the words' own places."""
    if live is None:
        return states[::-1]
    t = np.arange(len(states))[:, None]
    return np.take_along_axis(states, np.maximum(size - 1 - t, 0)[:, :, None], axis=0)


def logits(model: dict, gates: dict[str, np.ndarray], index: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logit of every window; gates: the input part of the gates of every distinct word, by direction."""
    out = np.empty(len(start), np.float32)
    order = np.argsort(-size, kind="stable")
    full = int((size == WINDOW).sum())
    cuts = sorted({*range(0, full, ROWS), full, *range(full, len(order), ROWS), len(order)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = order[a:b]
        steps = max(int(size[rows].max()), 1)
        forward, backward, live = _positions(start[rows], size[rows], steps)
        if not len(index):
            out[rows] = model["c"]
            continue
        forward, backward = np.minimum(forward, len(index) - 1), np.minimum(backward, len(index) - 1)
        f = _gru(gates["f"][index[forward]], model["hf"], live)
        g = _backward_order(_gru(gates["b"][index[backward]], model["hb"], live), size[rows], live)
        out[rows] = _pool(np.concatenate([f, g], axis=2), model, live)[0]
    return out


def word_gates(model: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ model[f"x{d}"] + model[f"b{d}"] for d in "fb"}


def _gru_gradient(d_out: np.ndarray, keep: list, recur: np.ndarray, live: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' input part and of the recurrent weights."""
    steps, rows, _ = d_out.shape
    d_x = np.zeros((steps, rows, 3 * HIDDEN), np.float32)
    d_recur = np.zeros_like(recur)
    d_h = np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, a_n = keep[t]
        d = d_h + d_out[t]
        on = d if live is None else d * live[t][:, None]
        d_n = on * (1 - z) * (1 - n * n)
        d_z = on * (h - n) * z * (1 - z)
        d_r = d_n * a_n * r * (1 - r)
        d_a = np.concatenate([d_r, d_z, d_n * r], axis=1)
        d_x[t] = np.concatenate([d_r, d_z, d_n], axis=1)
        d_recur += h.T @ d_a
        d_h = (d - on) + on * z + d_a @ recur.T
    return d_x, d_recur


class Adam:
    def __init__(self, model: dict, rate: float):
        self.rate, self.n = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.items()}

    def step(self, model: dict, gradient: dict) -> None:
        self.n += 1
        for k, g in gradient.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            model[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)


def gradient(model: dict, vocabulary: Vocabulary, x: np.ndarray, start: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict:
    """Gradient of the mean logistic loss of some windows."""
    steps = max(int(size.max()), 1)
    forward, backward, live = _positions(start, size, steps)
    gates = word_gates(model, x)
    keep_f, keep_b = [], []
    at_f, at_b = vocabulary.index[forward], vocabulary.index[backward]
    f = _gru(gates["f"][at_f], model["hf"], live, keep_f)
    g = _backward_order(_gru(gates["b"][at_b], model["hb"], live, keep_b), size, live)
    states = np.concatenate([f, g], axis=2)
    logit, attention, pooled = _pool(states, model, live)
    d_logit = (1 / (1 + np.exp(-logit)) - label).astype(np.float32) / len(label)
    out = {"c": np.array([d_logit.sum()], np.float32), "w": pooled.T @ d_logit}
    d_pooled = d_logit[:, None] * model["w"]
    d_attention = np.einsum("bh,tbh->tb", d_pooled, states)
    d_score = attention * (d_attention - (attention * d_attention).sum(axis=0))
    out["v"] = np.einsum("tb,tbh->h", d_score, states)
    d_states = attention[:, :, None] * d_pooled[None] + d_score[:, :, None] * model["v"]
    d_x = np.zeros_like(x)
    for d, at, keep, part in (("f", at_f, keep_f, d_states[:, :, :HIDDEN]), ("b", at_b, keep_b, d_states[:, :, HIDDEN:])):
        if d == "b":
            if live is None:
                part = part[::-1]
            else:  # back from the words' places to the order of reading
                back = np.zeros_like(part)
                np.put_along_axis(back, np.maximum(size - 1 - np.arange(steps)[:, None], 0)[:, :, None], part * live[:, :, None], axis=0)
                last_first = np.take_along_axis(part, np.maximum(size - 1, 0)[None, :, None], axis=0)[0]
                back[0] = last_first * (size > 0)[:, None]
                part = back
        elif live is not None:
            part = part * live[:, :, None]
        d_gate, out[f"h{d}"] = _gru_gradient(part, keep, model[f"h{d}"], live)
        flat, where = d_gate.reshape(-1, 3 * HIDDEN), at.ravel()
        out[f"x{d}"] = x[where].T @ flat
        out[f"b{d}"] = flat.sum(axis=0)
        np.add.at(d_x, where, flat @ model[f"x{d}"].T)
    used = np.flatnonzero(np.abs(d_x).sum(axis=1))
    out["word"] = np.zeros_like(model["word"])
    np.add.at(out["word"], vocabulary.embed[used], d_x[used, N_ODDS : N_ODDS + EMBED])
    bucket, first, count = vocabulary.grams[-1]
    out["gram"] = np.zeros_like(model["gram"])
    n = count[used]
    where = np.repeat(first[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    np.add.at(out["gram"], bucket[where] >> (GRAM_BITS - EMBED_BITS), np.repeat(d_x[used, N_ODDS + EMBED :] / n[:, None], n, axis=0))
    return out


def _one(text: bytes) -> tuple[Words, Vocabulary]:
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM)
    return words, Vocabulary(words)


def _many(texts: list[bytes]) -> tuple[Words, Vocabulary]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    words = Words(np.frombuffer(b"".join(texts), np.uint8), off, ALNUM)
    return words, Vocabulary(words)


def _highest(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf, np.float32)
    np.maximum.at(out, text, values)
    return out


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> dict | None:
    """The model: weights, odds tables and calibration; None unless both classes occur."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    half = np.array([zlib.crc32(t) & 1 for t in texts])
    counted = Odds(), Odds(), Odds()  # without the first half, without the second, and of all
    for t, y, h in zip(texts, labels, half.tolist(), strict=True):
        vocabulary = _one(t)[1]
        counted[1 - h].add(vocabulary, y)
        counted[2].add(vocabulary, y)
    sides = [odds.tables() for odds in counted]
    del counted
    model = start_weights(rng)
    adam = Adam(model, RATE)
    parts = []
    for side in (0, 1):
        mine = [i for i in range(len(texts)) if half[i] == side]
        if mine:
            words, vocabulary = _many([texts[i] for i in mine])
            text, start, size = window_starts(np.diff(words.first))
            parts.append((sides[side], vocabulary, text, words.first[text] + start, size, np.array([labels[i] for i in mine], np.float32)))
    for epoch in range(EPOCHS):
        for odds, vocabulary, text, start, size, label in parts:
            x = inputs(vocabulary, odds, model)
            if epoch < 2:  # the windows of highest odds speak for their text until the network can
                strong = np.maximum(x[:, 0], x[:, 1 : 1 + 2 * len(GRAMS) : 2].max(axis=1))
                total = np.concatenate([[0.0], np.cumsum(np.maximum(strong[vocabulary.index] - 1, 0))]) if len(vocabulary.index) else np.zeros(1)
                now = total[np.minimum(start + size, len(total) - 1)] - total[np.minimum(start, len(total) - 1)]
            else:
                now = logits(model, word_gates(model, x), vocabulary.index, start, size)
            ranked = np.lexsort((rng.random(len(now)), -now, text))
            place = np.arange(len(ranked)) - np.searchsorted(text[ranked], text[ranked])
            # of a toxic text its strongest window, of a clean text the strongest and some others
            chosen = ranked[(place == 0) | ((label[text[ranked]] == 0) & ((place == 1) | (rng.random(len(ranked)) < 0.1)))]
            chosen = chosen[size[chosen] > 0]
            rng.shuffle(chosen)
            for k in range(0, len(chosen), BATCH):
                w = chosen[k : k + BATCH]
                adam.step(model, gradient(model, vocabulary, x, start[w], size[w], label[text[w]]))
                if k + BATCH < len(chosen):
                    x[:, N_ODDS:] = inputs(vocabulary, odds, model)[:, N_ODDS:] if (k // BATCH) % 8 == 7 else x[:, N_ODDS:]
    top, truth = [], []
    for odds, vocabulary, text, start, size, label in parts:
        z = logits(model, word_gates(model, inputs(vocabulary, odds, model)), vocabulary.index, start, size)
        top.append(_highest(text, z, len(label)))
        truth.append(label)
    model["scale"] = np.array(calibrate(np.concatenate(top), np.concatenate(truth)), np.float32)
    return {"weights": model, "odds": sides[2]}


def calibrate(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) so that a * score + b is the log odds; the cut has the fewest errors, in the middle of its gap."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = best[len(best) // 2]
    lower, upper = s[k - 1] if k > 0 else s[0] - 1, s[k] if k < len(s) else s[-1] + 1
    return 1.0, float(-(lower + upper) / 2)


def _score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = packed(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows)
            for a, b in slices(off, PIECE) if model is not None else ():
                out[a:b] = scores(model, buf[off[a] : off[b]], off[a : b + 1] - off[a])
            score = pa.array(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), score], [*batch.schema.names[:-1], "score"])

    return run


def scores(model: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Scores of many texts."""
    weights = model["weights"]
    words = Words(buf, off, ALNUM)
    vocabulary = Vocabulary(words)
    text, start, size = window_starts(np.diff(words.first))
    gates = word_gates(weights, inputs(vocabulary, model["odds"], weights))
    z = logits(weights, gates, vocabulary.index, words.first[text] + start, size)
    a, b = weights["scale"]
    return 1 / (1 + np.exp(-np.clip(a * _highest(text, z, len(off) - 1).astype(float) + b, -60, 60)))


def training_sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``most`` documents of either class, none of them held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
    # of rows that share a doc_id one text, the least: so many texts as ids at most
    rows = text.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).orderBy("doc_id").collect()
    return [bytes(r["t"]) for r in rows], [int(r["toxic"]) for r in rows]


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(*training_sample(documents, labels))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), utf8("text").alias("t"))
    scored = docs.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic."""
    model = train(*training_sample(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _score(model)(batches):
            keep = pa.array(batch.column(batch.num_columns - 1).to_numpy() < 0.5)
            yield batch.select(range(batch.num_columns - 1)).filter(keep)

    return documents.withColumn(free_name(documents.columns, "text_bytes"), utf8("text")).mapInArrow(run, documents.schema)
