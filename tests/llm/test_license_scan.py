import random
import re

from orbitmill.llm import license_scan as s

from .conftest import TEXTS, as_set

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def brute(texts):
    out = []
    for i, t in texts:
        w = [x.decode() for x in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())]
        found = [(k, label) for phrase, label in s.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in found]
        out.append((i, len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))))
    return sorted(out, key=repr)


def test_base_places_equal_brute_force(documents):
    assert as_set(s.scan(documents), *COLUMNS) == brute(TEXTS)


def test_runs_across_rows(make_documents, monkeypatch):
    monkeypatch.setattr(s, "RUN", 3)
    texts = [(1, "cc by cc by the mit license apache license gnu general public license " * 3), (2, "cc"), (3, "by mit"), (4, "license apache")]
    assert as_set(s.scan(make_documents(texts)), *COLUMNS) == brute(texts)


def test_templates_with_changes(make_documents):
    grant = s.TEMPLATES["mit"][1].split()
    changed = grant[:8] + ["really", "quite"] + grant[8:15] + grant[16:]
    half = grant[: len(grant) // 3]
    texts = [(1, "Copyright someone. " + " ".join(grant) + "."), (2, " ".join(changed)), (3, " ".join(half)), (4, "no license at all"), (5, " ".join(reversed(grant)))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in s.scan(make_documents(texts)).collect()}
    assert got[1] == ("mit", 1.0)
    assert got[2][0] == "mit" and s.COVER <= got[2][1] < 1
    assert got[3] == got[4] == got[5] == ("", 0.0)


def spans_by_hand(text):
    """(template, first, last, cover) of a text, by comparing everything with everything."""
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    out = []
    for n, (said, _, is_phrase) in enumerate(s.template_texts(), 1):
        t = said.encode().split()
        if is_phrase:
            out += [(n, k, k + len(t), 1.0) for k in range(len(w)) if w[k : k + len(t)] == t]
            continue
        k = s.TEXT_K
        hits = sorted((p - q, q, p) for p in range(len(w) - k + 1) for q in range(len(t) - k + 1) if w[p : p + k] == t[q : q + k])
        bands = []
        for h in hits:
            if bands and h[0] - bands[-1][-1][0] <= s.NEAR:
                bands[-1].append(h)
            else:
                bands.append([h])
        for band in bands:
            first, last = min(p for _, _, p in band), max(p for _, _, p in band) + k
            if len({q for _, q, _ in band}) < s.COVER * (len(t) - k + 1) or last - first > s.ROOM * len(t):
                continue
            best = [[0] * (len(t) + 1)]
            for x in w[first:last]:
                row = [0]
                for j, y in enumerate(t):
                    row.append(best[-1][j] + 1 if x == y else max(row[-1], best[-1][j + 1]))
                best.append(row)
            if best[-1][-1] >= s.COVER * len(t):
                out.append((n, first, last, best[-1][-1] / len(t)))
    return out


def test_spans_equal_brute_force(make_documents):
    rng = random.Random(6)
    known = [t for t, _, _ in s.template_texts()]
    texts = list(TEXTS)
    for i in range(100, 140):
        words = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(known).split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 2)] = rng.choice([[], ["really"], t[at : at + 2], t[:3]])
            words += t + ["and"] * rng.randint(0, 3)
        texts.append((i, " ".join(words)))
    part = " ".join(known[-1].split()[:6])  # a few grams many times over, on neighbouring diagonals
    texts += [(200, " ".join([part] * 9)), (201, " ".join(w for w in known[5].split() for _ in (0, 1)))]
    label = {n: x for n, (_, x, _) in enumerate(s.template_texts(), 1)}
    want = []
    for i, t in texts:
        found = spans_by_hand(t)
        want.append((i, ",".join(sorted({label[f[0]] for f in found})), round(max((f[3] for f in found), default=0.0), 12)))
    got = [(r["doc_id"], r["labels"], round(r["score"], 12)) for r in s.scan(make_documents(texts)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert as_set(s.scan(make_documents(texts)), *COLUMNS) == brute(texts)


def test_words_decide(make_documents):
    words = s.TEMPLATES["mit"][1].encode().split()
    n = next(i for i, (t, _, _) in enumerate(s.template_texts(), 1) if t.encode().split() == words)
    assert s.verified(b" ".join(words), [(n, 0, len(words))])[1] == [(n, 0, len(words), 1.0)]
    assert s.verified(b" ".join(words[::-1]), [(n, 0, len(words))])[1] == []
    assert s.verified(b"mit licence", [(4, 0, 2)])[1] == [] and s.verified(b"the mit license", [(4, 1, 3)])[1] == [(4, 1, 3, 1.0)]


def test_labels_hold_the_base_labels(documents):
    for r in s.scan(documents).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1.0 or not r["n_base"])


def test_empty_table(no_documents):
    assert s.scan(no_documents).count() == 0
