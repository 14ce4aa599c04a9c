import hashlib
import re

from pyspark.sql import functions as F

from orbitmill.llm import decontaminate as d

from .conftest import SHARED, TEXTS, as_set

ITEMS = [(1, SHARED), (2, "lazy dog"), (3, None), (4, "..."), (2, "naïve café"), (10, "nothing that occurs"), (None, "MIT License")]


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(texts, items, width=13):
    out = []
    for i, text in texts:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            x = words(t)
            n = min(width, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == x[k : k + n]:
                        hit |= set(range(a, a + n))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_equals_brute_force(spark, documents):
    assert as_set(d.decontaminate(documents, benchmark(spark)), *COLUMNS) == brute(TEXTS, ITEMS)


def test_more_windows_than_a_slice(spark, documents):
    found = d.find_hits(documents, benchmark(spark), most=3)
    got = as_set(found.withColumn("n_hit", d.n_hit()).selectExpr("doc_id", "n_words", "n_hit", "size(items) as n_items"), "doc_id", "n_words", "n_hit", "n_items")
    assert got == sorted([r[:4] for r in brute(TEXTS, ITEMS)], key=repr)
    few = d.drop_contaminated(documents, benchmark(spark), most=3)
    whole = d.drop_contaminated(documents, benchmark(spark))
    assert as_set(few, "doc_id", "text") == as_set(whole, "doc_id", "text")


def test_slices_of_an_input_in_changing_order(spark, documents):
    shuffled = documents.withColumn("__order", F.expr("reflect('java.lang.Math', 'random')")).orderBy("__order").drop("__order")
    found = d.find_hits(shuffled, benchmark(spark), most=3).withColumn("n_hit", d.n_hit()).withColumn("n_items", F.size("items"))
    assert as_set(found, *COLUMNS[:4]) == sorted([r[:4] for r in brute(TEXTS, ITEMS)], key=repr)
    few = d.drop_contaminated(shuffled, benchmark(spark), most=3)
    assert as_set(few, "doc_id", "text") == as_set(d.drop_contaminated(documents, benchmark(spark)), "doc_id", "text")


def test_contaminated_documents_go_and_others_stay_whole(spark, documents):
    kept = d.drop_contaminated(documents, benchmark(spark))
    assert kept.schema == documents.schema
    assert as_set(kept, "doc_id", "text") == sorted([x for x in TEXTS if not brute([x], ITEMS)[0][-1]], key=repr)


def test_empty_tables(spark, documents, no_documents):
    assert d.decontaminate(no_documents, benchmark(spark)).count() == 0
    clean = d.decontaminate(documents, benchmark(spark, []).limit(0))
    assert clean.count() == len(TEXTS) and clean.where("contaminated or n_hit > 0").count() == 0


def test_twentieth(spark, make_documents):
    docs = make_documents([(1, "lazy dog " + "w " * 38), (2, "lazy dog " + "w " * 39)])
    got = as_set(d.decontaminate(docs, benchmark(spark)), "doc_id", "n_words", "contaminated")
    assert got == [(1, 40, True), (2, 41, False)]


def test_remove_spans(spark, make_documents):
    assert d.drop_spans("One, two; three! four.", [(1, 3)]) == "One, ! four."
    docs = make_documents([(1, "A Lazy, dog lies. NAÏVE?"), (2, "nothing here"), (3, None), (4, "")]).withColumn("__spans", F.lit("s"))
    cut = d.remove_spans(docs, benchmark(spark))
    assert cut.schema == docs.schema
    assert as_set(cut, "doc_id", "text", "__spans") == [(1, "A  lies. NAÏVE?", "s"), (2, "nothing here", "s"), (3, None, "s"), (4, "", "s")]


def test_windows_of_a_benchmark(spark):
    found = d.window_table(benchmark(spark, [*ITEMS, (5, "Lazy; dog!"), (5, "a lazy dog")]), 2)
    got = {(r["n"], bytes(r["said"])): r["items"] for r in found.collect()}
    assert got[2, b"lazy dog"] == ["2", "5"] and got[2, b"mit license"] == [""] and (2, b"a lazy") in got
    assert len(d.window_sets(found, most=3)) == -(-len(got) // 3)


def test_clashing_names(spark, documents):
    docs = documents.withColumn("__text_bytes", F.lit("mine"))
    kept = d.drop_contaminated(docs, benchmark(spark))
    assert kept.schema == docs.schema and kept.select("__text_bytes").distinct().collect() == [("mine",)]
