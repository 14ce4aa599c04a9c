import pytest

from pyspark.sql import types as T

#: More columns, some of them named like columns that operators use inside.
EXTRA = ["hash", "t", "fp", "size", "block", "spans", "rep", "target", "label_", "key", "part", "n"]
DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())] + [T.StructField(c, T.StringType()) for c in EXTRA])

LONG = " ".join(f"wort{i % 977} and{i % 31} it" for i in range(12_000))
SHARED = "this very passage of rather more than ten words stands in several documents of this small table, letter for letter"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "the QUICK brown fox\tjumps over  the lazy dog"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, LONG),
    (7, LONG),
    (8, LONG + " and one word more"),
    (9, "Überall Grün, und ÄÖÜ: 日本語 text – naïve café"),
    (10, f"First. {SHARED} Then more of its own."),
    (11, f"Second, a longer one; {SHARED}. {SHARED}"),
    (12, "a"),
    (12, "a"),
    (None, "a row without an id, which has a text"),
    (13, "=" * 500),
    (14, "x" + "=" * 400 + "y"),
    (15, "Licensed under the Apache License, Version 2.0. The MIT License; mit license, CC BY-NC"),
    (15, "Licensed under the Apache License, Version 2.0. The MIT License; mit license, CC BY-NC"),
    (15, "the same id, another text"),
    (16, "the GNU General Public License"),
]


def rows(texts):
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 2}", None if t is None else len(t), *["x"] * len(EXTRA)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(TEXTS), DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def make_documents(spark):
    return lambda texts: spark.createDataFrame(rows(texts), DOCUMENTS)


@pytest.fixture(scope="session")
def make_pages(spark):
    return lambda pages: spark.createDataFrame([(*p, *["x"] * len(EXTRA)) for p in pages], PAGES)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def as_set(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
