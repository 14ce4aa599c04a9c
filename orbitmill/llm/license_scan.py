"""License scan by diagonal voting.

Texts are lower-cased (A-Z) and cut into words, runs of [0-9a-z] and non-ASCII
characters. All rolling word k-gram hashes of all documents are joined in Spark
to the positions of the same hashes in the templates. A hit at word ``pos`` of a
document and ``tpos`` of a template votes for the diagonal ``pos - tpos``;
neighbouring diagonals of a template are merged into bands, and a band is a
candidate span if its distinct positions of the template are enough of it, in
not much more room than the template takes. A phrase is a template of few words
that must be covered whole on one diagonal; these are the base places.

Candidates are verified by their words: the texts that have some are read again,
and a span stands if its words have a common subsequence with the template's of
``COVER`` of these at least (its share is the span's cover); a phrase must stand
there word by word. Only texts with candidates are shuffled.

The table of templates is part of this module (its size is checked before it is
broadcast).

Defined results: null text is an empty text, with 0 words, no places, null
first and last word, empty labels and score 0; rows are known by their doc_id
and a hash of their text, and equal rows come out once each; a null doc_id is
kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ALNUM, U64, Words, materialise, packed, slices, split_rows, utf8

#: Words of a gram, in phrases and in longer templates.
PHRASE_K, TEXT_K = 2, 4
#: Diagonals this near belong to one band.
NEAR = 3
#: Least share of a template's grams, and of its words, that a span must have, and most room it may take.
COVER, ROOM = 0.6, 1.5
PIECE = 1 << 20
#: Grams in one row on their way to the join.
RUN = 1 << 15
MOST_POSITIONS = 1 << 18

# Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices and grants of public licenses, by label.
TEMPLATES = {
    "gpl-3": ["licensed under the gnu general public license version 3"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

_WORDS_OF = "word counts"  # label of the row by which every document's number of words travels
_COUNT = -1


def grams(words: Words, hashes: np.ndarray, k: int) -> np.ndarray:
    return words.grams(hashes, k) ^ U64(k)


def _gram_list(text: str, k: int) -> list[int]:
    raw = text.encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    return grams(words, words.hashes(), k).astype(np.int64).tolist()


def template_texts() -> list[tuple[str, str, bool]]:
    """(text, label, is a phrase) of templates 1 and on."""
    return [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for label, texts in TEMPLATES.items() for t in texts]


def template_rows() -> list[tuple[int, str, bool, int, int, int]]:
    """(template, label, is a phrase, number of grams, tpos, gram)."""
    rows = [(0, _WORDS_OF, False, 1, 0, _COUNT)]
    for n, (text, label, is_phrase) in enumerate(template_texts(), 1):
        found = _gram_list(text, PHRASE_K if is_phrase else TEXT_K)
        rows += [(n, label, is_phrase, len(found), i, g) for i, g in enumerate(found)]
    return rows


def template_table(spark: SparkSession) -> DataFrame:
    rows = template_rows()
    table = spark.createDataFrame(rows, "template int, label string, is_phrase boolean, n_grams int, tpos int, gram long")
    return F.broadcast(table) if len(rows) <= MOST_POSITIONS else table


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of grams: (doc_id, text_key, base, grams); gram i of a run is at word base + i."""
    for batch in batches:
        buf, off = packed(batch.column(2))
        for a, b in slices(off, PIECE):
            words = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a], ALNUM)
            hashes = words.hashes()
            counts = np.diff(words.first)
            row, base, first, last, values = [], [], [], [], []
            at = 0
            for k in (PHRASE_K, TEXT_K):
                every = grams(words, hashes, k).astype(np.int64)
                values.append(every)
                for r in np.flatnonzero(counts >= k):
                    n, start = int(counts[r]) - k + 1, int(words.first[r])
                    for i in range(0, n, RUN):
                        row.append(r)
                        base.append(i)
                        first.append(at + start + i)
                        last.append(at + start + min(n, i + RUN))
                at += len(every)
            # every document's number of words
            row += range(b - a)
            base += counts.tolist()
            first += range(at, at + b - a)
            last += range(at + 1, at + b - a + 1)
            values.append(np.full(b - a, _COUNT, np.int64))
            flat = pa.array(np.concatenate(values))
            order = np.array(row) + a
            lists = _ragged(flat, np.array(first, np.int64), np.array(last, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(order)), batch.column(1).take(pa.array(order)), pa.array(np.array(base, np.int32)), lists], ["doc_id", "text_key", "base", "grams"])


def _ragged(flat: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.Array:
    size = last - first
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, size)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat.take(pa.array(index)))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), utf8("text").alias("t"))


def hits(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text_key, template and its fields, tpos, pos: every place of a template's gram in a document."""
    runs = _keyed(documents).mapInArrow(_emit, "doc_id long, text_key long, base int, grams array<long>")
    every = runs.select("doc_id", "text_key", "base", F.posexplode("grams").alias("i", "gram"))
    return every.join(templates, "gram").select("doc_id", "text_key", "template", "label", "is_phrase", "n_grams", "tpos", (F.col("base") + F.col("i")).alias("pos"))


def candidates(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Bands with enough votes: doc_id, text_key, template, first, last (words, last + 1), copies.

    Template 0 has one row for each document, with its number of words as ``first``.
    """
    once = hits(documents, templates).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    known = ["doc_id", "text_key", "template", "is_phrase", "n_grams"]
    once = once.groupBy(*known, "diagonal", "tpos").agg(F.count(F.lit(1)).alias("copies"))
    once = once.repartition("doc_id", "text_key")
    ordered = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal", "tpos")
    step = F.col("diagonal") - F.lag("diagonal").over(ordered)
    apart = F.coalesce(step > F.when(F.col("is_phrase") | (F.col("template") == 0), F.lit(0)).otherwise(F.lit(NEAR)), F.lit(True))
    banded = once.withColumn("apart", apart).withColumn("band", F.sum(F.col("apart").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("diagonal") + F.col("tpos")
    # a position of the template votes once in a band, on however many of its diagonals
    by_position = banded.groupBy(*known, "band", "tpos").agg(F.max("copies").alias("copies"), F.min(place).alias("first"), F.max(place).alias("at"))
    joined = by_position.groupBy(*known, "band").agg(F.count(F.lit(1)).alias("votes"), F.max("copies").alias("copies"), F.min("first").alias("first"), F.max("at").alias("at"))
    k = F.when(F.col("is_phrase"), PHRASE_K).otherwise(TEXT_K)
    room = F.col("at") - F.col("first") + k
    whole = F.col("votes") == F.col("n_grams")
    enough = (F.col("votes") >= F.lit(COVER) * F.col("n_grams")) & (room <= F.lit(ROOM) * (F.col("n_grams") + k - 1))
    kept = joined.where((F.col("template") == 0) | F.when(F.col("is_phrase"), whole).otherwise(enough))
    return kept.select("doc_id", "text_key", "template", F.col("first").cast("int").alias("first"), (F.col("at") + k).cast("int").alias("last"), "copies")


def common_words(span: list[bytes], template: list[bytes]) -> int:
    """Length of the longest common subsequence of words, a bit for each word of the template."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    whole, row = (1 << len(template)) - 1, (1 << len(template)) - 1
    for w in span:
        both = row & at.get(w, 0)
        row = ((row + both) | (row - both)) & whole
    return len(template) - row.bit_count()


def verified(text: bytes, spans: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int, float]]]:
    """Number of words of a text, and the (template, first, last, cover) of its candidates that its words bear out."""
    words = text.translate(ALNUM).split()
    known = template_texts()
    out = []
    for template, first, last in spans:
        said, _, is_phrase = known[template - 1]
        want = said.encode().split()
        if is_phrase:
            if words[first : first + len(want)] == want:
                out.append((template, first, first + len(want), 1.0))
        elif (n := common_words(words[first:last], want)) >= COVER * len(want):
            out.append((template, first, last, n / len(want)))
    return len(words), out


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result's rows of texts with candidates (doc_id, text, candidates)."""
    known = template_texts()
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            n, found = verified(text.as_py(), [(s["template"], s["first"], s["last"]) for s in spans])
            base = [(first, known[t - 1][1]) for t, first, _, _ in found if known[t - 1][2]]
            labels = {known[t - 1][1] for t, _, _, _ in found}
            places = [p for p, _ in base]
            rows.append((doc, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max((c for *_, c in found), default=0.0)))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    found = materialise(candidates(documents, template_table(documents.sparkSession)), "license-candidates")
    spans = found.where("template > 0").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("template", "first", "last"))).alias("spans"))
    spans = materialise(spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans"), "license-spans")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    none = F.lit(None).cast("long")
    clean = found.where("template = 0").join(spans, same, "left_anti").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    clean = clean.select("doc_id", F.col("first").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    docs = _keyed(documents)
    _, asked = split_rows(docs.select("doc_id", "t", "text_key"), spans.select("k"))
    return clean.unionByName(asked.join(spans, same).select("doc_id", "t", "spans").mapInArrow(_verify, RESULT))
