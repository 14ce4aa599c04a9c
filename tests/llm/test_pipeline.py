from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as p
import __spark_entry__
from orbitmill.functions.scratch import scratch_path

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in p.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing"]
    found = __spark_entry__.queries()
    assert "pipeline" in found
    assert {k.split("_")[0] for k in found if k.startswith("op") and k[2].isdigit()} == {f"op{i}" for i in range(1, 11)}


def test_each_stage_keeps_the_columns_and_acts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns, name
        counts.append(after.count())
        docs = after
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    assert docs.where("n_chars <> length(text)").count() == 0
    out = p.run(spark, SF)
    assert out.count() == counts[-1]
    assert "doc_id" in out.columns and "taken" in out.columns


def test_odd_documents_pass(spark, documents):
    narrow = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES[:-1]:
        narrow = stage(spark, narrow, SF).cache()
        assert narrow.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < narrow.count() < len(TEXTS)
    assert p.STAGES[-1][1](spark, narrow, SF).count() == narrow.count()


def test_empty_tables_and_extra_columns(spark, no_documents, make_documents):
    few = make_documents([(1, "one two three four"), (2, "one two three four"), (None, None), (3, "x" * 120)]).withColumn("__key", F.lit("mine"))
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, no_documents, SF).columns == no_documents.columns
        few = stage(spark, few, SF).cache()
    assert sorted((r["doc_id"], r["__key"], r["hash"]) for r in few.where("doc_id is not null").collect()) == [(1, "mine", "x"), (3, "mine", "x")]
    assert p.STAGES[-1][1](spark, no_documents, SF).count() == 0


def test_what_is_left_in_the_scratch_folder(spark):
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = set(folder.glob("*"))
    for _, stage in p.STAGES:
        stage(spark, docs, SF).count()
    kinds = sorted(x.name.rpartition("-")[0] for x in set(folder.glob("*")) - before)
    # what the results still read; everything else has gone
    assert kinds == sorted(["simhash-asked", "removals", "mix-targets", *[k for k in kinds if k.startswith("mix-flight-")]])


def test_stages_bound_what_python_gets(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        spark.conf.set(keys[0], "7")
        spark.conf.set(keys[1], "64MB")
        p._small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["7", str(p.BATCH_BYTES)]
        spark.conf.set(keys[0], "10000")
        p._small_batches(spark)
        assert spark.conf.get(keys[0]) == str(p.BATCH_ROWS)
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
