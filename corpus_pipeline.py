"""The corpus pipeline: five stages from raw documents to a weighted mix.

Each stage works on all that its predecessor kept and its decisions take
effect. All stages but the last return the columns of ``documents``.

Defined results, in every stage: null texts count as empty ones and stay null;
null doc_ids, sources and other columns are kept, and a null doc_id counts as
larger than all others; of documents equal in all that a stage compares one
stays, the same in every run; extra columns pass unchanged whatever their names
(but n_chars, which follows the text); an empty table stays empty, and empty
``labels`` or ``benchmark`` tables reject nothing. Texts are read whole, however
long they are. Stages lower the session's Arrow batches to ``BATCH_ROWS`` rows
and ``BATCH_BYTES`` bytes, and leave it so, as their results are read later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitmill.llm import decontaminate, mixing, simhash, suffix_dedup, toxicity
from orbitmill.llm.shared import materialise

#: Rows and bytes of texts that the session hands to Python at a time, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds, also where a stage's result is written later: it stays set in the session."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        have = str(spark.conf.get(key, None) or "")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(key, str(most))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    _small_batches(spark)
    return simhash.keep_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that an earlier document has are cut out of the texts; n_chars follows."""
    _small_batches(spark)
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark contaminates go."""
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many times the mix takes each document."""
    _small_batches(spark)
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", contaminated),
    ("mixing", weighted_mix),
]

#: A trained classifier and a sampling design can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
