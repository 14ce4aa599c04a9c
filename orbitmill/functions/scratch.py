"""Tables written once to a folder that driver and executors share.

A table lives as long as its ``Scratch``: operators drop their intermediate
tables when they have written what follows from them. Tables that a returned
DataFrame still reads (``materialise``) live until the application ends, when
its folder is deleted.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, tempfile.TemporaryDirectory] = {}
_app_dirs: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset and the master is local (tests), a temporary folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.TemporaryDirectory(prefix="orbitmill-", ignore_cleanup_errors=True)
        atexit.register(_own_dirs[app].cleanup)
    return _own_dirs[app].name


def delete(path: str) -> None:
    """Deletes a folder, by Spark's own file system layer."""
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _clear() -> None:
    """Deletes the folders of the applications that this process ran."""
    for path in _app_dirs if SparkContext._jvm is not None else ():
        try:
            delete(path)
        except Exception:  # the JVM or the store has gone; the folder's name says whose it was
            return


def scratch_path(spark: SparkSession, tag: str) -> str:
    folder = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    _app_dirs.add(folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the scratch folder and reads it back: lineage ends here, and lost executors cost no recomputation."""
    return written(df, scratch_path(df.sparkSession, tag))


class Scratch:
    """Tables that are needed only until a result of theirs is written; as a context, dropped at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def folder(self, tag: str) -> str:
        """A folder of its own, for other files than tables."""
        path = scratch_path(self.spark, tag)
        self.paths[path] = path
        return path

    def table(self, df: DataFrame, tag: str, replaces: str | None = None) -> DataFrame:
        """Writes a table; the one last written under the name ``replaces`` is dropped after it."""
        path = scratch_path(self.spark, tag)
        out = written(df, path)
        gone = self.paths.pop(replaces, None) if replaces else None
        if gone:
            delete(gone)
        self.paths[replaces or path] = path
        return out

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, or all."""
        for name in names or list(self.paths):
            if path := self.paths.pop(name, None):
                delete(path)
