"""Tables of the steps of a loop, in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []
#: Whether the files of a query's shuffles go when it ends; otherwise they stay until the driver's memory is tidied.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set for checkpoints; a temporary one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blockloom-"))
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _left:
        _delete(spark, path)


class Scratch:
    """Written tables that go together: leaving the block deletes all but those released."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.paths = spark, shared_folder(spark), []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back: lineage ends here, the files of its shuffles go, and a lost executor costs no step before it."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the tables of a name; nothing may read them any more."""
        for path in [p for p in self.paths if p.startswith(f"{self.root}/{name}-")]:
            _delete(self.spark, path)
            self.paths.remove(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """The same for a table that outlives the block; it goes when the interpreter ends."""
        got = self.keep(df, name)
        if not _left:
            atexit.register(_clean)
        _left.append((self.spark, self.paths.pop()))
        return got

    def __exit__(self, *_) -> None:
        for path in self.paths:
            _delete(self.spark, path)
