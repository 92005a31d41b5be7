"""Plumbing that the corpus operators share: scratch tables, folds, bounded samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    got = spark.sparkContext.getCheckpointDir()
    if not got:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blockloom-"))
        got = spark.sparkContext.getCheckpointDir()
    return got


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    """Best effort when the interpreter ends; a stopped session leaves its folder to the cluster's cleaner."""
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time, for tidy()."""
    return len(_made)


def tidy(since: int) -> None:
    """Delete the scratch tables written since a mark but the last one, which holds what they were for."""
    for spark, path in _made[since:-1]:
        delete(spark, path)
    del _made[since:-1]


def latest() -> str:
    """Where the scratch table written last is."""
    return _made[-1][1]


def scrap(path: str) -> None:
    """Delete one scratch table."""
    for spark, at in [m for m in _made if m[1] == path]:
        delete(spark, at)
        _made.remove((spark, at))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """While this lasts, the files of a write's shuffles go as soon as it is done; the session's setting comes back after it."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; -1 for a null id, which belongs to no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def bounded_sample(df: DataFrame, key: str, cap: int) -> DataFrame:
    """At most about cap rows of a keyed table, chosen by a hash of the key so that a rerun draws the same.

    The hash threshold gives nineteen twentieths of cap in expectation; the limit makes cap a hard bound.
    """
    n = df.count()
    if n <= cap:
        return df
    share = int((1 << 30) * 0.95 * cap / n)
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) < share).limit(cap)


#: Rows of one key that meet in a part of a dealt join.
SHARE = 512
#: Hashes of keys by which a dealt join tells those of many rows.
SLOTS = 1 << 14


def dealt_join(rows: DataFrame, groups: DataFrame, on: list[str], n: str, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row for each key `on` and in the column n how many rows may hold it.

    A key of n rows is dealt over about n / SHARE parts by the columns `by` of rows, and its row of groups is repeated in
    each. Rows are told to be dealt by a slot, which is a hash of their key: the slots in which a key has more than SHARE
    rows are broadcast, SLOTS rows of two numbers at most whatever the tables' size. Keys that share a slot with such a
    key are dealt as it is, which changes no result. groups is read twice, so it should be a written table.
    """
    slot = F.pmod(F.xxhash64(*on), F.lit(SLOTS))
    hot = groups.filter(F.col(n) > SHARE).groupBy(slot.alias("__slot")).agg(F.max(F.ceil(F.col(n) / SHARE)).alias("__shares"))

    def placed(df: DataFrame, share) -> DataFrame:
        shares = F.coalesce("__shares", F.lit(1))
        return df.withColumn("__slot", slot).join(F.broadcast(hot), "__slot", "left").withColumn("__share", share(shares)).drop("__slot", "__shares")

    mine = placed(rows, lambda shares: F.pmod(F.xxhash64(*by), shares))
    its = placed(groups, lambda shares: F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    return mine.join(its, [*on, "__share"], how).drop("__share")


#: Rows that Spark hands to Python at once, where the session keeps Spark's own default: some MB of text.
BATCH_ROWS = 512
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch from Spark's default, which is meant for narrow rows; a user's own setting stays.

    A batch of 10,000 documents is held by the JVM, by Arrow and as Python values at once.
    """
    if spark.conf.get(_ROWS_CONF) == "10000":
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """mapInArrow with a function of one record batch; None gives no rows. `then` takes all that a task made, in the same worker.

    Batches have BATCH_ROWS rows, and those with a column `text` some MB of it (a longer text comes alone).
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole) if "text" in whole.schema.names else (whole,):
                out = fn(b)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(lambda batches: then(run(batches)), schema)


def text_filter(docs: DataFrame, keep: Callable[[pa.Array], pa.Array], limit: int = 8 << 20) -> DataFrame:
    """The rows of docs whose text passes, with all columns; Python sees the text alone, a slice at a time."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def passes(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        return pa.concat_arrays([keep(part.column("text")) for part in text_slices(batch, limit=limit)] or [pa.array([], pa.bool_())])

    return docs.filter(passes(F.col("text")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that df has no column of."""
    taken, got, n = {c.lower() for c in df.columns}, name, 0
    while got.lower() in taken:
        n += 1
        got = f"{name}_{n}"
    return got


def with_row_id(docs: DataFrame, name: str, id_col: str = "__row") -> DataFrame:
    """docs written to the shared folder with a stable number per row, so that repeated rows stay apart."""
    return materialize(docs.withColumn(id_col, F.monotonically_increasing_id()), name)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with at most `limit` bytes of text each (a longer text alone), to bound memory."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield batch.slice(first)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
