"""Exact deduplication by composable polynomial fingerprints.

A text of n bytes b0..b(n-1) has the fingerprint sum(b_i * r^(n-1-i)) mod p for two primes.
Fingerprints compose: fp(A + B) = fp(A) * r^len(B) + fp(B), so chunks of a text are hashed
side by side (one exact float64 matrix product for all chunks of a batch) and combined by
shifting with the length of what follows. combine_parts() does the same for documents that
are stored as many rows.

Rows with equal length and fingerprint are only candidates: their texts are cut into chunks
and compared, chunk by chunk, with one representative of their group. Rows that differ from
the representative (a fingerprint collision) go through another round among themselves.

Defined results: null text counts as empty; empty texts equal each other; a null doc_id is the
smallest; of rows that share the largest doc_id (repeated rows) exactly one is kept; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleaning, dealt_join, free_name, map_batches, mark, materialize, tidy, with_row_id

#: Two primes just under 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1999999973)
#: Bytes of a hashed chunk: 2^8 * 2^31 * 2^10 < 2^53, so float64 sums are exact.
CHUNK = 1024
#: Chunks hashed in one product; bounds the float64 copy to 16 MB.
SLAB = 2048
#: Bytes of a chunk in the streaming comparison.
COMPARE_BYTES = 1 << 16
#: Rows of a group that are compared with one copy of the representative's chunks.
ROWS_PER_COPY = 64

_POWERS = np.array([[pow(b, CHUNK - 1 - i, p) for b, p in zip(BASES, PRIMES)] for i in range(CHUNK)], dtype=np.float64)


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Fingerprint of the concatenation of two byte strings, from theirs and the second's length."""
    return tuple((a * pow(r, right_len, p) + b) % p for a, b, r, p in zip(left, right, BASES, PRIMES))


def chunk_hashes(data: np.ndarray) -> np.ndarray:
    """Fingerprints (rows x 2) of rows of CHUNK bytes."""
    out = np.empty((len(data), 2), dtype=np.int64)
    for at in range(0, len(data), SLAB):
        out[at : at + SLAB] = np.fmod(data[at : at + SLAB].astype(np.float64) @ _POWERS, PRIMES).astype(np.int64)
    return out


def fingerprints(texts: list[bytes]) -> list[tuple[int, int]]:
    """Fingerprint of every byte string; zero bytes in front don't change one, so the first chunk is padded there."""
    counts = [-(-len(t) // CHUNK) for t in texts]
    data = np.zeros((sum(counts), CHUNK), dtype=np.uint8)
    flat, at = data.reshape(-1), 0
    for t, n in zip(texts, counts):
        at += n * CHUNK
        flat[at - len(t) : at] = np.frombuffer(t, dtype=np.uint8)
    hashed = chunk_hashes(data)
    shift = tuple(pow(r, CHUNK, p) for r, p in zip(BASES, PRIMES))
    first, second, at, out = hashed[:, 0].tolist(), hashed[:, 1].tolist(), 0, []
    for n in counts:
        a = b = 0
        for i in range(at, at + n):
            a = (a * shift[0] + first[i]) % PRIMES[0]
            b = (b * shift[1] + second[i]) % PRIMES[1]
        at += n
        out.append((a, b))
    return out


def with_fingerprints(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep of rows (text among its columns), with n_bytes, fp (two residues in one long) and text_sha256."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(x or "").encode() for x in b.column("text").to_pylist()]
        made = [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([(x << 31) | y for x, y in fingerprints(texts)], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, "n_bytes", "fp", "text_sha256"])

    read = rows.select(*dict.fromkeys([*keep, "text"]))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(read, batch, f"{kept}, n_bytes bigint, fp bigint, text_sha256 string")


def combine_parts(parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n_bytes, fp) of documents stored as several rows: parts are hashed in parallel, then combined in order.

    parts has the columns key, order and text. Only 24 bytes a part are shuffled; null texts count as empty.
    """

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("o")
        h, total = (0, 0), 0
        for n, fp in zip(rows.column("n_bytes").to_pylist(), rows.column("fp").to_pylist()):
            h, total = combine(h, (fp >> 31, fp & 0x7FFFFFFF), n), total + n
        return pa.table({"k": rows.column("k")[:1], "n_bytes": pa.array([total], pa.int64()), "fp": pa.array([(h[0] << 31) | h[1]], pa.int64())})

    named = parts.select(F.col(key).alias("k"), F.col(order).alias("o"), "text")
    kind = parts.schema[key].dataType.simpleString()
    hashed = with_fingerprints(named, ["k", "o"]).select("k", "o", "n_bytes", "fp")
    return hashed.groupBy("k").applyInArrow(merge, f"k {kind}, n_bytes bigint, fp bigint").withColumnRenamed("k", key)


def _chunks(rows: DataFrame, *cols: str) -> DataFrame:
    """cols with idx and chunk: the text's bytes, cut into pieces of COMPARE_BYTES; an empty text is one empty chunk."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    last = F.greatest(F.floor((F.col("n_bytes") - 1) / COMPARE_BYTES), F.lit(0)).cast("int")
    at = rows.select(*cols, data.alias("__data"), F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    return at.select(*cols, "idx", F.substring("__data", F.col("idx") * COMPARE_BYTES + 1, F.lit(COMPARE_BYTES)).alias("chunk"))


def _shares(n: str) -> Column:
    """Into how many shares a group of n rows is dealt."""
    return F.ceil(F.col(n) / ROWS_PER_COPY).cast("int")


def _dealt(groups: DataFrame) -> DataFrame:
    """Rows of (..., n), one group each, repeated for every share of their group."""
    return groups.withColumn("share", F.explode(F.sequence(F.lit(0), _shares("n") - 1)))


def _verify(rows: DataFrame) -> DataFrame:
    """rows of equal length and fingerprint, with rep_id and rep_row of their group and same: whether the texts are equal.

    n is the size of a row's group. Groups are dealt out in shares of about ROWS_PER_COPY rows,
    each with its own copy of the representative's chunks, so that no group meets in one task.
    """
    key = ["n_bytes", "fp"]
    reps = rows.groupBy(*key).agg(F.max(F.struct("doc_id", "row")).alias("rep"), F.max("n").alias("n"))
    reps = reps.select(*key, F.col("rep.doc_id").alias("rep_id"), F.col("rep.row").alias("rep_row"), "n")
    joined = rows.withColumn("share", F.pmod(F.xxhash64("row"), _shares("n")).cast("int")).join(_dealt(reps).drop("n"), [*key, "share"])
    mine = _chunks(joined, "row", "doc_id", "text_sha256", "rep_id", "rep_row", "share", "n")
    its = _dealt(joined.filter(F.col("row") == F.col("rep_row")).drop("share"))
    its = _chunks(its, "rep_row", "share").withColumnRenamed("chunk", "rep_chunk")
    met = mine.join(its, ["rep_row", "idx", "share"])
    return met.groupBy("row", "doc_id", "text_sha256", "rep_id", "rep_row", "share", "n").agg(F.min(F.col("chunk") == F.col("rep_chunk")).alias("same"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs, keep_id being that of the row that stays.

    Three passes: fingerprints of all rows; texts of candidate rows, found by an equi-join on
    (length, fingerprint); their chunkwise comparison. Texts without a candidate partner are
    shuffled at most once (not at all where the candidate keys are few enough for Spark's own
    size-checked broadcast). Copies of one text are dealt over parts by their number.
    """
    src = docs.select("doc_id", "text")
    key = ["n_bytes", "fp"]
    prints = materialize(with_fingerprints(src, ["doc_id"]), "fingerprints")
    shared = materialize(prints.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "shared-fingerprints")
    numbered = lambda df: df.withColumn("__at", F.monotonically_increasing_id())  # noqa: E731  (rows as they are read: equal doc_ids are dealt apart)
    single = dealt_join(numbered(prints), shared, key, "n", ["__at"], "left_anti")
    met = dealt_join(numbered(with_fingerprints(src, ["doc_id", "text"])), shared, key, "n", ["__at"])
    rows = with_row_id(met.drop("__at"), "candidates", "row")
    done, todo = None, rows
    while True:
        met = materialize(_verify(todo), "compared")
        done = met.filter("same") if done is None else done.unionByName(met.filter("same"))
        other = met.filter(~F.col("same")).select("row")
        if other.isEmpty():
            break
        todo = materialize(todo.join(other, "row", "left_semi"), "collided")
    sizes = _dealt(done.groupBy("rep_row").agg(F.count("*").alias("group_size"), F.max("n").alias("n"))).drop("n")
    copies = done.join(sizes, ["rep_row", "share"]).select(
        "doc_id", F.col("rep_id").alias("keep_id"), "group_size", (F.col("row") == F.col("rep_row")).alias("kept"), "text_sha256"
    )
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(copies)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat another row's text; the row with the largest doc_id stays, all columns are kept.

    Rows are numbered in a written copy, so repeated rows (same doc_id, same text) leave one.
    """
    row = free_name(docs, "__row")
    numbered = with_row_id(docs, "numbered", row)
    as_id = numbered.select(F.struct(F.col("doc_id").alias("d"), F.col(row).alias("r")).alias("doc_id"), "text")
    with cleaning(docs.sparkSession):
        since = mark()
        gone = materialize(exact_groups(as_id).filter("NOT kept").select(F.col("doc_id.r").alias(row)), "copies")
        tidy(since)
    return numbered.join(gone, row, "left_anti").drop(row)
