"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Pieces have integer lengths of 1 to `capacity`, so best-fit decreasing depends only on how
many pieces there are of each length. The plan is made from that histogram (at most
`capacity` rows, whatever the corpus size): lengths are taken in decreasing order and each
piece goes to the tightest open sequence, which a segment tree over remaining capacities
finds in logarithmic time. Pieces of equal length that would follow one another into
sequences of equal remaining capacity are placed as one run, which gives the same packing as
piece after piece. The plan, a few thousand runs at most, is broadcast; the pieces are
numbered within their length by counting per partition, and each finds its place by
arithmetic. No task ever holds all pieces, or all of one length.

Defined results: null and empty texts have the end token alone; texts longer than the
capacity are cut into full pieces with the remainder first; ties and repeated rows get places
of their own; an empty table gives no pieces; other columns of documents are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import library_codec as codec
from .common import map_batches, materialize


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many open sequences there are at each."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need with an open sequence."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, pieces, sequence, per, offset) of best-fit decreasing.

    The piece with rank r within its length, first <= r < first + pieces, goes to sequence
    `sequence + (r - first) // per` at `offset + ((r - first) % per) * length`.
    """
    tree, open_runs, runs, made = CapacityTree(capacity), defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        done, todo = 0, histogram[length]
        while todo:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                first, n, room = made, -(-todo // per), capacity
                made += n
            else:
                first, n = open_runs[room].pop()
                tree.add(room, -n)
                per = room // length
            used = min(n, -(-todo // per))
            placed = min(todo, used * per)
            runs.append((length, done, placed, first, per, capacity - room))
            full, rest = divmod(placed, per)
            for start, count, left in ((first, full, room - per * length), (first + full, 1 if rest else 0, room - rest * length), (first + used, n - used, room)):
                if count and left:
                    open_runs[left].append((start, count))
                    tree.add(left, count)
            done, todo = done + placed, todo - placed
    return runs


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row, with its task and number.

    They are numbered by the worker that makes them: a second one for each task would hold its memory beside the codec's.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c, end = codec(path), np.array([end_id], dtype="<u4").tobytes()
        at, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            ids = memoryview(c.packed(text or "") + end)
            total = len(ids) // 4
            lo, hi, k = 0, total % capacity or min(total, capacity), 0
            while lo < total:
                at.append(i)
                piece.append(k)
                start.append(lo)
                length.append(hi - lo)
                crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                lo, hi, k = hi, hi + capacity, k + 1
        cols = [b.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), batch, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, local bigint", _numbered)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their task's number and their own among the task's rows of the same length."""
    task, seen = TaskContext.get().partitionId(), defaultdict(int)
    for b in batches:
        out = []
        for x in b.column("length").to_pylist():
            out.append(seen[x])
            seen[x] += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(out), pa.int32()), pa.array(out, pa.int64())], names=[*b.schema.names, "task", "local"])


def _ranked(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """rows with rank (0, 1, ... within its length, over all tasks) instead of task and local, and the histogram of lengths.

    Each task has numbered its own rows; the counts per (task, length) then give each task its
    start. Those counts are at most tasks x capacity small rows.
    """
    tagged = materialize(rows, "pieces")
    counts = materialize(tagged.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    starts = counts.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The starts grow with tasks x lengths, which a file size does not show: never broadcast.
    ranked = tagged.join(starts.hint("shuffle_merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "task")
    return ranked, totals


def pack(rows: DataFrame, capacity: int, numbered: bool = False) -> DataFrame:
    """rows (with a length column, 1 to capacity) with sequence_id and offset by best-fit decreasing; numbered: they come from pieces()."""
    if not numbered:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows = rows.mapInArrow(_numbered, f"{schema}, task int, local bigint")
    ranked, totals = _ranked(rows)
    by_length: dict[int, list] = defaultdict(list)
    for run in plan(totals, capacity):
        by_length[run[0]].append(run[1:])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in by_length.items()})  # runs: bounded by capacity

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        seq, offset = [], []
        runs = shared.value
        starts = {k: [r[0] for r in v] for k, v in runs.items()}
        for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
            first, _, sequence, per, off = runs[length][bisect_right(starts[length], rank) - 1]
            seq.append(sequence + (rank - first) // per)
            offset.append(off + (rank - first) % per * length)
        kept = [n for n in b.schema.names if n != "rank"]
        return pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return map_batches(ranked, place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every row with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = pack(pieces(docs, path, capacity, end_id), capacity, numbered=True)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
