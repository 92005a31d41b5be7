"""Whole documents in Arrow: one shuffle by their keys, sorted and read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a document, by which Spark brings them together; not handed on.
_SIZE = "__size"


def many_tasks(spark: SparkSession) -> int:
    """Tasks for rows of which each is much work: as many as a shuffle has, four for each core at least. Adaptive plans join small shuffles without a number into few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def per_document(rows: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """fn of tables of whole documents (rows of equal keys, neighbours; several documents at a time).

    Memory holds a batch and one document; a document of many batches is joined once. Rows that
    already lie by their keys, or by some of them, aren't shuffled again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the document that may go on
        for whole in batches:
            b = whole.drop_columns([_SIZE])
            last = tuple(b.column(c)[-1].as_py() for c in keys) if b.num_rows else None
            n = b.num_rows
            while n and tuple(b.column(c)[n - 1].as_py() for c in keys) == last:
                n -= 1
            first = tuple(held[0].column(c)[0].as_py() for c in keys) if held else last
            if n or first != last:
                yield fn(pa.Table.from_batches([*held, b.slice(0, n)]))
                held = []
            if b.num_rows > n:
                held.append(b.slice(n))
        if held:
            yield fn(pa.Table.from_batches(held))

    # A window asks for whole documents side by side, where repartition() would always shuffle.
    return rows.withColumn(_SIZE, F.count("*").over(W.partitionBy(*keys))).mapInArrow(run, schema)


def starts_of(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First place of each document of a table."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for c in keys:
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def documents_of(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[int, int]]:
    """First and last place (excluded) of each document of a table."""
    starts = starts_of(table, keys).tolist()
    yield from zip(starts, [*starts[1:], table.num_rows])
