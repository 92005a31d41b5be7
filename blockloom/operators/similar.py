"""Similarity join of blocks, and the best one-to-one pairs among what it finds.

Blocks meet only within their keys, short ones by arrays, long ones through an inverted index over
the tokens that a pair at the threshold must share (kernels.similar): no table of all pairs is made,
and pairs below the threshold leave no row. Blocks of equal kind, folded name and text are one class
and compared once. The old blocks of a large group are dealt into shares, each with all new ones,
so that no group is one task's work alone. A task hands on its pairs, those of copies too, as it
finds them; an assignment takes classes with their members and makes no such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..kernels.assignment import best_edges, best_of_classes
from ..kernels.similar import similar_rows
from .documents import many_tasks

#: Old blocks of a share.
SHARE = 1024
#: Members of a class that are one row: a class with more is dealt over shares.
MEMBERS = 1024
#: Pairs of a batch that a task hands on, about.
_BATCH = 1 << 16


def _classed(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, kind, name, body, class): the rows that take part; class is the digest of kind, folded name and body."""
    text = lambda c: F.encode(F.coalesce(c, F.lit("")), "utf-8")
    able = side.dropna(subset=["id", *keys])
    rows = able.select(*keys, "id", "kind", text(C.folded_name(F.coalesce("name", F.lit("")))).alias("name"), text(F.col("body")).alias("body"))
    kind = F.coalesce(F.concat(F.lit("k"), "kind"), F.lit(""))
    sizes = F.concat_ws(":", F.length(F.encode(kind, "utf-8")), F.length("name"), kind)
    return rows.withColumn("class", F.unhex(F.sha2(F.concat(F.encode(sizes, "utf-8"), "name", "body"), 256)))


def _similar_classes(a: DataFrame, b: DataFrame, keys: Sequence[str], threshold: float, named: bool) -> DataFrame:
    """(keys, old_class, new_class, similarity) of the classes of _classed() whose similarity is `threshold` or more."""
    limit = min(max(threshold, 0.0), 1.0) if threshold == threshold else 1.0
    one_each = lambda side: side.groupBy(*keys, "class").agg(*(F.first(c).alias(c) for c in ("kind", "name", "body")))
    a, b = one_each(a), one_each(b)
    shares = a.groupBy(*keys).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    deal = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    a = a.join(shares, list(keys)).withColumn("share", F.pmod(F.xxhash64("class"), F.col("shares")).cast("int")).drop("shares")
    b = b.join(shares, list(keys)).select("*", deal).drop("shares")
    b = b.select(*(F.col(c).alias(f"new_{c}") for c in b.columns))  # both sides may come from one table
    names = [*keys, "old_class", "new_class", "similarity"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        fields = [*(x.schema.field(k).type for k in keys), pa.binary(), pa.binary(), pa.float64()]
        found: list[tuple] = []
        if x.num_rows and y.num_rows:
            blocks = (list(zip(*(t.column(f"{c}{name}").to_pylist() for name in ("kind", "name", "body")))) for t, c in ((x, ""), (y, "new_")))
            own, ids = x.column("class").to_pylist(), y.column("new_class").to_pylist()
            key = [x.column(k)[0].as_py() for k in keys]
            for i, at, s in similar_rows(*blocks, limit, named):
                found += [(*key, own[i], ids[j], t) for j, t in zip(at.tolist(), s.tolist())]
        columns = zip(*found) if found else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, fields)], names=names)

    schema = ", ".join([*(f"{k} {a.schema[k].dataType.simpleString()}" for k in keys), "old_class binary, new_class binary, similarity double"])
    by, new_by = [*keys, "share"], [*(f"new_{k}" for k in keys), "new_share"]
    n = many_tasks(a.sparkSession)  # a few MB of blocks are many comparisons
    return a.repartition(n, *by).groupBy(*by).cogroup(b.repartition(n, *new_by).groupBy(*new_by)).applyInArrow(meet, schema)


def _members(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class, chunk, kind, name, body, ids): the ids of each class, MEMBERS a row at most."""
    place = F.row_number().over(W.partitionBy(*keys, "class").orderBy("id"))
    chunk = F.floor((place - 1) / MEMBERS).cast("int").alias("chunk")
    block = (F.first(c).alias(c) for c in ("kind", "name", "body"))
    return side.select("*", chunk).groupBy(*keys, "class", "chunk").agg(*block, F.collect_list("id").alias("ids"))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half up as decimals, which is what Spark's round() does."""
    scaled = x * 10.0**digits
    whole = np.rint(scaled)
    out = whole / 10.0**digits
    for i in np.flatnonzero(np.abs(np.abs(scaled - whole) - 0.5) < 1e-4).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _listed(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of all lists in one array, where each list begins in it, and how long it is."""
    sizes = pc.list_value_length(ids).to_numpy().astype(np.int64)
    flat = pc.list_flatten(ids).combine_chunks()
    return flat, np.cumsum(sizes) - sizes, sizes


def similar_pairs(old: DataFrame, new: DataFrame, keys: Sequence[str], threshold: float = 0.5, named: bool = True, digits: int | None = None) -> DataFrame:
    """(keys, old_id, new_id, similarity) of all blocks of equal keys whose similarity is `threshold` or more.

    Both sides have the keys, id, kind, name and body (the text that is compared). Without
    `named` names count for nothing, as between comments. Null names and bodies count as empty,
    rows with a null id or key take no part; a threshold above 1 finds nothing. With `digits`
    similarities are rounded, once for all copies of two blocks.
    """
    limit = min(max(threshold, 0.0), 1.0) if threshold == threshold else 1.0
    a, b = (_members(_classed(side, keys), keys) for side in (old, new))
    shares = old.dropna(subset=["id", *keys]).groupBy(*keys).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    own = F.pmod(F.xxhash64("class", "chunk"), F.col("shares")).cast("int").alias("share")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    a, b = (x.join(shares, list(keys)).select(*keys, deal, "kind", "name", "body", F.col("ids").alias(ids)) for x, deal, ids in ((a, own, "old_ids"), (b, every, "new_ids")))
    both = a.unionByName(b, allowMissingColumns=True)
    kind = {s: both.schema[f"{s}_ids"].dataType.elementType.simpleString() for s in ("old", "new")}
    names = [*keys, "old_id", "new_id", "similarity"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, y = (t.filter(pc.is_valid(t.column(c))) for c in ("old_ids", "new_ids"))
        key = [t.column(k)[0] for k in keys]
        blocks = [list(zip(*(side.column(c).to_pylist() for c in ("kind", "name", "body")))) for side in (x, y)]
        del t
        (old_ids, old_start, old_size), (new_ids, new_start, new_size) = _listed(x.column("old_ids")), _listed(y.column("new_ids"))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []  # place of an old id, places of new ids, similarities

        def batch() -> pa.RecordBatch:
            places = np.repeat([i for i, _, _ in held], [len(at) for _, at, _ in held])
            columns = [old_ids.take(pa.array(places)), new_ids.take(pa.array(np.concatenate([at for _, at, _ in held]))), pa.array(np.concatenate([s for *_, s in held]))]
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.repeat(k, len(places)) for k in key), *columns], names=names)

        waiting = 0
        for i, at, s in similar_rows(*blocks, limit, named) if all(blocks) else ():
            s = s if digits is None else _rounded(s, digits)
            size = new_size[at]
            n = int(size.sum())
            places = np.repeat(new_start[at] - np.cumsum(size) + size, size) + np.arange(n)
            s = np.repeat(s, size)
            for member in range(old_start[i], old_start[i] + old_size[i]):
                held.append((member, places, s))
                waiting += n
                if waiting >= _BATCH:
                    yield batch()
                    waiting = 0
        if held:
            yield batch()

    schema = ", ".join([*(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys), f"old_id {kind['old']}, new_id {kind['new']}, similarity double"])
    by = [*keys, "share"]
    return both.repartition(many_tasks(old.sparkSession), *by).groupBy(*by).applyInArrow(meet, schema)  # a few MB of blocks are many comparisons


def assigned_similar(old: DataFrame, new: DataFrame, keys: Sequence[str], threshold: float = 0.5, named: bool = True) -> DataFrame:
    """assigned() of similar_pairs(), from classes and their members: pairs of copies are never made.

    A task holds the blocks of a group and the pairs of its classes, which it finds itself: 12 bytes each, and none is
    shuffled. Ids are unique within a side's keys.
    """
    limit = min(max(threshold, 0.0), 1.0) if threshold == threshold else 1.0
    sides = (_members(_classed(side, keys), keys).select(*keys, "kind", "name", "body", F.col("ids").alias(f"{s}_ids")) for s, side in (("old", old), ("new", new)))
    both = next(sides).unionByName(next(sides), allowMissingColumns=True)
    kind = {s: both.schema[f"{s}_ids"].dataType.elementType.simpleString() for s in ("old", "new")}
    names = [*keys, "old_id", "new_id", "similarity"]

    def solve(t: pa.Table) -> pa.Table:
        blocks, ids, classes = [], [], []
        for s in ("old", "new"):
            mine = t.filter(pc.is_valid(t.column(f"{s}_ids")))
            rows = list(zip(*(mine.column(c).to_pylist() for c in ("kind", "name", "body"))))
            members = sorted((i, k) for k, of in enumerate(mine.column(f"{s}_ids").to_pylist()) for i in of)
            place = {c: i for i, c in enumerate(dict.fromkeys(rows[k] for _, k in members))}
            blocks.append(list(place))
            ids.append([i for i, _ in members])
            classes.append([place[rows[k]] for _, k in members])
        near = {i: (at.astype(np.int32), s) for i, at, s in similar_rows(*blocks, limit, named)} if all(blocks) else {}
        best = best_of_classes(near, *classes)
        own = t.select(list(keys)).take(pa.array([0] * len(best), pa.int64()))
        made = [pa.array([ids[0][i] for i, _, _ in best], t.schema.field("old_ids").type.value_type), pa.array([ids[1][j] for _, j, _ in best], t.schema.field("new_ids").type.value_type), pa.array([s for *_, s in best], pa.float64())]
        return pa.Table.from_arrays([*(own.column(k) for k in keys), *made], names=names)

    schema = ", ".join([*(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys), f"old_id {kind['old']}, new_id {kind['new']}, similarity double"])
    return both.repartition(many_tasks(old.sparkSession), *keys).groupBy(*keys).applyInArrow(solve, schema)


def assigned(edges: DataFrame, keys: Sequence[str], row: str, column: str, similarity: str = "similarity") -> DataFrame:
    """The edges of the one-to-one assignment with the largest total within the keys; among equal totals lower rows and columns first.

    edges: each pair once, with rows and columns that can be put in order (ids or places).
    """
    names = [*keys, row, column, similarity]

    def solve(t: pa.Table) -> pa.Table:
        places = [{v: i for i, v in enumerate(sorted(set(t.column(c).to_pylist())))} for c in (row, column)]
        at = {(places[0][i], places[1][j]): k for k, (i, j) in enumerate(zip(t.column(row).to_pylist(), t.column(column).to_pylist()))}
        best = best_edges((i, j, s) for (i, j), s in zip(at, t.column(similarity).to_pylist()))
        return t.take(pa.array([at[i, j] for i, j, _ in best], pa.int64()))

    slim = edges.select(*names)
    return slim.groupBy(*keys).applyInArrow(solve, slim.schema)
