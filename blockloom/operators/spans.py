"""Joins of places with the spans around them: one shuffle, one sweep per document.

The smallest span around a place is found by kernels.spans within whole documents. Whether any
span holds a place needs no Python: of the spans that start no later, the one that ends last
decides, a running maximum.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import kinds
from ..kernels.comments import equal_comments
from ..kernels.spans import smallest_around
from .documents import documents_of, per_document

#: Names of the blocks around a block that enclosing() can find.
OWNER, SCOPE, ELEMENT, FUNCTION = "owner", "scope_owner", "element_owner", "function"


def _around(rows: dict[str, list], of: str) -> list[int | None]:
    """Per block of one document the block around it in one of the four senses, where it has that sense."""
    kind, start, end = rows["kind"], rows["start_byte"], rows["end_byte"]
    every = range(len(kind))
    if of == ELEMENT:
        asked = [i for i in every if kind[i] in kinds.ELEMENT and not rows["parent"][i] and start[i] < end[i]]
        held, reach, own = every, end, True
    else:
        asked = [i for i in every if kind[i] == "comment" and (of != OWNER or start[i] < end[i])]
        held = [i for i in every if (kind[i] in kinds.FUNCTION_LIKE if of == FUNCTION else kind[i] != "comment")]
        reach, own = (end if of == FUNCTION else [s + 1 for s in start]), False
    tie = rows["block_ix"] if of == SCOPE else rows["id"]
    spans = [(start[i], end[i], tie[i]) for i in held]
    places = [(start[i], reach[i], i if own else None) for i in asked]
    out: list[int | None] = [None] * len(kind)
    for i, found in zip(asked, smallest_around(spans, places, of == FUNCTION)):
        out[i] = None if found is None else held[found]
    return out


def enclosing(blocks: DataFrame, *of: str) -> DataFrame:
    """(pair_id, side, id, and a column for each of `of`): ids of the blocks around comments and elements, null where none is.

    owner: smallest block around a comment's first byte, the lower id among equals. scope_owner:
    the same, the first extracted among equals. element_owner: smallest other block that holds all
    of an element without a parent. function: smallest function around all of a comment, other
    than of the very same span.
    """
    keys = ["pair_id", "side"]
    slim = blocks.select(*keys, "id", "kind", "parent", "block_ix", *(F.col(c).cast("long").alias(c) for c in ("start_byte", "end_byte")))

    def sweep(table: pa.Table) -> pa.RecordBatch:
        found: dict[str, list] = {c: [] for c in of}
        columns = {c: table.column(c).to_pylist() for c in table.column_names if c not in keys}
        for lo, hi in documents_of(table, keys):
            rows = {c: v[lo:hi] for c, v in columns.items()}
            for c in of:
                found[c] += [None if i is None else rows["id"][i] for i in _around(rows, c)]
        own = [table.column(c).combine_chunks() for c in (*keys, "id")]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(found[c], pa.string()) for c in of)], names=[*keys, "id", *of])

    own = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in (*keys, "id"))
    return per_document(slim, keys, sweep, ", ".join([own, *(f"{c} string" for c in of)]))


def homes_differ(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, old_id, new_id, moved) of matched comments: whether the smallest matched block around differs between sides.

    Blocks and pairs of both sides meet once, by pair_id.
    """
    none = F.lit(None)
    b = blocks.select("pair_id", F.lit(0).alias("is_pair"), "side", "id", none.cast("string").alias("new_id"), (F.col("kind") == "comment").alias("comment"), *(F.col(c).cast("long").alias(c) for c in ("start_byte", "end_byte")))
    p = pairs.select("pair_id", F.lit(1).alias("is_pair"), none.cast("string").alias("side"), F.col("old_id").alias("id"), "new_id", none.cast("boolean").alias("comment"), none.cast("long").alias("start_byte"), none.cast("long").alias("end_byte"))

    def sweep(table: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        columns = [table.column(c).to_pylist() for c in table.column_names]
        for lo, hi in documents_of(table, ["pair_id"]):
            at: dict[tuple, tuple] = {}
            matched = []
            for pair_id, is_pair, side, block, new, comment, start, end in zip(*(c[lo:hi] for c in columns)):
                if is_pair:
                    matched.append((block, new))
                else:
                    at[side, block] = comment, start, end
            comments = [m for m in matched if ("old", m[0]) in at and at["old", m[0]][0] and ("new", m[1]) in at]
            homes = []
            for k, side in enumerate(("old", "new")):
                code = [(m, at[side, m[k]]) for m in matched if (side, m[k]) in at and not at[side, m[k]][0]]
                spans = [(s, e, f"{m[0]}|{m[1]}") for m, (_, s, e) in code]
                places = [(at[side, m[k]][1], at[side, m[k]][1] + 1, None) for m in comments]
                homes.append([None if f is None else spans[f][2] for f in smallest_around(spans, places)])
            out += [(pair_id, *m, a != z) for m, a, z in zip(comments, *homes)]
        types = (table.schema.field("pair_id").type, pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names=["pair_id", "old_id", "new_id", "moved"])

    kind = blocks.schema["pair_id"].dataType.simpleString()
    return per_document(b.unionByName(p), ["pair_id"], sweep, f"pair_id {kind}, old_id string, new_id string, moved boolean")


def equal_comment_pairs(blocks: DataFrame) -> DataFrame:
    """(pair_id, old_id, new_id) of comments of equal text, each used once: first within blocks of one kind and name, then anywhere.

    Old comments choose in their order, the nearest by order among comments; both versions meet
    once, by pair_id. Texts of blocks other than comments aren't shuffled.
    """
    slim = blocks.select("pair_id", "side", "block_ix", "id", "kind", "name", *(F.col(c).cast("long").alias(c) for c in ("start_byte", "end_byte")), F.when(F.col("kind") == "comment", F.col("source")).alias("text"))
    names = ["pair_id", "old_id", "new_id"]

    def choose(table: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        for lo, hi in documents_of(table, ["pair_id"]):
            sides = []
            for side in ("old", "new"):
                at = sorted((i for i in range(lo, hi) if columns["side"][i] == side), key=columns["block_ix"].__getitem__)
                rows = {c: [v[i] for i in at] for c, v in columns.items()}
                around = _around(rows, SCOPE)
                where = lambda i: None if i is None else (rows["kind"][i], rows["name"][i])  # noqa: B023, E731
                comments = [i for i, k in enumerate(rows["kind"]) if k == "comment"]
                sides.append([(n, rows["text"][i], where(around[i]), rows["id"][i]) for n, i in enumerate(comments)])
            out += [(columns["pair_id"][lo], sides[0][i][3], sides[1][j][3]) for i, j in equal_comments(*([c[:3] for c in s] for s in sides))]
        types = (table.schema.field("pair_id").type, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, types)], names=names)

    return per_document(slim, ["pair_id"], choose, f"pair_id {blocks.schema['pair_id'].dataType.simpleString()}, old_id string, new_id string")


def held(places: DataFrame, spans: DataFrame, keys: Sequence[str], lo: str, hi: str, start: str, end: str) -> DataFrame:
    """Rows of places whose [lo, hi) lies inside one of the spans [start, end) of its keys."""
    fields = F.struct(*(F.col(c) for c in places.columns))
    a = spans.filter(F.col(start) < F.col(end)).select(*keys, F.col(start).cast("long").alias("__at"), F.lit(0).alias("__last"), F.col(end).cast("long").alias("__end"), F.lit(None).cast(places.select(fields.alias("f")).schema["f"].dataType).alias("__row"))
    b = places.select(*keys, F.col(lo).cast("long").alias("__at"), F.lit(1).alias("__last"), F.lit(None).cast("long").alias("__end"), fields.alias("__row"))
    furthest = F.max("__end").over(W.partitionBy(*keys).orderBy("__at", "__last").rowsBetween(W.unboundedPreceding, 0))
    met = a.unionByName(b).withColumn("__furthest", furthest).filter("__last = 1")
    return met.filter(F.col(f"__row.{hi}") <= F.col("__furthest")).select("__row.*")


def held_among(rows: DataFrame, by: Sequence[str], place: tuple[Column, Sequence[Column], Column, Column], span: tuple[Column, Sequence[Column], Column, Column]) -> DataFrame:
    """The rows whose place lies inside the span of one of the rows.

    place: whether a row has one, its keys besides the columns `by`, lo and hi; span: the same with start and end. Both
    are made from one reading of the rows, where held() reads two tables.
    """
    none = F.lit(None).cast("long")
    at = lambda what, last, reach, end: F.when(what[0], F.struct(*(k.alias(f"__k{i}") for i, k in enumerate(what[1])), what[2].cast("long").alias("__at"), F.lit(last).alias("__last"), reach.alias("__reach"), end.alias("__end")))
    ask = at(place, 1, place[3].cast("long"), none)
    give = at((span[0] & (span[2] < span[3]), *span[1:]), 0, none, span[3].cast("long"))
    events = rows.select("*", F.explode(F.array(give, ask)).alias("__e")).filter("__e IS NOT NULL").select(*rows.columns, "__e.*")
    order = W.partitionBy(*by, *(f"__k{i}" for i in range(len(place[1])))).orderBy("__at", "__last").rowsBetween(W.unboundedPreceding, 0)
    met = events.withColumn("__furthest", F.max("__end").over(order)).filter("__last = 1 AND __reach <= __furthest")
    return met.select(*rows.columns)
