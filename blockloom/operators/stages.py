"""Matching as a chain of plans: every stage takes what the earlier ones left of a table of blocks.

A stage is a set of keys within which blocks may pair, and a way to score: all pairs of a group
(equal identities, hoisted functions), or those that reach the threshold, found by the inverted
index of kernels.similar. The best one-to-one pairs of a group are chosen by assignment. The
hierarchy is walked by levels: pairs of one level are the keys under which their children meet.
What a stage found is written to the shared folder; blocks themselves are written once.

Blocks: pair_id, side, block_ix, id, kind, name, parent, start_byte, end_byte, source. Ids are
unique within a version. Rows with a null pair_id, side, block_ix or id take no part; null names,
parents and sources count as empty, a null kind as unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import kinds
from ..functions import columns as C
from ..functions.similarity import comparison_text
from ..kernels.assignment import best_edges
from ..kernels.matching import FEW, clamp
from ..kernels.similar import SimilarIndex, reaches
from .documents import documents_of, per_document
from .relational import DOC, forest
from .scratch import Scratch
from .similar import assigned_similar
from .spans import equal_comment_pairs

#: Blocks of a group from which it is looked through in shares.
SHARE = 2048
_IX = ["pair_id", "old_ix", "new_ix"]


def _met(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join whose sides grow with the corpus, by sorting: ten MB of packed pairs that Spark would broadcast are many times that in the driver, and every stage joins anew."""
    return a.hint("merge").join(b.hint("merge"), list(on), how)


def _streamed(blocks: DataFrame, keys: Sequence[str], edges: Callable[[list, list], list[tuple[int, int, float]]]) -> DataFrame:
    """(keys, old_ix, new_ix, similarity): the best of the edges that `edges` gives for the old and new blocks (kind, folded name, body) of equal keys.

    Groups are read as a stream, several at a time, after one shuffle.
    """
    names = [*keys, "old_ix", "new_ix", "similarity"]
    slim = blocks.select(*keys, "side", F.col("block_ix").cast("int").alias("block_ix"), F.struct("kind", F.encode(C.folded_name("name"), "utf-8").alias("folded"), F.encode("body", "utf-8").alias("body")).alias("block"))

    def choose(table: pa.Table) -> pa.RecordBatch:
        at: list[int] = []
        found: list[tuple] = []
        sides, ix, block = (table.column(c).to_pylist() for c in ("side", "block_ix", "block"))
        for lo, hi in documents_of(table, keys):
            old, new = (sorted((i for i in range(lo, hi) if sides[i] == s), key=ix.__getitem__) for s in ("old", "new"))
            if old and new:
                best = best_edges(edges(*([tuple(block[i].values()) for i in side] for side in (old, new))))
                at += [lo] * len(best)
                found += [(ix[old[i]], ix[new[j]], s) for i, j, s in best]
        own = table.select(list(keys)).take(pa.array(at, pa.int64()))
        columns = zip(*found) if found else [[]] * 3
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*(own.column(c).combine_chunks() for c in keys), *made], names=names)

    types = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keys)
    return per_document(slim, keys, choose, f"{types}, old_ix int, new_ix int, similarity double")


def best_of_all(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, old_ix, new_ix, similarity): the one-to-one pairs of equal keys with the largest total, whatever their similarity.

    blocks: keys, side, block_ix, kind, name, body. For blocks of one identity, of which most
    groups have one a side; a group with m and n blocks takes up to m times n comparisons, equal ones once.
    """

    def every(old: list, new: list) -> list[tuple[int, int, float]]:
        known: dict[tuple, float | None] = {}
        out = []
        for i, a in enumerate(old):
            for j, b in enumerate(new):
                if (a, b) not in known:
                    known[a, b] = reaches(a, b, 0.0)
                if (s := known[a, b]) is not None:
                    out.append((i, j, s))
        return out

    return _streamed(blocks, keys, every)


def best_similar(blocks: DataFrame, keys: Sequence[str], threshold: float = 0.5, named: bool = True) -> DataFrame:
    """(keys, old_ix, new_ix, similarity): the one-to-one pairs with the largest total among those of equal keys at the threshold.

    Groups with blocks on both sides only; those of more than SHARE blocks are looked through in
    shares (operators.similar), the others as a stream.
    """
    limit = clamp(threshold)

    def near(old: list, new: list) -> list[tuple[int, int, float]]:
        if len(old) * len(new) <= FEW:
            return [(i, j, s) for i, a in enumerate(old) for j, b in enumerate(new) if (s := reaches(a, b, limit, named)) is not None]
        index = SimilarIndex(new, limit, named)
        return [(i, j, s) for i, a in enumerate(old) for j, s in index.near(*a)]

    slim = blocks.select(*keys, "side", "block_ix", "kind", "name", "body")
    whole = W.partitionBy(*keys)
    sized = slim.dropna(subset=list(keys)).withColumns({"__n": F.count("*").over(whole), "__both": F.min("side").over(whole) < F.max("side").over(whole)}).filter("__both").drop("__both")
    large = sized.filter(F.col("__n") > SHARE).withColumnRenamed("block_ix", "id").drop("__n")
    found = assigned_similar(large.filter("side = 'old'"), large.filter("side = 'new'"), keys, limit, named)
    dealt = found.withColumnsRenamed({"old_id": "old_ix", "new_id": "new_ix"})
    return _streamed(sized.filter(F.col("__n") <= SHARE), keys, near).unionByName(dealt)


def nodes(blocks: DataFrame) -> DataFrame:
    """What stages ask about blocks: pair_id, side, block_ix, id, kind, name, body, scope_path, is_root, parent_ix, container_ix."""
    able = blocks.dropna(subset=[*DOC, "block_ix", "id"]).fillna("", ["name", "parent", "source"]).fillna("unknown", ["kind"])
    shaped = able.select(*DOC, F.col("block_ix").cast("int").alias("block_ix"), "id", "kind", "name", "parent", comparison_text("kind", "source").alias("body"))
    made = forest(shaped, "block_ix", "kind", "name", "parent", "body", places="block_ix").drop("scope", "container")
    ids = shaped.select(*DOC, F.col("id").alias("parent"), F.col("block_ix").alias("parent_ix"))
    return _met(made, ids, [*DOC, "parent"], "left").select(*DOC, "block_ix", "id", "kind", "name", "body", "scope_path", "is_root", "parent_ix", "container_ix")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _used(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, block_ix) of the blocks that pairs hold."""
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_ix").alias("block_ix")) for s in ("old", "new"))))
    return pairs.select("pair_id", ends.alias("e")).select("pair_id", "e.*")


class _Run:
    """The pairs found so far and the blocks they leave."""

    def __init__(self, scratch: Scratch, blocks: DataFrame, threshold: float) -> None:
        self.scratch, self.threshold = scratch, threshold
        self.all = scratch.keep(nodes(blocks), "nodes")
        self.found: list[DataFrame] = []

    def rest(self) -> DataFrame:
        return _met(self.all, _used(_union(self.found)), [*DOC, "block_ix"], "left_anti") if self.found else self.all

    def add(self, pairs: DataFrame, stage: str, match_type: str = "similarity") -> DataFrame:
        """Write the pairs (pair_id, old_ix, new_ix, similarity) of a stage and count their blocks as used."""
        kept = self.scratch.keep(pairs.select(*_IX, F.col("similarity").alias("confidence"), F.lit(stage).alias("stage"), F.lit(match_type).alias("match_type")), f"stage-{stage}")
        self.found.append(kept)
        return kept

    def below(self, pairs: DataFrame, stage: str) -> None:
        """Children of paired parents, level after level: as many rounds as the pairs found are deep."""
        children = self.scratch.keep(self.rest().filter("kind <> 'comment' AND parent_ix IS NOT NULL").drop("scope_path", "is_root", "container_ix"), "children")
        front = pairs
        while True:
            under = _union([front.select("pair_id", F.lit(s).alias("side"), F.col(f"{s}_ix").alias("parent_ix"), F.col("old_ix").alias("under")) for s in ("old", "new")])
            met = _met(children, under, [*DOC, "parent_ix"])
            front = self.add(best_similar(met, ["pair_id", "under"], self.threshold), stage)
            if front.isEmpty():
                self.found.pop()
                self.scratch.drop("children")
                return


def staged_pairs(blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pair_id, stage, old_ix, new_ix, confidence, match_type): the pairs of all stages, then added and removed blocks.

    The rows are those of plans.review.match_blocks, which keeps a whole version in one task; here
    a large version's groups are shared out. In turn: equal kind, name and scope path; comments of
    equal text; similar roots; children of pairs; similar blocks of equal scope path; named
    functions whose containers found no partner, and their children; similar comments.
    """
    with Scratch(blocks.sparkSession) as scratch:
        run = _Run(scratch, blocks, threshold)
        run.add(best_of_all(run.all.filter("name <> ''"), ["pair_id", "kind", "name", "scope_path"]), "1", "exact_name")

        gone = _met(_used(run.found[0]), run.all.filter("kind = 'comment'"), [*DOC, "block_ix"], "left_semi")
        able = blocks.dropna(subset=[*DOC, "block_ix", "id"]).fillna("", ["name", "source"])
        equal = equal_comment_pairs(_met(able, gone, [*DOC, "block_ix"], "left_anti"))
        for s in ("old", "new"):
            ids = run.all.filter((F.col("kind") == "comment") & (F.col("side") == s)).select("pair_id", F.col("id").alias(f"{s}_id"), F.col("block_ix").alias(f"{s}_ix"))
            equal = _met(equal, ids, ["pair_id", f"{s}_id"])
        run.add(equal.withColumn("similarity", F.lit(1.0)), "2")

        run.add(best_similar(run.rest().filter("kind <> 'comment' AND is_root"), ["pair_id"], threshold), "3a")
        run.below(_union(run.found), "3b")
        run.add(best_similar(run.rest().filter("kind <> 'comment'"), ["pair_id", "scope_path"], threshold), "3c")

        rest = run.rest()
        single = rest.select(*DOC, F.col("block_ix").alias("container_ix"))
        hoistable = rest.filter((F.col("name") != "") & C.in_set("kind", kinds.HOISTABLE))
        hoistable = _met(hoistable, single, [*DOC, "container_ix"], "left_semi")
        run.below(run.add(best_of_all(hoistable, ["pair_id", "name"]), "3d", "exact_name"), "3d")
        run.add(best_similar(run.rest().filter("kind = 'comment'"), ["pair_id"], threshold, False), "4")

        alone = run.rest()
        ix = [F.when(F.col("side") == s, F.col("block_ix")).alias(f"{s}_ix") for s in ("old", "new")]
        stage = F.when(F.col("side") == "old", "removed").otherwise("added").alias("stage")
        singles = alone.select("pair_id", *ix, F.lit(0.0).alias("confidence"), stage, F.lit("no_match").alias("match_type"))
        every = _union([*run.found, singles])
        return scratch.result(every.select("pair_id", "stage", "old_ix", "new_ix", "confidence", "match_type"), "staged")
