"""SimHash near-duplicates, with pigeonring filtering of candidate pairs.

Fingerprints: 64 bits over the 3-word shingles of the lower-cased text (a bit is set if it is
set in over half of the shingles' hashes). Links join fingerprints that differ in at most
RADIUS bits; equal fingerprints are one vertex from the start, so copies cost nothing.

Candidates by the pigeonring principle: the bits form a ring of m = PARTS segments. If two
fingerprints differ in at most r bits, there is a segment from which every chain of l
consecutive segments has at most l * r / m differences. So the first KEY segments from there
(those with l * r < m) have none: they are the join key, 28 of the 64 bits, so that even 10^10
fingerprints leave buckets of some dozens. A pair of a bucket is a candidate only if its longer
chains stay within their budgets too; only then is the whole distance taken.

A bucket of more than BUCKET fingerprints is split by the same principle: the bits outside its
key form a ring of PARTS segments of their own, and pairs are drawn from (key, second key).
Only what still shares 44 bits with more than BUCKET others, a dense group of near copies, is
linked without pairs, and exactly: each member emits itself and its one-bit changes outside the
keys; two members differ in at most 2 bits exactly if they share one of these (for 2 bits, the
point halfway), and all that share one are within 2 bits of each other. The links are those of
all pairs in every case.

Defined results: null, empty and blank texts have the fingerprint zero; one or two words are
one shingle; texts are used whole; rows with the same doc_id are rows of one document id (its
fingerprints are linked through their own values only); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, free_name, map_batches, materialize, with_row_id
from .components import components

SHINGLE = 3
SEED = 42
#: Largest number of differing bits of a link; the bucket rule for large groups needs it to be 2.
RADIUS = 2
#: Segments of a ring, and how many of them, side by side, are a key: those with fewer differences than one by proportion.
PARTS = 9
KEY = -(-PARTS // RADIUS) - 1
#: Fingerprints of a bucket up to which its pairs are compared; beyond, it is split, and at last linked through one-bit changes.
BUCKET = 64
#: Hashes whose bits are unpacked at once.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: 1 - SHINGLE].tolist()
    end = end[SHINGLE - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(end), BLOCK):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(begin[at : at + BLOCK], end[at : at + BLOCK])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(end), bitorder="little").view("<i8")[0])


def with_fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """key and fp of every row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(key), pa.array([fingerprint(t) for t in b.column("text").to_pylist()], pa.int64())], names=[key, "fp"])

    return map_batches(rows.select(key, "text"), batch, f"`{key}` {rows.schema[key].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring(bits: list[int]) -> list[int]:
    """Masks of PARTS segments of a ring of bits."""
    cuts = [len(bits) * i // PARTS for i in range(PARTS + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _chain(ring: list[int], first: int, length: int) -> int:
    """Mask of consecutive segments of a ring."""
    return sum(ring[(first + k) % PARTS] for k in range(length))


_ALL = (1 << 64) - 1
_OUTER = _ring(list(range(64)))
#: For each first segment: its key; the ring of the bits outside it, in ring order; for each of those segments the longer key.
_KEYS = [_chain(_OUTER, i, KEY) for i in range(PARTS)]
_starts = [sum(m.bit_count() for m in _OUTER[: (i + KEY) % PARTS]) for i in range(PARTS)]
_INNER = [_ring([(_starts[i] + k) % 64 for k in range(64 - _KEYS[i].bit_count())]) for i in range(PARTS)]


def _budgets(diff: Column, ring_of: list[list[int]], place: Column) -> Column:
    """Whether all chains longer than the key that start at `place` (ring * PARTS + segment) stay within their budgets."""
    near = F.lit(True)
    for length in range(KEY + 1, PARTS):
        if length + 1 < PARTS and length * RADIUS // PARTS == (length + 1) * RADIUS // PARTS:
            continue  # the next longer chain has the same budget
        masks = F.array(*(F.lit(_signed(_chain(ring, i, length))) for ring in ring_of for i in range(PARTS)))
        near = near & (F.bit_count(diff.bitwiseAND(F.element_at(masks, place + 1))) <= length * RADIUS // PARTS)
    return near


def _sized(keys: DataFrame, name: str) -> DataFrame:
    """Rows of (place, val, fp) whose (place, val) has more than one, with their number n."""
    sizes = keys.groupBy("place", "val").agg(F.count("*").alias("n")).filter("n > 1")
    return materialize(keys.join(sizes, ["place", "val"]), name)


def _pairs(keys: DataFrame, test) -> DataFrame:
    """Pairs (x, y) of buckets of at most BUCKET that pass the chains' test and the whole distance."""
    small = keys.filter(F.col("n") <= BUCKET).select("place", "val", "fp")
    diff = F.col("x").bitwiseXOR(F.col("y"))
    met = small.withColumnRenamed("fp", "x").join(small.withColumnRenamed("fp", "y"), ["place", "val"]).filter("x < y")
    return met.filter(test(diff)).filter(F.bit_count(diff) <= RADIUS).select("x", "y")


def _stars(keys: DataFrame) -> DataFrame:
    """Links (x, y) of the buckets of over BUCKET, through the one-bit changes outside both keys."""
    outside = [_ALL & ~(_KEYS[i] | _chain(_INNER[i], j, KEY)) for i in range(PARTS) for j in range(PARTS)]
    flips = F.array(*(F.array(F.lit(0), *(F.lit(_signed(1 << b)) for b in range(64) if m >> b & 1)) for m in outside))
    points = keys.filter(F.col("n") > BUCKET).select("place", "fp", F.explode(F.element_at(flips, F.col("place") + 1)).alias("bit"))
    points = points.select("place", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    met = points.groupBy("place", "point").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)  # a point and its neighbours: 65 at most
    return met.select(F.array_min("near").alias("x"), F.explode("near").alias("y")).filter("x <> y")


def links(fps: DataFrame) -> DataFrame:
    """(x, y): links that connect exactly the fingerprints within RADIUS bits of each other. fps: distinct values in fp."""
    spread = lambda rows, at, masks: rows.select("fp", F.explode(F.array(*(F.struct(at(i).alias("place"), F.col("fp").bitwiseAND(m).alias("val")) for i, m in enumerate(masks)))).alias("k")).select("fp", "k.place", "k.val")
    outer = _sized(spread(fps, F.lit, [F.lit(_signed(k)) for k in _KEYS]), "segments")
    first = F.col("place")
    longer = [F.element_at(F.array(*(F.lit(_signed(_KEYS[i] | _chain(_INNER[i], j, KEY))) for i in range(PARTS))), first + 1) for j in range(PARTS)]
    inner = _sized(spread(outer.filter(F.col("n") > BUCKET), lambda j: (first * PARTS + j).cast("int"), longer), "inner-segments")
    short = _pairs(outer, lambda diff: _budgets(diff, [_OUTER], first))
    split = _pairs(inner, lambda diff: _budgets(diff, [_OUTER], F.floor(first / PARTS).cast("int")) & _budgets(diff, _INNER, first))
    return short.unionByName(split).unionByName(_stars(inner)).distinct()


def near_groups(rows: DataFrame, key: str) -> DataFrame:
    """key, fp and component_id (smallest key whose fingerprint can be reached) of every row."""
    fps = materialize(with_fingerprint(rows, key), "simhashes")
    distinct = materialize(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct-simhashes")
    roots = materialize(components(links(distinct.select("fp")), "x", "y"), "roots")
    grouped = distinct.join(roots, distinct["fp"] == roots["vertex"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(grouped.join(smallest, "root").select("fp", "n", "component_id"), "named-simhashes")
    return dealt_join(fps, by_fp, ["fp"], "n", [key]).select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return near_groups(docs.select("doc_id", "text"), "doc_id").select("doc_id", hexed, "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; all columns are kept."""
    row = free_name(docs, "__row")
    numbered = with_row_id(docs, "numbered", row)
    keyed = numbered.select(F.struct(F.col("doc_id").alias("d"), F.col(row).alias("r")).alias("key"), "text")
    kept = near_groups(keyed, "key").filter(F.col("key") == F.col("component_id")).select(F.col("key.r").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
