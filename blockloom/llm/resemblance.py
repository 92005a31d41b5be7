"""Near copies by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates. Operator 6 comes first: fingerprints (simhash.py) are linked by pigeonring within its
radius, and what it links is tested here by the whole sets. That finds the closest copies only, so
the others are sought further: each distinct shingle set gets ROWS * BANDS minimum hashes, hashed
together in BANDS bands. Two sets of similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS, which is 0.99995 at 0.8 and more above. A candidate is dropped if the set
sizes rule 0.8 out (exact) or fewer than AGREE of its minima agree (4.5 standard deviations under
what 0.8 gives). What is left is settled by the whole shingle sets, so no link is wrong.

Large groups. Pairs are only drawn across components, which loses nothing. First every bucket, and
then its parts by each of the next SPLITS bands, compares one member of each component that it
holds with one of the commonest there: no more pairs than rows, and each time components are taken
again. Of the buckets that hold two components even then, those of up to BUCKET give all pairs. The
members of larger ones are settled by prefix filtering, which loses no pair of them: shingles are
ordered, first those that only one component holds (which make no pair, and are only counted), then
by how many of these texts hold them, and two sets that are similar share one of the first fifth
(and one more) of each. The place of the first that they share bounds their similarity before a
pair is made. Some of these pairs of each two components are tested first, the others only while
their components are apart.

Scratch tables go as soon as what reads them is written, and the files of shuffles with each write.

Defined results: words are cut and lower-cased as in simhash.py; texts of up to five words are one
shingle, null and blank texts are equal; texts are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import cleaning, dealt_join, free_name, latest, map_batches, mark, materialize, scrap, tidy, with_row_id
from .components import components

SHINGLE = 5
SEED = 42
ROWS, BANDS = 5, 25
#: Least number of agreeing minima of a candidate that is compared whole.
AGREE = 80
#: Members of a bucket up to which all its pairs are candidates.
BUCKET = 64
#: Further bands by which buckets are cut.
SPLITS = 4
#: Pairs of each two components that are tested before the others.
DRAWN = (4, 64)
#: Rows of a shared shingle that meet in one part.
SHARE = 1024
#: Shingles whose minima are taken at once.
BLOCK = 1 << 14
_random = np.random.default_rng(7)
_TIMES = (_random.integers(0, 1 << 31, (ROWS * BANDS, 1)) * 2 + 1).astype(np.uint32)
_PLUS = _random.integers(0, 1 << 32, (ROWS * BANDS, 1)).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a whole text."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size)[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin, end)), dtype=np.uint64, count=len(end)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of ROWS * BANDS permutations of 32-bit hashes."""
    h = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(ROWS * BANDS, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(h), BLOCK):
        np.minimum(out, (h[at : at + BLOCK] * _TIMES + _PLUS).min(axis=1), out=out)
    return out


def similar(a: bytes, b: bytes) -> bool:
    """Whether two packed shingle sets have a Jaccard similarity of 0.8 or more."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _signatures(b: pa.RecordBatch) -> pa.RecordBatch:
    digests, sizes, low, bands, prints = [], [], [], [], []
    for text in b.column("text").to_pylist():
        h = shingles(text)
        m = minima(h)
        raw = m.tobytes()
        digests.append(xxhash.xxh3_128_digest(h.tobytes()))
        sizes.append(len(h))
        low.append((m & 255).astype(np.uint8).tobytes())
        bands.append(np.array([xxhash.xxh64_intdigest(raw[4 * ROWS * i : 4 * ROWS * (i + 1)], i) for i in range(BANDS)], dtype=np.uint64).view(np.int64))
        prints.append(simhash.fingerprint(text))
    cols = [b.column("row"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(low, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["row", "digest", "size", "low", "bands", "fp"])


def _sets(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("row"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["row", "held"])


def _lists(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("row"), pa.array([shingles(t).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["row", "shingles"])


def _filtered(test):
    """The x and y of the rows of a batch whose columns a and b pass a test."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        good = pa.array([test(p, q) for p, q in zip(b.column("a").to_pylist(), b.column("b").to_pylist())], pa.bool_())
        return b.select(["x", "y"]).filter(good)

    return run


def _agree(a: bytes, b: bytes) -> bool:
    return int((np.frombuffer(a, dtype=np.uint8) == np.frombuffer(b, dtype=np.uint8)).sum()) >= AGREE


def _links(pairs: DataFrame, heads: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (x, y) that are similar by their whole sets. What it takes to find them is deleted."""
    since = mark()
    side = lambda df, at, name, *more: df.select(F.col("row").alias(at), F.col(name[0]).alias(name[1]), *more)
    both = pairs.join(side(heads, "x", ("low", "a"), F.col("size").alias("m")), "x").join(side(heads, "y", ("low", "b"), F.col("size").alias("n")), "y")
    both = both.filter(5 * F.least("m", "n") >= 4 * F.greatest("m", "n")).select("x", "y", "a", "b")
    likely = materialize(map_batches(both, _filtered(_agree), "x bigint, y bigint"), "likely")
    met = likely.select(F.col("x").alias("row")).union(likely.select("y")).distinct()
    held = materialize(map_batches(_texts(rows, met), _sets, "row bigint, held binary"), "shingles")
    whole = likely.join(side(held, "x", ("held", "a")), "x").join(side(held, "y", ("held", "b")), "y").select("x", "y", "a", "b")
    found = materialize(map_batches(whole, _filtered(similar), "x bigint, y bigint"), "similar")
    tidy(since)
    return found


def _by_fingerprints(heads: DataFrame) -> DataFrame:
    """Pairs (x, y) of rows whose fingerprints operator 6 links: the first rows of two that differ, the first and each other row of one.

    They are written, for the scratch tables that they come from don't outlast this.
    """
    since = mark()
    first = materialize(heads.groupBy("fp").agg(F.min("row").alias("least")), "fingerprints")
    near = simhash.links(first.select("fp")).withColumnsRenamed({"x": "u", "y": "v"})
    side = lambda at, fp: first.select(F.col("fp").alias(fp), F.col("least").alias(at))
    apart = near.join(side("a", "u"), "u").join(side("b", "v"), "v").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    equal = heads.join(first, "fp").filter("row <> least").select(F.col("least").alias("x"), F.col("row").alias("y"))
    pairs = materialize(apart.union(equal).distinct(), "near-prints")
    tidy(since)
    return pairs


class Joined:
    """What is linked so far, as a written table of (x, y): each vertex x and the root y of its component.

    add() takes further links in. Components start from these stars and the new links, so that earlier links are never
    gone through again; the table before and the scratch tables since a mark are deleted.
    """

    def __init__(self):
        self.links = self.path = None

    def add(self, links: DataFrame, since: int) -> None:
        before = self.path
        links = links if before is None else self.links.union(links)
        self.links = materialize(components(links, "x", "y").select(F.col("vertex").alias("x"), F.col("root").alias("y")), "roots")
        self.path = latest()
        tidy(since)
        if before:
            scrap(before)

    def root(self, row: str, name: str) -> DataFrame:
        """(row, name): the root of each vertex; vertices without a link are absent."""
        return self.links.select(F.col("x").alias(row), F.col("y").alias(name))


def _rooted(keys: DataFrame, joined: Joined) -> DataFrame:
    """Rows of (row, band, val), with the root of each by the links so far, whose val is met in two roots or more."""
    since = mark()
    rooted = keys.select("row", "band", "val").join(joined.root("row", "root"), "row", "left").select("row", "band", "val", F.coalesce("root", "row").alias("root"))
    mixed = _mixed(materialize(rooted, "rooted"))
    tidy(since)
    return mixed


def _mixed(keys: DataFrame) -> DataFrame:
    """Rows of (row, band, val, root) whose val is met in two roots or more, with how many rows it has."""
    several = keys.groupBy("val").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return materialize(dealt_join(keys, materialize(several.select("val", "n"), "several"), ["val"], "n", ["row"]), "mixed")


def _cut(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """keys with each val cut by each of the next SPLITS bands."""
    cuts = F.array(*(F.xxhash64("val", F.element_at("bands", F.pmod(F.col("band") + i, F.lit(BANDS)) + 1)) for i in range(1, SPLITS + 1)))
    return keys.join(heads.select("row", "bands"), "row").select("row", "root", F.explode(cuts).alias("val"))


def _met_once(keys: DataFrame) -> DataFrame:
    """Pairs (x, y): of each val, one row of the root with most rows there, with one row of each other root."""
    one = materialize(keys.groupBy("val", "root").agg(F.count("*").alias("n"), F.min_by("row", F.xxhash64("row", "val")).alias("one")), "one-of-each")
    most = materialize(one.groupBy("val").agg(F.max_by("one", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")), "commonest")
    met = dealt_join(one, most, ["val"], "roots", ["root"]).filter("one <> most")
    return met.select(F.least("one", "most").alias("x"), F.greatest("one", "most").alias("y")).distinct()


def _settled(pairs: DataFrame, joined: Joined, heads: DataFrame, rows: DataFrame) -> None:
    """Add to joined enough of the similar pairs (the scratch table written last) to connect all that they connect: what is in one component is not tested."""
    done = [latest()]  # tables of the round before
    for most in (*DRAWN, None):
        since = mark()
        for c in "xy":
            pairs = pairs.join(joined.root(c, f"r{c}"), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
        pairs = materialize(pairs.filter("rx <> ry"), "apart")
        tidy(since)
        for path in done:
            scrap(path)
        done = [latest()]
        if pairs.isEmpty():
            break
        drawn = pairs.select("x", "y")
        if most:
            h = F.xxhash64("x", "y")
            drawn = pairs.groupBy(F.least("rx", "ry"), F.greatest("rx", "ry"), F.pmod(h, F.lit(most))).agg(F.min_by(F.struct("x", "y"), h).alias("p")).select("p.x", "p.y")
            drawn = materialize(drawn, "drawn")
            done.append(latest())
        since = mark()
        joined.add(_links(drawn, heads, rows), since)
        pairs = pairs.select("x", "y").join(drawn, ["x", "y"], "left_anti")
    scrap(done[0])


def _first_met(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of a val in different roots whose sizes allow it, each from the first band that the two share.

    Where that band's bucket is large, its members are compared by what holds for large ones.
    """
    keys = keys.join(heads.select("row", "size", "bands"), "row").select("val", "band", "row", "root", "size", "bands")
    x, y = (keys.select("val", F.col("band").alias(f"band_{c}"), F.col("row").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("root", "size", "bands"))) for c in "xy")
    sizes = "5 * least(size_x, size_y) >= 4 * greatest(size_x, size_y)"
    first = "array_position(zip_with(bands_x, bands_y, (a, b) -> a = b), true) = band_x + 1"
    return x.join(y, "val").filter(f"x < y AND root_x <> root_y AND {sizes} AND {first}").select("x", "y")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose number is wanted. The numbers are written first, so that their size decides how they are joined."""
    return rows.join(materialize(wanted, "wanted"), "row", "left_semi")


def _rarest(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (x, y) of the rows in keys (row, root), in different roots, that can be similar by their rarest shingles.

    Both sides of a shingle of f rows are dealt in about f / SHARE parts.
    """
    held = map_batches(_texts(rows, keys.select("row").distinct()), _lists, "row bigint, shingles array<bigint>")
    at = held.join(keys.distinct(), "row").select("row", "root", F.size("shingles").alias("m"), F.explode("shingles").alias("s"))
    at = materialize(at, "left-shingles")
    met = at.groupBy("s").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    met = dealt_join(at, materialize(met.select("s", "f"), "met-shingles"), ["s"], "f", ["row"])
    alone = F.col("m") - F.count("*").over(Window.partitionBy("row"))  # shingles of one root, which come first in the order
    rare = met.withColumn("place", alone + F.row_number().over(Window.partitionBy("row").orderBy("f", "s")))
    rare = rare.filter("place <= m - floor((4 * m + 4) / 5) + 1")
    shares = F.ceil(F.col("f") / SHARE).cast("int")
    x, y = (rare.select("s", F.col("row").alias(c), F.col("root").alias(f"r{c}"), F.col("m").alias(f"m{c}"), F.col("place").alias(f"p{c}"), shares.alias("shares")) for c in "xy")
    x = x.withColumn("share", F.pmod(F.xxhash64("x"), F.col("shares")).cast("int")).drop("shares")
    y = y.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    can = F.expr("x < y AND rx <> ry AND 9 * (1 + least(mx - px, my - py)) >= 4 * (mx + my)")  # by the first that two sets share, no more than it and what follows
    return x.join(y, ["s", "share"]).filter(can).select("x", "y")


def near_groups(rows: DataFrame) -> DataFrame:
    """(row, root) of every row of (row bigint, text): root is the smallest row that can be reached by similar texts."""
    signed = materialize(map_batches(rows.select("row", "text"), _signatures, "row bigint, digest binary, size bigint, low binary, bands array<bigint>, fp bigint"), "signatures")
    signed_at = latest()
    same = materialize(signed.select("row", "digest").join(signed.groupBy("digest").agg(F.min("row").alias("vertex")), "digest").select("row", "vertex"), "same-sets")
    heads = signed.join(same.filter("row = vertex").select("row"), "row", "left_semi")
    heads = materialize(heads.drop("digest"), "heads")
    scrap(signed_at)
    near, joined = _by_fingerprints(heads), Joined()
    joined.add(_links(near, heads, rows), mark())

    since = mark()
    keys = heads.select("row", F.posexplode("bands").alias("band", "val"))
    keys = keys.join(keys.groupBy("val").agg(F.count("*").alias("n")).filter("n > 1").select("val"), "val")
    keys = _rooted(materialize(keys, "buckets"), joined)
    tidy(since)
    for cut in (False, True)[: 1 + bool(SPLITS)]:
        keys_at, since = latest(), mark()
        joined.add(_links(_met_once(_cut(keys, heads) if cut else keys), heads, rows), since)
        keys = _rooted(keys, joined)
        scrap(keys_at)

    keys_at, since = latest(), mark()
    joined.add(_links(_first_met(keys.filter(F.col("n") <= BUCKET), heads), heads, rows), since)
    left = _rooted(keys.filter(F.col("n") > BUCKET), joined)
    scrap(keys_at)
    if not left.isEmpty():
        since = mark()
        pairs = materialize(_rarest(left.select("row", "root"), rows).distinct(), "pairs")
        tidy(since)
        _settled(pairs, joined, heads, rows)
    return same.join(joined.root("vertex", "root"), "vertex", "left").select("row", F.coalesce("root", "vertex").alias("root"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest doc_id; all columns are kept."""
    row = free_name(docs, "__row")
    numbered = with_row_id(docs, "numbered", row)
    named = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    with cleaning(docs.sparkSession):
        since = mark()
        found = materialize(near_groups(numbered.select(F.col(row).alias("row"), "text")).join(named, "row"), "near-groups")
        tidy(since)
        kept = found.groupBy("root").agg(F.min(F.struct("id", "row")).alias("least")).select(F.col("least.row").alias("row"))
        gone = materialize(found.join(kept, "row", "left_anti").select(F.col("row").alias(row)), "near-copies")
        tidy(since)
    return numbered.join(gone, row, "left_anti").drop(row)
