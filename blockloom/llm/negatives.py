"""Hard negatives by a two-dimensional block matrix product.

Scores are integer inner products of quantised vectors: floor(scale * x) of every component.
Rows are dealt into blocks of about BLOCK rows by a hash of their row number, anchors likewise,
and every block is cut into chunks of dimensions. Anchor chunk (i, k) goes to all cells
(i, j, k) of its row of the grid and row chunk (j, k) to all cells of its column, a cell
multiplies its two chunks, and the partial int64 tiles of a pair of blocks (i, j) are added
over k by one shuffle. What is left of a tile is its best few per anchor: no score table is
ever written, and no task holds more than a tile and its parts.

Two passes run over the grid. The first keeps the scores of equal labels: each anchor's
positives are its highest ones. The second keeps those of different labels, and for every
window [low_percent, 100] percent of a positive's score takes the highest in it. Scores that a
pass doesn't ask for are zeroed in its partial tiles, so together the two shuffle about as much
as one whole table would.

Products are exact: in float64 (BLAS) where no partial sum can reach 2^53, else in int64.
Quantised components up to 2^31 are accepted; a larger one fails rather than wraps, as a
score over 2^63 does.

Defined results: rows with a null label, a null vector, or a null or non-finite component take
no part; missing components of shorter vectors count as 0; rows with a null vec_id are no
anchors and come last among equal scores; repeated rows are rows of their own (an anchor never
is its own positive, but may have a copy of itself); anchors without a positive, and windows
without a row, give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Production parameters of the quantisation and the search.
SCALE, ANCHORS, POSITIVES, NEGATIVES, LOW_PERCENT = 256, 100, 5, 5, 80
#: Rows of a block on average; a tile of two blocks has 8 MB of int64 scores.
BLOCK = 1024
#: Dimensions of a chunk; more where a vector would have over MAX_CHUNKS of them, which bounds the parts of a tile that meet.
CHUNK, MAX_CHUNKS = 32, 8
#: Largest magnitude of a quantised component.
LARGEST = 1 << 31
_NONE = np.iinfo(np.int64).min
_BLOCK_ROW = "b long, k int, ids binary, known binary, rows binary, labels binary, m binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, q): rows that take part, with a row number and their integer components; written to the shared folder."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & x.isNotNull() & sound)
    q = F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("long"))
    fits = F.forall(q, lambda v: F.abs(v) <= LARGEST)
    q = F.when(fits, q).otherwise(F.raise_error(F.lit("a component is too large for exact scores")))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), q.alias("q")), "quantised")


def blocks(rows: DataFrame, n_blocks: int, chunk: int, n_chunks: int) -> DataFrame:
    """Rows dealt into n_blocks blocks and their chunks: one row per block and chunk, in the order of ties; written to the shared folder.

    ids, known (id not null), rows and labels come with chunk 0 only; m is the matrix of a chunk, row by row.
    """
    small_batches(rows.sparkSession)
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    schema = pa.schema([("b", pa.int64()), ("k", pa.int32()), *((c, pa.binary()) for c in ("ids", "known", "rows", "labels", "m"))])

    def pack(t: pa.Table) -> pa.Table:
        at = t.column("vec_id")
        known = np.asarray(at.is_valid())
        ids = np.asarray(at.fill_null(0), dtype=np.int64)
        row, label = (np.asarray(t.column(c), dtype=np.int64) for c in ("row", "label"))
        order = np.lexsort((row, ids, ~known))
        m = np.zeros((len(ids), chunk * n_chunks), dtype=np.int64)
        for i, v in enumerate(t.column("q").to_pylist()):
            m[i, : len(v)] = v
        m = m[order]
        m = m.astype(np.int16) if np.abs(m).max(initial=0) < 1 << 15 else m
        width = b"\x02" if m.dtype == np.int16 else b"\x08"
        once = [x[order].tobytes() for x in (ids, known, row, label)]
        out = {c: [] for c in schema.names}
        for k in range(n_chunks):
            for c, v in zip(schema.names, (t.column("b")[0].as_py(), k, *(once if k == 0 else [None] * 4), width + m[:, k * chunk : (k + 1) * chunk].tobytes())):
                out[c].append(v)
        return pa.Table.from_pydict(out, schema=schema)

    return materialize(dealt.groupBy("b").applyInArrow(pack, _BLOCK_ROW), "blocks")


def _matrix(data: bytes, chunk: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int16 if data[0] == 2 else np.int64, offset=1).reshape(-1, chunk).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T in exact int64."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    bound = a.shape[1] * most[0] * most[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 1 << 62:
        raise OverflowError("scores are too large for 64 bits")
    return a @ b.T


def _labels(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def tiles(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, chunk: int, equal: bool) -> DataFrame:
    """(i, j, k, tile): partial scores of anchor block i with row block j over chunk k, those of other labels than asked for zeroed."""
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("k", pa.int32()), ("tile", pa.binary())])

    def sided(side: DataFrame, own: str, other: str, n: int) -> DataFrame:
        # Every chunk carries its labels, to tell which scores a pass asks for.
        labels = side.filter("k = 0").select("b", F.col("labels").alias("l"))
        return side.select("b", "k", "m").join(labels, "b").select(F.col("b").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(other), "k", "l", "m")

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        x, y = (_matrix(t.column("m")[0].as_py(), chunk) for t in (a, b))
        p, q = (_labels(t.column("l")[0].as_py()) for t in (a, b))
        tile = product(x, y) * ((p[:, None] == q) == equal)
        small = np.abs(tile).max(initial=0) < 1 << 31
        data = b"\x04" + tile.astype(np.int32).tobytes() if small else b"\x08" + tile.tobytes()
        return pa.Table.from_pydict({"i": [a.column("i")[0].as_py()], "j": [b.column("j")[0].as_py()], "k": [a.column("k")[0].as_py()], "tile": [data]}, schema=schema)

    left, right = sided(anchors, "i", "j", n_row_blocks), sided(rows, "j", "i", n_anchor_blocks)
    return left.groupBy("i", "j", "k").cogroup(right.groupBy("i", "j", "k")).applyInArrow(multiply, "i long, j long, k int, tile binary")


def _added(parts: pa.Table, shape: tuple[int, int]) -> np.ndarray:
    """The whole tile of a pair of blocks: its partial tiles added in int64."""
    total = np.zeros(shape, dtype=np.int64)
    for data in parts.column("tile"):
        raw = data.as_py()
        if raw is not None:
            total += np.frombuffer(raw, dtype=np.int32 if raw[0] == 4 else np.int64, offset=1).reshape(shape)
    return total


def _best(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) places of the n highest allowed scores of each row, the leftmost among equals; rows in order, best first."""
    masked = np.where(allowed, scores, _NONE)
    width = masked.shape[1]
    if width > n:  # the n-th highest score bounds what is sorted
        bar = np.partition(masked, width - n, axis=1)[:, width - n]
        r, c = np.nonzero(allowed & (masked >= bar[:, None]))
    else:
        r, c = np.nonzero(allowed)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r, side="left")
    keep = np.arange(len(r)) - first < n
    return r[keep], c[keep]


def _meta(side: DataFrame, own: str, other: str, n: int, *extra: str) -> DataFrame:
    """Ids, rows and labels of a side's blocks for each of its n tiles."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(other)
    return side.filter("k = 0").select(F.col("b").alias(own), every, "ids", "known", "rows", "labels", *extra)


def _searched(parts: DataFrame, anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], best, schema: pa.Schema, *extra: str) -> DataFrame:
    """The rows that best(scores, anchor block, row block) gives for every added tile."""
    left, right = (_meta(side, own, other, n, *more) for side, own, other, n, more in ((anchors, "i", "j", sizes[1], extra), (rows, "j", "i", sizes[0], ())))
    prefixed = lambda d, p: d.select("i", "j", *(F.col(c).alias(p + c) for c in d.columns if c not in "ij"))
    meta = prefixed(left, "a_").join(prefixed(right, "b_"), ["i", "j"])
    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'boolean'}" for f in schema)

    def reduce(got: pa.Table, of: pa.Table) -> pa.Table:
        if not got.num_rows or not of.num_rows:
            return schema.empty_table()
        one = {c: of.column(c)[0].as_py() for c in of.column_names}
        a, b = ({c: np.frombuffer(one[p + c], dtype=bool if c == "known" else np.int64) for c in ("ids", "known", "rows", "labels")} for p in ("a_", "b_"))
        a |= {c: one[f"a_{c}"] for c in extra}
        return best(_added(got, (len(a["ids"]), len(b["ids"]))), a, b)

    return parts.groupBy("i", "j").cogroup(meta.groupBy("i", "j")).applyInArrow(reduce, kinds)


def _positives(n: int):
    schema = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def best(scores: np.ndarray, a: dict, b: dict) -> pa.Table:
        r, c = _best(scores, (a["labels"][:, None] == b["labels"]) & (a["rows"][:, None] != b["rows"]), n)
        ids = pa.array(b["ids"][c], mask=~b["known"][c])
        return pa.Table.from_arrays([pa.array(a["rows"][r]), pa.array(a["ids"][r]), pa.array(b["rows"][c]), ids, pa.array(scores[r, c])], schema=schema)

    return best, schema


def _negatives(n: int, positives: int, low: int):
    schema = pa.schema([("anchor", pa.int64()), ("p", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def best(scores: np.ndarray, a: dict, b: dict) -> pa.Table:
        high = np.frombuffer(a["windows"], dtype=np.int64).reshape(positives, -1)  # score of every anchor's p-th positive
        other = a["labels"][:, None] != b["labels"]
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for p in range(positives):
            top = high[p]
            floor = -((-top * low) // 100)  # the least score s with low * top <= 100 * s
            r, c = _best(scores, other & (top != _NONE)[:, None] & (scores <= top[:, None]) & (scores >= floor[:, None]), n)
            for column, v in zip(found, (a["rows"][r], np.full(len(r), p, dtype=np.int32), b["rows"][c], np.where(b["known"][c], b["ids"][c], _NONE), scores[r, c])):
                column.append(v)
        anchor, p, row, ids, score = (np.concatenate(v) for v in found)
        return pa.Table.from_arrays([pa.array(anchor), pa.array(p), pa.array(row), pa.array(ids, mask=ids == _NONE), pa.array(score)], schema=schema)

    return best, schema


def _first(found: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """The first n of each group by score, ties by id and row; a bounded heap a task before the shuffle."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)


def mine(vectors: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    vectors has vec_id, embedding and label; `anchor` says of a row (by vec_id) whether it is an anchor.
    """
    rows = quantised(vectors, scale)
    spark = rows.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(anchor, F.lit(False))).alias("a"), F.max(F.size("q")).alias("d")).first()
    if not size["a"]:
        return spark.createDataFrame([], names)
    chunk = max(CHUNK, -(-size["d"] // MAX_CHUNKS))
    n_chunks = max(1, -(-size["d"] // chunk))
    n_rows, n_anchors = (max(1, round(size[c] / BLOCK)) for c in ("n", "a"))
    all_blocks = blocks(rows, n_rows, chunk, n_chunks)
    anchor_blocks = blocks(rows.filter(anchor), n_anchors, chunk, n_chunks)

    best, schema = _positives(positives)
    found = _searched(tiles(anchor_blocks, all_blocks, n_anchors, n_rows, chunk, True), anchor_blocks, all_blocks, (n_anchors, n_rows), best, schema)
    near = materialize(_first(found, ["anchor"], positives, "p").withColumn("p", F.col("p") - 1), "positives")

    # Every anchor block with the scores of its anchors' positives: at most BLOCK times `positives` numbers each.
    of = near.select(F.pmod(F.xxhash64(F.col("anchor")), F.lit(n_anchors)).alias("b"), "anchor", "p", "score")
    held = anchor_blocks.filter("k = 0").select("b", "rows")

    def windows(block: pa.Table, got: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"b": pa.array([], pa.int64()), "windows": pa.array([], pa.binary())})
        at = np.frombuffer(block.column("rows")[0].as_py(), dtype=np.int64)
        order = np.argsort(at)
        high = np.full((positives, len(at)), _NONE)
        if got.num_rows:
            place = order[np.searchsorted(at[order], np.asarray(got.column("anchor")))]
            high[np.asarray(got.column("p")), place] = np.asarray(got.column("score"))
        return pa.table({"b": block.column("b"), "windows": pa.array([high.tobytes()], pa.binary())})

    high = held.groupBy("b").cogroup(of.groupBy("b")).applyInArrow(windows, "b long, windows binary")
    best, schema = _negatives(negatives, positives, low_percent)
    parts = tiles(anchor_blocks, all_blocks, n_anchors, n_rows, chunk, False)
    found = _searched(parts, anchor_blocks.join(high, "b"), all_blocks, (n_anchors, n_rows), best, schema, "windows")
    kept = _first(found, ["anchor", "p"], negatives, "rank")
    out = kept.join(near.select("anchor", "p", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "p"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """mine() with the production rules: anchors every ANCHORS-th vec_id, and labels of every seventh moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label").cast("long"))
    return mine(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % ANCHORS == 0)


#: The production query in SQL.
SQL = f"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {ANCHORS} = 0 AND a.k <> b.k),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LOW_PERCENT} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
