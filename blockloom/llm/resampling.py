"""Importance resampling towards a target, by word tries local to each partition.

Features of a text are its runs of 1 to `order` consecutive words, joined by one space. Every
task keeps a trie whose edges are words: a node stands for one feature, holds how often the
task met it and the CRC state of the feature's bytes, so that a longer feature continues the
state of the shorter one instead of hashing it anew. A node's CRC modulo `buckets` is the
feature's bucket. A trie that has grown to NODES nodes adds its counts to the task's bucket
totals and starts again, so memory has a bound and nothing is left out. Totals of tasks are
added by one map-side-combined sum: `buckets` rows a task at most.

A bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), with t of T features of the
target and s of S features of the documents in it, and B buckets. Documents are scored by a
second pass: tries again, whose nodes hold their bucket's gain, and a text's weight is the sum
of the gains along its paths. Gumbel noise from a hash of the id makes the highest scores a
draw without replacement; places are counted within ranges of scores dealt over all tasks, so
that no task sorts the table.

Defined results: null text has no words, weight 0 and (as any text of under `least` words) is
never drawn; a null doc_id hashes as an empty id and comes last among equal scores; repeated
rows are documents of their own, at neighbouring places; empty tables give no rows, and an
empty target makes every gain a loss of frequency alone; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_slices

#: Production parameters: words of a feature at most, buckets, words of a document that may be drawn, percent drawn, seed.
ORDER, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Nodes of a trie (some 200 bytes each) at which its counts are added to the totals.
NODES = 1 << 18
#: Words of lower-cased UTF-8 bytes.
_word = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Places of a node: the node's features met, CRC state, gain of its bucket, and nodes of one more word.
COUNT, CRC, GAIN, NEXT = range(4)


def words(text: str | None) -> list[bytes]:
    return _word.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WordTrie:
    """Features of the texts that one task has met, to `order` words; gains are by bucket, where they are known."""

    def __init__(self, order: int, buckets: int, gains: np.ndarray | None = None) -> None:
        self.order, self.buckets = order, buckets
        self.gains = None if gains is None else gains.tolist()
        self.totals = np.zeros(buckets, dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        self.root: list = [0, 0, 0, {}]
        self.nodes: list[list] = []

    def _grow(self, above: list, word: bytes) -> list:
        """The new node of a word below another node."""
        crc = zlib.crc32(word if above is self.root else b" " + word, above[CRC])
        node = [0, crc, self.gains[crc % self.buckets] if self.gains else 0, {} if self.order > 1 else None]
        above[NEXT][word] = node
        self.nodes.append(node)
        return node

    def walk(self, found: list[bytes]) -> tuple[int, int]:
        """Count the features of a text; their number and the sum of their gains."""
        n = gain = 0
        for depth in range(min(self.order, len(found))):
            # All features of depth + 1 words: one step further from the nodes of the round before.
            ends = [self.root] * len(found) if depth == 0 else ends[: len(found) - depth]
            for i, above in enumerate(ends):
                word = found[i + depth]
                node = above[NEXT].get(word)
                if node is None:
                    node = self._grow(above, word)
                node[COUNT] += 1
                gain += node[GAIN]
                ends[i] = node
            n += len(ends)
        if len(self.nodes) > NODES:
            self.fold()
        return n, gain

    def fold(self) -> None:
        """Add the counts of all nodes to the totals of their buckets, and forget the nodes."""
        if self.nodes:
            at = np.array([x[CRC] for x in self.nodes], dtype=np.int64) % self.buckets
            np.add.at(self.totals, at, np.array([x[COUNT] for x in self.nodes], dtype=np.int64))
        self._clear()


def bucket_totals(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of the column text; buckets without a feature are absent."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(order, buckets)
        for whole in batches:
            for b in text_slices(whole):
                for text in b.column("text"):
                    trie.walk(words(text.as_py()))
        trie.fold()
        at = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(trie.totals[at], pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket; `buckets` numbers a side are all that reaches the driver."""
    count = []
    for texts in (target, documents):
        n = np.zeros(buckets)
        for row in bucket_totals(texts, order, buckets).collect():
            n[row["bucket"]] = row["n"]
        count.append(n)
    t, s = count
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the sum of its features' gains."""
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(order, len(gain), gain)
        for whole in batches:
            for b in text_slices(whole):
                rows = []
                for text in b.column("text"):
                    found = words(text.as_py())
                    rows.append((len(found), *trie.walk(found)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), with h the first 8 hex digits of sha256("seed:doc_id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def places(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in this order, which must tell all rows apart that differ.

    Rows are dealt by ranges of the order and sorted within them; what a range has before it is a
    sum over as many numbers as there are ranges.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges").withColumn("__range", F.shiftright("__at", 33))
    before, start = 0, []
    for k, n in sorted((r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()):
        start.append((k, before))
        before += n
    starts = rows.sparkSession.createDataFrame(start, "__range bigint, __before bigint")
    within = F.col("__at").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + within + 1).drop("__at", "__range", "__before")


def resample(documents: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of documents; rank is null where a document isn't drawn.

    Of the N documents of `least` words or more, the floor(percent * N / 100) highest scores are
    drawn, ties going to the smaller doc_id. documents has doc_id and text, target has text.
    """
    scored = weights(documents, gains(documents, target, order, buckets), order)
    scored = scored.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("__row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    able = scored.filter(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("__row")]
    ranked = places(able, by, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: The production query in SQL; CRC-32 is computed bit by bit for a table, then byte by byte for each distinct word.
SQL = f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS tab),
d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
dw AS (SELECT k, unnest(ws) AS w FROM d), qw AS (SELECT unnest(ws) AS w FROM q),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM qw)),
b AS (SELECT w, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM v, crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM qw JOIN b USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT k, count(*) AS n, sum(gain) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY k),
y AS (SELECT doc_id, k, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (k)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM z WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN r END AS rank FROM z LEFT JOIN r USING (k)
"""
