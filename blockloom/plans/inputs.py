"""Tables of pairs, blocks and lines made from the driver's relational tables.

The texts below are valid in Spark SQL and in the oracle's dialect alike: {name} stands for a
table. An order's lines play the blocks of a document: as old version by line number, as new
one by ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import many_tasks

#: Blocks of an order: kinds, spans that hold one another, unnamed ones, and parents that exist, miss or are roots.
BLOCKS = """
    SELECT pair_id, side, block_ix, id, kind, name, scope_own,
           CASE WHEN s % 11 = 0 THEN 'function:gone:5' WHEN block_ix > 1 AND s % 3 > 0 THEN lag(id) OVER (PARTITION BY pair_id, side ORDER BY block_ix) ELSE '' END AS parent,
           start_byte, end_byte, start_line, end_line, source, own_line
    FROM (
        SELECT *, kind || ':' || name || ':' || CAST(start_byte AS STRING) AS id,
               CASE WHEN kind = 'comment' THEN '// ' || flag ELSE flag || kind || CAST(q AS STRING) END AS source
        FROM (
            SELECT l_orderkey AS pair_id, side, block_ix, l_suppkey AS s, l_returnflag || l_linestatus AS flag, CAST(l_quantity AS INT) AS q, l_suppkey % 5 <> 0 AS own_line,
                   CASE l_partkey % 9 WHEN 0 THEN 'comment' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'class' WHEN 4 THEN 'constant' WHEN 5 THEN 'comment' WHEN 6 THEN 'jsx' WHEN 7 THEN 'namespace' ELSE 'arrow_function' END AS kind,
                   CASE WHEN l_partkey % 9 IN (0, 5) OR l_suppkey % 4 = 0 THEN '' ELSE 'n' || CAST(l_partkey % 3 AS STRING) END AS name, '' AS scope_own,
                   CAST(block_ix * 10 AS BIGINT) AS start_byte, CAST(block_ix * 10 + (l_partkey % 5) * 10 + 8 AS BIGINT) AS end_byte,
                   CAST(block_ix AS BIGINT) AS start_line, CAST(block_ix + l_partkey % 2 AS BIGINT) AS end_line
            FROM (
                SELECT *, 'old' AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS block_ix FROM {lineitem}
                UNION ALL
                SELECT *, 'new' AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber) AS block_ix FROM {lineitem}
            ) u
        ) k
    ) i
"""

#: Both versions of an order's lines, as BLOCKS reads them.
_BOTH = """
                SELECT *, 'old' AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS block_ix FROM {lineitem}
                UNION ALL
                SELECT *, 'new' AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber) AS block_ix FROM {lineitem}
"""

#: The same rows from one shuffle: a line gets both of its numbers and gives a block of each version.
_BOTH_AT_ONCE = """
                SELECT l.*, e.side, e.block_ix FROM (
                    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS old_ix,
                           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber) AS new_ix FROM {lineitem}
                ) l LATERAL VIEW inline(array(named_struct('side', 'old', 'block_ix', old_ix), named_struct('side', 'new', 'block_ix', new_ix))) e AS side, block_ix
"""

#: BLOCKS for Spark, which plans it with one shuffle; the oracle reads BLOCKS itself.
BLOCKS_AT_ONCE = BLOCKS.replace(_BOTH, _BOTH_AT_ONCE)

#: Lines of a diff: an order's lines, each kept, removed or added.
LINES = """
    SELECT l_orderkey AS pair_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS line_seq, CASE WHEN l_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS side,
           CASE l_partkey % 4 WHEN 0 THEN 'del' WHEN 1 THEN 'add' WHEN 2 THEN 'add' ELSE 'ctx' END AS type, l_returnflag || CAST(l_partkey % 3 AS STRING) AS content
    FROM {lineitem}
"""

#: Pairs of blocks as classified: one-sided and two-sided ones with what the summary asks.
PAIRS = """
    SELECT l_orderkey AS pair_id, 'o' || CAST(l_linenumber AS STRING) AS old_id, 'n' || CAST(l_linenumber AS STRING) AS new_id,
           CASE l_partkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'matched' END AS state, l_suppkey % 3 = 0 AS is_rename, l_partkey % 7 < 3 AS has_changes,
           l_suppkey % 5 = 0 AS ws_only, l_linenumber % 4 = 0 AS moved, l_partkey % 2 = 0 AS same_source, l_linenumber = 7 AS supplemental,
           CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'class' ELSE 'jsx' END AS old_kind,
           CASE WHEN l_partkey % 5 = 1 THEN NULL WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 2 = 0 THEN 'function' ELSE 'template' END AS new_kind,
           CASE WHEN l_suppkey % 6 = 0 THEN 'unknown' ELSE 'class' END AS kind
    FROM {lineitem}
"""

#: Two versions of a small program for each part, in scripts and in C: every third part changes its size, every fifth renames its function.
PROGRAMS = """
    SELECT pair_id, name AS old_name, head || CAST(s AS STRING) || middle || 'cost' || tail || CAST(s AS STRING) || foot AS old_src,
           name AS new_name, head || CAST(s + grow AS STRING) || middle || CASE WHEN pair_id % 5 = 0 THEN 'price' ELSE 'cost' END || tail || CAST(s + grow AS STRING) || foot AS new_src
    FROM (
        SELECT p_partkey AS pair_id, p_size AS s, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS grow, CASE WHEN p_partkey % 2 = 0 THEN 'part.js' ELSE 'part.c' END AS name,
               CASE WHEN p_partkey % 2 = 0 THEN 'const size' || CAST(p_partkey AS STRING) || ' = ' ELSE 'static const int size' || CAST(p_partkey AS STRING) || ' = ' END AS head,
               CASE WHEN p_partkey % 2 = 0 THEN ';' || chr(10) || chr(10) || 'function ' ELSE ';' || chr(10) || chr(10) || 'int ' END AS middle,
               CASE WHEN p_partkey % 2 = 0 THEN '(n) ' ELSE '(int n) ' END || chr(123) || chr(10) || '  return n * ' AS tail, ';' || chr(10) || chr(125) || chr(10) AS foot
        FROM {part}
    ) t
"""

#: Names of source files.
NAMES = """
    SELECT p_partkey, 'dir.d/' || replace(p_name, ' ', '_') || CASE p_partkey % 12 WHEN 0 THEN '.ts' WHEN 1 THEN '.TSX' WHEN 2 THEN '.mjs' WHEN 3 THEN '.go' WHEN 4 THEN '.sh' WHEN 5 THEN '.c'
           WHEN 6 THEN '.C' WHEN 7 THEN '.h++' WHEN 8 THEN '.H' WHEN 9 THEN '' WHEN 10 THEN '.quux' ELSE '.tar.jsx' END AS file
    FROM {part}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """One of the texts above over the parquet tables of a folder."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has, four for each core at least.

    For small rows of which each is much work: a table of some MB is read by few tasks, and adaptive plans join a
    shuffle without a number into few as well.
    """
    return rows.repartition(many_tasks(rows.sparkSession), key)


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the first one (lowest doc_id) with the same opening line: near copies of one another.

    One row per document at most, by a map-side-combined minimum and an equi-join.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("opening"))
    first = docs.groupBy("opening").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rest = docs.join(first, "opening").filter("doc_id <> first_id")
    old = docs.select(F.col("doc_id").alias("first_id"), F.col("text").alias("old_src"))
    return rest.join(old, "first_id").select(F.col("doc_id").alias("pair_id"), F.lit("a.txt").alias("old_name"), "old_src", F.lit("b.txt").alias("new_name"), F.col("text").alias("new_src"), "first_id")


#: The same in the oracle's dialect.
DOCUMENT_PAIRS = """
    SELECT d.doc_id AS pair_id, o.text AS old_src, d.text AS new_src, f.first_id
    FROM documents d JOIN (SELECT split_part(text, chr(10), 1) AS opening, min(doc_id) AS first_id FROM documents GROUP BY 1) f ON split_part(d.text, chr(10), 1) = f.opening
    JOIN documents o ON o.doc_id = f.first_id WHERE d.doc_id <> f.first_id
"""
