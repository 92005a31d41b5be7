"""Reading pairs of source files and writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.review import PAIR_COLUMNS


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, src) of every file below root; path is relative, bytes that aren't UTF-8 become U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    return rows.select(F.substring_index("path", full + "/", -1).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("src"))


def read_pairs(spark: SparkSession, old_root: str, new_root: str, glob: str = "*") -> DataFrame:
    """Pairs of two trees by relative path; a file in one tree only is paired with an empty text of its name."""
    old = read_files(spark, old_root, glob).select("path", F.col("src").alias("old_src"))
    new = read_files(spark, new_root, glob).select("path", F.col("src").alias("new_src"))
    both = old.join(new, "path", "full_outer")
    return both.select(F.col("path").alias("pair_id"), F.col("path").alias("old_name"), F.coalesce("old_src", F.lit("")).alias("old_src"), F.col("path").alias("new_name"), F.coalesce("new_src", F.lit("")).alias("new_src"))


def table_pairs(old: DataFrame, new: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """Pairs of two versions of a table by key; rows in one version only are paired with an empty text."""
    side = lambda df, s: df.select(F.col(key).alias("pair_id"), (F.col(name) if name else F.lit("")).alias(f"{s}_name"), F.col(text).alias(f"{s}_src"))
    return side(old, "old").join(side(new, "new"), "pair_id", "full_outer").select(*PAIR_COLUMNS)


def write_reports(reports: DataFrame, path: str) -> None:
    """One text file per pair_id folder, its lines in order. reports: pair_id, line_seq, text."""
    ordered = reports.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("line_seq", "text"))).alias("l"))
    lines = F.slice("l.text", 1, F.size("l") - 1)  # a report ends with a line feed, which the writer adds
    ordered.select("pair_id", F.array_join(lines, "\n").alias("value")).write.partitionBy("pair_id").text(path)
