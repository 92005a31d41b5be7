"""Connected components of a link table, in rounds of equi-joins (alternating large and small stars).

Every round rewrites each vertex's links towards its smallest neighbour; the table never grows
past one link per vertex and neighbour, and stays in the shared folder from one round to the next. Nothing
but two totals a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, scratch_path


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest vertex of u and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them; links point from larger to smaller."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _written(e: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(e.sparkSession, "links")
    e.write.parquet(path)
    return e.sparkSession.read.schema(e.schema).parquet(path), path


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root): root is the smallest vertex that can be reached; vertices without a link to another are absent.

    Self-links, repeated links and both directions are allowed; nulls are not links.
    """
    e = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, path = _written(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
        before = state
        last = path
        e, path = _written(_small_star(_large_star(e)))
        delete(e.sparkSession, last)  # many rounds would fill the shared folder
