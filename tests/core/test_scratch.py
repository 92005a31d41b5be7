import os

from blockloom.operators import stages as STAGES
from blockloom.operators.scratch import Scratch
from blockloom.operators.stages import staged_pairs
from pyspark.sql import functions as F

from .test_similar import BLOCK, versions


def test_a_table_that_is_written_leaves_no_shuffle_files(spark, monkeypatch):
    """The disk holds the shuffles of the step at work, not those of all steps before; the session's setting stays its own."""
    removed = []
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    with Scratch(spark) as scratch:
        write = type(spark.range(1).write).parquet
        monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: removed.append(spark.conf.get(setting, None)) or write(self, path))
        kept = scratch.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
        assert removed == ["true"] and kept.count() == 7
        assert spark.conf.get(setting, None) == before
        other = scratch.keep(spark.range(3).toDF("k"), "other")
        scratch.drop("grouped")
        assert len(scratch.paths) == 1 and not os.path.exists(kept.inputFiles()[0].removeprefix("file://")) and other.count() == 3


def test_children_of_a_stage_go_with_it(spark, monkeypatch):
    gone = []
    drop = Scratch.drop
    monkeypatch.setattr(STAGES.Scratch, "drop", lambda self, name: gone.append(name) or drop(self, name))
    staged_pairs(spark.createDataFrame(versions("p", 1), BLOCK)).count()
    assert gone == ["children", "children"]


def test_places_above_a_block_take_one_join(spark):
    """Containers are known where the forest is walked; rings, missing parents and namespaces included."""
    ring = [("r", "old", i, f"class:{n}:{i}", "class", n, f"class:{m}:{1 - i}", i, 9, "text") for i, (n, m) in enumerate(("ab", "ba"))]
    blocks = spark.createDataFrame([row for k in range(12) for row in versions(f"p{k}", 40 + k)] + ring, BLOCK)
    made = STAGES.nodes(blocks)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Join" in plan
    rows = made.collect()
    of = {(r.pair_id, r.side, r.id): r.block_ix for r in rows}
    above = STAGES.forest(blocks, "block_ix", "kind", "name", "parent").collect()
    want = {(r.pair_id, r.side, r.block_ix): (of.get((r.pair_id, r.side, r.parent)), of.get((r.pair_id, r.side, r.container))) for r in above}
    assert {(r.pair_id, r.side, r.block_ix): (r.parent_ix, r.container_ix) for r in rows} == want
    assert any(c is not None for _, c in want.values()) and len(rows) == len(want)
