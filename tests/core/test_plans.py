import random

import duckdb
import pyarrow as pa
import pytest
from blockloom.cli import git_arguments, main
from blockloom.functions import similarity as S
from blockloom.functions import tables
from blockloom.operators import relational as R
from blockloom.operators.documents import documents_of
from blockloom.operators.spans import held
from blockloom.options import Options
from blockloom.plans import review as V
from blockloom.plans.catalog import ORACLES, QUERIES, programs
from blockloom.plans.fixtures import SOURCES, code_pairs
from blockloom.sources.files import read_pairs, table_pairs, write_reports
from blockloom.streaming.review import read_stream, write_reviews
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: One query of each family; the driver's own check runs them all.
SAMPLE = ["language_by_name", "folded_names", "scope_paths", "exact_name_pairs", "comment_owners", "merged_comments", "replaced_lines", "summary_counters", "supplement_lines", "doc_pair_lcs"]


def value(v):
    return "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(value(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_places_held_by_a_span(spark):
    spans = spark.createDataFrame([(1, 0, 100), (1, 40, 41), (1, 30, 60), (2, 0, 10), (1, 5, 5), (4, 0, 9)], "k int, s long, e long")
    places = spark.createDataFrame([(1, p, p + n) for p in (0, 29, 30, 40, 59, 99, 100) for n in (1, 5, 70)] + [(3, 1, 2), (2, 0, 10), (2, 0, 11)], "k int, lo long, hi long")
    got = {tuple(r) for r in held(places, spans, ["k"], "lo", "hi", "s", "e").collect()}
    want = {tuple(r) for r in places.collect() if any(k == r.k and s <= r.lo and r.hi <= e for k, s, e in ((1, 0, 100), (1, 30, 60), (2, 0, 10)))}
    assert got == want and len(want) > 5
    assert "Python" not in held(places, spans, ["k"], "lo", "hi", "s", "e")._jdf.queryExecution().toString()


def test_tables_of_reviews(spark):
    pairs = code_pairs(spark)
    rows = {r.pair_id: r for r in V.review(pairs).collect()}
    assert set(rows) == {r.pair_id for r in pairs.collect()} and rows["quux"].fallback and not rows["ts"].fallback
    assert rows["ts"].summary.renamed == 1
    blocks = V.blocks(pairs.filter("pair_id = 'ts'"))
    found = V.match_blocks(blocks)
    assert {(r.stage) for r in found.collect()} >= {"1", "2", "3b"}
    lines = V.line_diff(pairs.filter("pair_id = 'quux'"), Options(word_diff=True)).collect()
    assert [(r.type, r.content) for r in lines] == [("ctx", "one"), ("del", "two"), ("add", "2"), ("ctx", "three")]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a.ts", None, "a.ts", "const x = 1;")], "pair_id int, old_name string, old_src string, new_name string, new_src string")
    assert V.review(odd).count() == 2 and V.review(odd.filter("false")).count() == 0


def test_blocks_as_a_table_function(spark):
    tables.register(spark)
    pairs = code_pairs(spark)
    got = spark.sql("SELECT f.pair_id, 'new' AS side, b.* FROM {p} f, LATERAL blocks(f.new_src, f.new_name) b", p=pairs)
    want = V.blocks(pairs).filter("side = 'new'")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    for odd in ("NULL, 'a.ts'", "'const x = 1;', NULL", "'const x = 1;', 'a.quux'", "'', 'a.c'"):
        assert spark.sql(f"SELECT * FROM blocks({odd})").count() == 0
    assert [r.name for r in spark.sql("SELECT * FROM blocks('const x = 1;', 'a.ts')").collect()] == ["x"]


def test_files_tables_and_reports(spark, tmp_path):
    for side, k in (("old", 1), ("new", 2)):
        (tmp_path / side / "d").mkdir(parents=True)
        for name, *src in SOURCES.values():
            (tmp_path / side / "d" / name).write_text(src[k - 1])
    (tmp_path / "new" / "only.go").write_text("package p\n")
    pairs = read_pairs(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    got = {r.pair_id: r for r in pairs.collect()}
    assert got["d/gauge.ts"].old_src == SOURCES["ts"][1] and got["only.go"].old_src == ""
    write_reports(V.reports(pairs.filter("pair_id = 'only.go'")), str(tmp_path / "out"))
    text = spark.read.text(f"{tmp_path}/out", wholetext=True).first().value
    assert text.startswith("diff --blockloom only.go only.go\n") and "Summary" in text
    a, b = (spark.createDataFrame([(k, t)], "k int, t string") for k, t in ((1, "x"), (2, "y")))
    assert table_pairs(a, b, "k", "t").count() == 2


def test_stream(spark, tmp_path):
    code_pairs(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = write_reviews(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == code_pairs(spark).count()


def test_command_line(tmp_path, capsys):
    name, old, new = SOURCES["c"]
    a, b = tmp_path / "a.c", tmp_path / "b.c"
    a.write_text(old), b.write_text(new)
    assert main([str(a), str(b), "--no-color"]) == 0
    assert "count → count_all" in capsys.readouterr().out
    assert main(["-B", str(a), "-A", str(b), "--old", "x.c", "--new", "y.c", "--summary", "--no-color"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("diff --blockloom x.c y.c\nSummary\n")
    assert main(["-", "-"]) == 1 and main([str(a), "/nowhere/b.c"]) == 1 and main(["1", "2", "3"]) == 1
    assert main(["--git", "p"]) == 0 and "* Unmerged path p" in capsys.readouterr().out
    assert main(["--git", "1", "2", "3"]) == 2
    seven = ["p.c", str(a), "0", "1", str(b), "2", "3"]
    assert main(["--git", *seven]) == 0
    assert "--skip-unchanged" not in git_arguments(seven, {"BLOCKLOOM_KEEP_UNCHANGED": "1"}) and "--word-diff" in git_arguments(seven, {"BLOCKLOOM_WORD_DIFF": "1"})


def test_ancestors_of_any_depth_rings_and_lost_parents(spark):
    """A hundred levels, rings, a parent that isn't there and documents cut by batches, against plain walks."""
    rows = [("a", "old", f"class:c{i}:{i}", "namespace" if i % 10 == 9 else "class", f"c{i}", f"class:c{i - 1}:{i - 1}" if i else "function:gone:5") for i in range(100)]
    rows += [("a", "new", f"class:r{i}:{i}", "class", f"r{i}", f"class:r{(i + 1) % 3}:{(i + 1) % 3}") for i in range(3)]
    rows += [(f"d{k}", "old", f"class:x:{i}", "class", "x", "class:x:0" if i else "") for k in range(30) for i in range(3)]
    blocks = spark.createDataFrame(rows, "pair_id string, side string, id string, kind string, name string, parent string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.pair_id, r.side, r.id): r.scope_path for r in R.scope_paths(blocks).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    by = {(p, s, i): (k, n, up) for p, s, i, k, n, up in rows}
    for p, s, i, _, _, up in rows:
        out, seen = [], {i}
        while up and up not in seen:
            seen.add(up)
            kind, name, after = by.get((p, s, up), (None, None, None))
            if kind != "namespace":
                out.append(up.rsplit(":", 1)[0] if kind is None else f"{kind}:{name}")
            up = after
        assert got[p, s, i] == ">".join(reversed(out))
    assert got["a", "old", "class:c99:99"].startswith("function:gone>class:c0>class:c1>")


def test_nearest_comments_against_all_pairs(spark):
    import random

    r = random.Random(8)
    rows = [(p, s, i, f"comment:{s}{i}", "comment", r.choice("ab")) for p in range(6) for s in ("old", "new") for i in range(r.randint(0, 9))]
    blocks = spark.createDataFrame(rows, "pair_id long, side string, block_ix int, id string, kind string, source string")
    got = {(x.pair_id, x.old_id): x.new_id for x in R.nearest_comment_pairs(blocks).collect()}
    want = {}
    for p, s, i, b, _, t in rows:
        near = sorted((abs(i - j), j, c) for q, z, j, c, _, u in rows if (q, z, u) == (p, "new", t))
        if s == "old" and near:
            want[p, b] = near[0][2]
    assert got == want


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_forests_take_one_shuffle_of_the_lines(spark):
    """Findings F21, F22, F24, F26 of round 4: blocks and what is above them once took five."""
    for name, most in (("scope_paths", 1), ("scope_stamps", 1), ("root_level", 1), ("exact_name_pairs", 2)):
        assert _shuffles(QUERIES[name](spark, SF)) <= most, name


def test_levels_against_walks_of_single_blocks():
    rnd = random.Random(4)
    names = ("id", "kind", "name", "parent")
    for _ in range(500):
        ids = [rnd.choice(["a:1", "b:2", "c:3", "d:4", None]) for _ in range(8)]
        rows = [(i // 3, "old", ids[i], rnd.choice(["namespace", "class", "function", None]), rnd.choice(["", "x", None]), rnd.choice([*ids, "", "gone:5", "gone:5\n"])) for i in range(8)]
        t = pa.table({c: pa.array(v, pa.int64() if c == "pair_id" else pa.string()) for c, v in zip(("pair_id", "side", *names), zip(*rows))})
        plain = [r for lo, hi in documents_of(t, R.DOC) for r in R._above(*(t.column(c).to_pylist()[lo:hi] for c in names))]
        assert list(zip(*(c.to_pylist() for c in R._levels(t)))) == plain


@pytest.mark.parametrize("name", ["residual_blocks", "correlation", "orphaned_blocks", "nested_members", "skipped_lines"])
def test_exact_states_take_two_shuffles(spark, name):
    """Findings F10, F11, F13, F16 and F20 of round 4: each once read the blocks two to five times."""
    assert _shuffles(QUERIES[name](spark, SF)) <= 2


def test_exact_states_give_the_rows_of_the_joins(spark):
    rows = []
    for pair in (1, 2, None):
        for side, shift in (("old", 0), ("new", pair or 0)):
            held = "class:K:0" if pair != 2 else "class:gone:9"
            rows += [(pair, side, 0, f"class:K:{shift * 5}", "class", "K", "", 0, 90), (pair, side, 1, "method:m:10", "method", "m", held, 10, 20), (pair, side, 2, "method:u:30", "method", "u" + side, "class:K:0", 30, 40), (pair, side, 3, "comment::50", "comment", "", "method:m:10", 50, 99)]
    b = spark.createDataFrame(rows, "pair_id long, side string, block_ix int, id string, kind string, name string, parent string, start_byte long, end_byte long")
    pairs = R.unique_exact_pairs(b)
    used = pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id")) for s in ("old", "new")))).alias("e")).select("pair_id", "e.*")
    lines = b.select("pair_id", "side", F.col("block_ix").alias("line_no"), (F.col("start_byte") + 2).alias("lo"), (F.col("start_byte") + 6).alias("hi"))
    skipped = b.join(used, ["pair_id", "side", "id"], "left_semi").select("pair_id", "side", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    same = lambda x, y: sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))
    assert same(R.exact_residual(b), R.residual(b, pairs).distinct())
    assert same(R.exact_correlation(b), R.correlated(b, pairs))
    assert same(R.exact_orphans(b).filter("pair_id IS NOT NULL"), R.orphaned(b, used).filter("pair_id IS NOT NULL"))
    assert same(R.exact_nested(b).filter("pair_id IS NOT NULL"), R.nested_members(b, R.residual(b, pairs)))
    assert same(R.exact_skipped(b, 2, 6).filter("pair_id IS NOT NULL"), R.skipped_lines(lines, skipped).filter("pair_id IS NOT NULL"))


def test_programs_are_dealt_over_tasks(spark):
    """Findings F7, F8, F9, F17 and F18 of round 4: the small table of parts was read, and all its reviews made, by one task."""
    assert programs(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_token_lists_stay_in_the_kernel(spark):
    """Finding F12 of round 4: the lists of 10,000 turns at a time once were results of a function."""
    assert "array<string>" not in QUERIES["turn_tokens"](spark, SF)._jdf.queryExecution().toString() and "PythonUDF" not in QUERIES["turn_tokens"](spark, SF)._jdf.queryExecution().toString()
    texts = [None, "", "a = b", "a=b", "a=b", "a == 'é'", "a  ==  'é'", None, "x"]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate((x, y) for x in texts for y in texts)], "i int, x string, y string")
    t, u = S.lexical_tokens("x", F.lit("")), S.lexical_tokens("y", F.lit(""))
    want = {r.i: (r.n, r.f) for r in rows.select("i", F.size(t).alias("n"), ((F.col("x") != F.col("y")) & (t == u)).alias("f")).collect()}
    got = {r.i: (r.tokens, r.formatting_only) for r in S.lexical_changes(rows, "x", "y").collect()}
    absent = {i for i, (n, f) in want.items() if f is None or n == -1}
    assert {i: v[1] for i, v in got.items() if i not in absent} == {i: v[1] for i, v in want.items() if i not in absent} and any(v[1] for v in got.values())
    assert all((got[i][0], got[i][1]) == want[i] for i in want)


def test_summaries_take_no_lines_along(spark):
    """Finding F25 of round 4: summaries and reports once carried every line of a review out of the kernel."""
    pairs = programs(spark, SF)
    for made in (V.summaries(pairs), V.reports(pairs)):
        assert "supplemental" not in made._jdf.queryExecution().toString()
    whole = V.review(pairs).select("pair_id", "summary.*", "old_parse_errors", "new_parse_errors", "fallback")
    assert whole.columns == V.summaries(pairs).columns and sorted(whole.collect()) == sorted(V.summaries(pairs).collect())


def test_supplement_meets_in_one_shuffle(spark):
    lines = [(1, "old", 1, "add", "a", 0, 1), (1, "old", 2, "add", " b ", 3, 4), (1, "old", 3, "ctx", "c", 6, 7), (1, "old", 4, "add", None, 8, 9), (1, "old", 5, "add", "a", 20, 21), (1, "new", 1, "add", "a", 0, 1), (None, "old", 1, "add", "a", 0, 1), (2, "old", 1, "add", "", 5, 5)]
    lines = spark.createDataFrame(lines, "pair_id long, side string, line_no long, type string, content string, lo long, hi long")
    shown = spark.createDataFrame([(1, "old", "a"), (1, "old", "b"), (1, "old", None), (None, "old", "a"), (2, "old", "")], "pair_id long, side string, content string")
    owned = spark.createDataFrame([(1, "old", 1, 1, False), (1, "old", 2, 4, True), (None, "old", 1, 1, True), (2, "old", 1, 0, True)], "pair_id long, side string, first long, last long, is_comment boolean")
    skipped = spark.createDataFrame([(1, "old", 6, 7), (1, "old", 19, 20), (2, "old", 0, 9)], "pair_id long, side string, s long, e long")
    for context in (False, True):
        got = R.supplement(lines, shown, owned, skipped, context)
        assert {tuple(x) for x in got.collect()} == {(1, "old", 4, None), (1, "old", 5, "a"), (1, "new", 1, "a"), (None, "old", 1, "a"), (2, "old", 1, "")}
        assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1
