import itertools
import random

import pytest
from blockloom.kernels import similar as K
from blockloom.kernels.assignment import best_copies, best_edges
from blockloom.kinds import eligible, kind_similarity
from blockloom.operators import similar as S
from blockloom.operators import stages as STAGES
from blockloom.operators.scratch import Scratch
from blockloom.operators.stages import staged_pairs
from blockloom.plans import review as V

KINDS = ["function", "method", "class", "concept", "comment", "jsx", "constant", "variable"]


def some_blocks(n, seed):
    """Names and bodies in families, some empty, with bytes of every kind."""
    r = random.Random(seed)
    roots = ["loadrows", "savecolumn", "x", "", "render"]
    bodies = ["return a + b;", "", "for (row of rows) { total += row; }", "é = 1", "aaaaaaaaaaaa"]
    out = []
    for _ in range(n):
        name, body = list(r.choice(roots)), list(r.choice(bodies) * r.choice([1, 1, 3]))
        for text in (name, body):
            for _ in range(r.randint(0, 6)):
                at = r.randint(0, len(text))
                text[at : at + r.randint(0, 2)] = r.choice("abcxyz (;é")
        out.append((r.choice(KINDS), "".join(c for c in name if c.isascii() and c.isalnum()).encode(), "".join(body).encode()))
    return out


def plain(a, b, threshold, named):
    if not eligible(a[0], b[0]):
        return None
    s = K.NAME * (K.name_closeness(a[1], b[1]) if named else 0.0) + K.BODY * K.closeness(a[2], b[2]) + K.KIND * kind_similarity(a[0], b[0])
    return s if s >= threshold else None


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.3, 0.5, 0.7, 0.95, 1.0])
@pytest.mark.parametrize("named", [True, False])
def test_index_finds_what_the_full_table_has(threshold, named):
    old, new = some_blocks(60, 1), some_blocks(70, 2)
    new += old[:5]
    index = K.SimilarIndex(new, threshold, named)
    for a in old:
        assert list(index.near(*a)) == [(j, s) for j, b in enumerate(new) if (s := plain(a, b, threshold, named)) is not None]
    assert list(K.SimilarIndex([], threshold, named).near(*old[0])) == []


def test_few_blocks_are_looked_at(monkeypatch):
    """Bodies of other letters never meet, so no distance is taken between them."""
    families = [bytes(range(33 + 9 * k, 42 + 9 * k)) * 4 for k in range(8)]
    blocks = [("comment", b"", families[i % 8] + bytes([33 + 9 * (i % 8)]) * (i // 8)) for i in range(160)]
    taken = []
    monkeypatch.setattr(K, "closeness", lambda a, b, least=0.0: taken.append(1) or 1.0)
    index = K.SimilarIndex(blocks, 0.5, False)
    assert sum(1 for b in blocks for _ in index.near(*b)) > 0 and len(taken) <= 160 * 20


@pytest.mark.parametrize("share", [7, 1024])
def test_join_against_the_full_table(spark, monkeypatch, share):
    monkeypatch.setattr(S, "SHARE", share)
    rows = [(g, i, kind, name.decode(), body.decode(), "x") for g in ("p", "q") for i, (kind, name, body) in enumerate(some_blocks(40, ord(g)))]
    rows += [("p", None, "class", "a", "b", "x"), (None, 5, "class", "a", "b", "x"), ("p", 100, "class", None, None, "x"), ("only old", 1, "class", "a", "b", "x")]
    old = spark.createDataFrame(rows, "doc string, id long, kind string, name string, body string, similarity string")
    new = old.filter("doc <> 'only old' OR doc IS NULL")
    for named in (True, False):
        got = sorted(tuple(r) for r in S.similar_pairs(old, new, ["doc"], 0.5, named).collect())
        shape = lambda r: (r[2], (r[3] or "").encode(), (r[4] or "").encode())
        able = [r for r in rows if r[0] in ("p", "q") and r[1] is not None]
        want = sorted((a[0], a[1], b[1], s) for a, b in itertools.product(able, able) if a[0] == b[0] and (s := plain(shape(a), shape(b), 0.5, named)) is not None)
        assert got == want
    assert S.similar_pairs(old.filter("false"), new, ["doc"]).count() == S.similar_pairs(old, new, ["doc"], float("nan")).filter("similarity < 1").count() == 0
    plan = S.similar_pairs(old, new, ["doc"])._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_assignment_of_joined_pairs(spark):
    r = random.Random(5)
    edges = [(g, f"o{i}", f"n{j}", r.choice([0.5, 0.6, 0.75, 1.0])) for g in range(6) for i in range(7) for j in range(8) if r.random() < 0.4]
    frame = spark.createDataFrame(edges, "g long, a string, b string, similarity double").repartition(3)
    got = sorted(tuple(x) for x in S.assigned(frame, ["g"], "a", "b").collect())
    want = []
    for g in range(6):
        want += [(g, f"o{i}", f"n{j}", s) for i, j, s in best_edges((int(a[1:]), int(b[1:]), s) for h, a, b, s in edges if h == g)]
    assert got == sorted(want)
    assert S.assigned(frame.filter("false"), ["g"], "a", "b").count() == 0


# -- stages as plans -------------------------------------------------------------------------

BLOCK = "pair_id string, side string, block_ix int, id string, kind string, name string, parent string, start_byte long, end_byte long, source string"


def versions(pair, seed, n=14):
    """Two versions of a tree of blocks with few names, so that identities repeat, scopes differ and functions are hoisted."""
    r = random.Random(seed)
    rows = []
    for side in ("old", "new"):
        ids = []
        for i in range(n):
            kind = r.choice(["function", "method", "class", "namespace", "comment", "comment", "jsx", "constant", "concept"])
            name = "" if kind == "comment" or r.random() < 0.2 else r.choice(["load", "save", "Load_", "x", f"only{side}", f"{side}er"])
            up = r.choice([*ids[-4:], "", "class:gone:9"]) if ids else ""
            text = r.choice(["// note", "// other  note", f"// {side} is a longer note", ""]) if kind == "comment" else r.choice(["a + b", "return  a+b;", "<b onClick={f}/>", "", "for (x of y) { z(x); }"])
            start = 10 * i
            rows.append((pair, side, i, f"{kind}:{name}:{start}", kind, name, up, start, start + r.choice([8, 18, 38]), text))
            ids.append(rows[-1][3])
    return rows


def as_rows(df):
    return sorted((r.pair_id, r.stage, r.old_ix if r.old_ix is not None else -1, r.new_ix if r.new_ix is not None else -1, round(r.confidence, 12), r.match_type) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.5, 0.0])
def test_stages_give_the_rows_of_the_kernel(spark, threshold):
    blocks = spark.createDataFrame([row for k in range(40) for row in versions(f"p{k}", k)], BLOCK)
    got = as_rows(staged_pairs(blocks, threshold))
    assert got == as_rows(V.match_blocks(blocks, threshold))
    if threshold == 0.5:
        assert {s for _, s, *_ in got} >= {"1", "2", "3a", "3b", "3c", "3d", "4", "added", "removed"}


def test_large_groups_are_looked_through_in_shares(spark, monkeypatch):
    monkeypatch.setattr(STAGES, "SHARE", 4)
    monkeypatch.setattr(S, "SHARE", 3)
    blocks = spark.createDataFrame([row for k in range(6) for row in versions(f"p{k}", 90 + k, 30)], BLOCK)
    assert as_rows(staged_pairs(blocks)) == as_rows(V.match_blocks(blocks))


def test_children_meet_level_after_level(spark):
    """Renamed parents, whose renamed children pair under them and nowhere else."""
    rows = []
    for side, names in (("old", "abcdef"), ("new", "uvwxyz")):
        up = ""
        for i, n in enumerate(names):
            rows.append(("p", side, i, f"class:{n}:{i}", "class", n, up, i, 100 - i, "class body of some length " + "inner " * (6 - i)))
            up = rows[-1][3]
    got = as_rows(staged_pairs(spark.createDataFrame(rows, BLOCK)))
    assert [(s, a, b) for _, s, a, b, *_ in got] == [("3a", 0, 0)] + [("3b", i, i) for i in range(1, 6)]


def test_identities_that_repeat(spark):
    """Of equal names the bodies decide, a block more on one side stays alone, and equal totals go to the first."""
    rows = [("p", "old", i, f"function:f:{i}", "function", "f", "", i, i + 1, t) for i, t in enumerate(["alpha()", "beta()", "beta()"])]
    rows += [("p", "new", i, f"function:f:{i}", "function", "f", "", i, i + 1, t) for i, t in enumerate(["beta()", "alpha()"])]
    got = as_rows(staged_pairs(spark.createDataFrame(rows, BLOCK)))
    assert [r[1:4] for r in got] == [("1", 0, 1), ("1", 1, 0), ("removed", 2, -1)]


def test_stages_of_odd_rows(spark):
    """Nulls in any column, other columns, a ring of parents, and no rows."""
    rows = versions("p", 3)
    odd = [(None, "old", 1, "function:f:1", "function", "f", "", 0, 1, "x"), ("p", None, 1, "function:f:1", "function", "f", "", 0, 1, "x"), ("p", "old", None, "q", "function", "f", "", 0, 1, "x"), ("p", "new", 77, None, "function", "f", "", 0, 1, "x")]
    blank = [("q", s, 0, "unknown::0", None, None, None, 0, 1, None) for s in ("old", "new")]
    ring = [("r", s, i, f"class:{n}:{i}", "class", n, f"class:{m}:{1 - i}", i, 9, "text") for s in ("old", "new") for i, (n, m) in enumerate(("ab", "ba"))]
    blocks = spark.createDataFrame(rows + odd + blank + ring, BLOCK).selectExpr("*", "'x' AS __n", "1 AS under", "'y' AS similarity")
    got = as_rows(staged_pairs(blocks))
    assert [r for r in got if r[0] == "p"] == as_rows(V.match_blocks(spark.createDataFrame(rows, BLOCK)))
    assert [r[:4] for r in got if r[0] == "q"] == [("q", "added", -1, 0), ("q", "removed", 0, -1)]
    assert [r[:4] for r in got if r[0] == "r"] == [("r", "1", 0, 0), ("r", "1", 1, 1)]
    assert staged_pairs(spark.createDataFrame([], BLOCK)).count() == 0
    with Scratch(spark) as scratch:
        kept = scratch.keep(blocks, "kept")
        path = scratch.paths[0]
        assert kept.count() == blocks.count()
    assert not spark._jvm.java.io.File(path.removeprefix("file:")).exists()


def copies(spark, n, seed):
    """Blocks of two groups, most of them copies of others."""
    r = random.Random(seed)
    some = some_blocks(7, seed)
    return [(r.choice("xy"), seed * 1000 + i, *r.choice(some)) for i in range(n)]


@pytest.mark.parametrize("members", [2, 1024])
def test_copies_are_compared_once_and_all_paired(spark, monkeypatch, members):
    monkeypatch.setattr(S, "MEMBERS", members)
    old, new = copies(spark, 60, 3), copies(spark, 50, 4)
    new += [(g, i + 5000, *block) for g, i, *block in old[:20]]
    frames = [spark.createDataFrame([(g, i, k, n.decode(), b.decode()) for g, i, k, n, b in side], "g string, id long, kind string, name string, body string") for side in (old, new)]
    want = sorted((a[0], a[1], b[1], s) for a in old for b in new if a[0] == b[0] and (s := plain(a[2:], b[2:], 0.5, True)) is not None)
    assert sorted(map(tuple, S.similar_pairs(*frames, ["g"]).collect())) == want
    classes = {(g, *a, *b) for g, i, *a in old for h, j, *b in new if g == h and plain(tuple(a), tuple(b), 0.5, True) is not None}
    assert S._similar_classes(*(S._classed(f, ["g"]) for f in frames), ["g"], 0.5, True).count() == len(classes) < len(want)
    edges = spark.createDataFrame(want, "g string, old_id long, new_id long, similarity double")
    assert sorted(map(tuple, S.assigned_similar(*frames, ["g"]).collect())) == sorted(map(tuple, S.assigned(edges, ["g"], "old_id", "new_id").collect()))


@pytest.mark.parametrize("seed", range(300))
def test_assignment_of_copies_is_that_of_all_pairs(seed):
    r = random.Random(seed)
    m, n = r.randint(1, 5), r.randint(1, 5)
    rows, columns = ([r.randrange(k) for _ in range(r.randint(1, 12))] for k in (m, n))
    values = r.choice([[0.5, 0.6, 1.0], [0.0, 0.5], [0.1 * i for i in range(10)], [0.5, 0.75, 0.625]])
    pairs = {(i, j): r.choice(values) for i in sorted(set(rows)) for j in sorted(set(columns)) if r.random() < 0.7}
    full = [(i, j, pairs[a, b]) for i, a in enumerate(rows) for j, b in enumerate(columns) if (a, b) in pairs]
    assert best_copies([(i, j, s) for (i, j), s in pairs.items()], rows, columns) == best_edges(full)


def test_stages_broadcast_nothing_that_grows(spark):
    """The driver would hold each broadcast side, unpacked; these are small enough for Spark to choose that by itself."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    blocks = V.blocks(spark.createDataFrame([(1, "a.js", "function f() { return 1; }\nfunction g() {}", "a.js", "function h() { return 2; }\nfunction g() {}")], "pair_id long, old_name string, old_src string, new_name string, new_src string"))
    with Scratch(spark) as scratch:
        run = STAGES._Run(scratch, blocks, 0.5)
        run.add(STAGES.best_of_all(run.all.filter("name <> ''"), ["pair_id", "kind", "name", "scope_path"]), "1", "exact_name")
        rest = run.rest()
        for df in (STAGES.nodes(blocks), rest, rest.filter("is_root")):
            assert "Join" in plan(df) and "BroadcastHashJoin" not in plan(df)
        assert sorted(tuple(x) for x in rest.select("side", "name").collect()) == [("new", "h"), ("old", "f")]
