"""The near-copy stage against brute force over all pairs of texts."""

import os
import random

import corpus_pipeline
import pytest
from blockloom.llm import components, resemblance, simhash


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_groups(texts):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_copies(seed=1, groups=12, each=9):
    """Groups of texts with a few words changed, single texts and odd ones."""
    r = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "one two three four five", "one two three four six"]
    for _ in range(groups):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 300))]
        for _ in range(each):
            copy = list(words)
            for _ in range(r.randint(0, len(words) // 18)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("bucket", [1, 64])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(resemblance, "BUCKET", bucket)
    texts = near_copies()
    got = {r.row: r.root for r in resemblance.near_groups(spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")).collect()}
    want = plain_groups(texts)
    assert len(set(want)) < len(texts) - 30
    assert [got[i] for i in range(len(texts))] == want


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Texts that share most of a passage meet in large buckets; without cuts and drawn members, prefixes alone find every link."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(200)]
    texts = [" ".join(passage[: 200 - r.randint(0, 60)] + [f"q{r.randrange(10**6)}" for _ in range(r.randint(0, 50))]) for _ in range(70)]
    monkeypatch.setattr(resemblance, "BUCKET", 1)
    monkeypatch.setattr(resemblance, "SPLITS", 0)
    monkeypatch.setattr(resemblance, "SHARE", 7)
    rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    sets = [plain_shingles(t) for t in texts]
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    keys = spark.createDataFrame([(i, i) for i in range(len(texts))], "row bigint, root bigint")
    found = {(p.x, p.y) for p in resemblance._rarest(keys, rows).collect()}
    assert similar and similar <= found and len(found) < len(texts) * (len(texts) - 1) // 2
    got = {p.row: p.root for p in resemblance.near_groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)


def test_stage_drops_texts_that_differ_in_some_words(spark):
    texts = near_copies(seed=2)
    docs = spark.createDataFrame([(900 - i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, root int")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    last = {g: i for i, g in enumerate(plain_groups(texts))}  # the largest i has the smallest doc_id
    assert kept.columns == docs.columns and {r.root for r in kept.collect()} == set(last.values())
    assert corpus_pipeline.drop_near_copies(spark, docs.filter("false"), "").count() == 0


def test_operator_6_links_the_closest_copies(spark, monkeypatch):
    """The first candidates are those that pigeonring links: the pairs of all fingerprints within its radius, up to components."""
    r, texts = random.Random(8), near_copies(seed=3, groups=6)
    for _ in range(12):
        words = [f"v{r.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(["another"] + words[1:])]
    sets, prints = [frozenset(plain_shingles(t)) for t in texts], [simhash.fingerprint(t) & (2**64 - 1) for t in texts]
    first = [i for i, s in enumerate(sets) if s not in sets[:i]]
    seen, found = [], resemblance._by_fingerprints
    monkeypatch.setattr(resemblance, "_by_fingerprints", lambda heads: seen.append(found(heads)) or seen[-1])
    got = {p.row: p.root for p in resemblance.near_groups(spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)
    pairs = {(p.x, p.y) for p in seen[0].collect()}
    near = {(i, j) for j in first for i in first if i < j and (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS}
    assert any(prints[i] != prints[j] for i, j in near) and any(prints[i] == prints[j] for i, j in near)
    connected = lambda links: {frozenset(g) for g in vertices_together(links)}
    assert pairs <= near and connected(pairs) == connected(near)


def vertices_together(links):
    """Vertices of each component of a set of links."""
    group = {}
    for a, b in links:
        both = group.get(a, {a}) | group.get(b, {b})
        group.update((v, both) for v in both)
    return group.values()


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies that are similar to some of the others only: every link is kept, and far fewer than all pairs are tested."""
    r = random.Random(9)
    template, texts = [f"w{i}" for i in range(150)], []
    for _ in range(320):
        words = list(template)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    tested, links = [], resemblance._links
    monkeypatch.setattr(resemblance, "_links", lambda pairs, heads, rows: tested.append(pairs.count()) or links(pairs, heads, rows))
    got = {p.row: p.root for p in resemblance.near_groups(spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")).collect()}
    want = plain_groups(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(tested) < len(texts) ** 2 // 12


def test_components_leave_one_table(spark, monkeypatch):
    made, path = [], components.scratch_path
    monkeypatch.setattr(components, "scratch_path", lambda *a: made.append(path(*a)) or made[-1])
    got = components.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "x long, y long"), "x", "y")
    assert len(made) > 2 and {r.root for r in got.collect()} == {0} and got.count() == 10
    assert [os.path.exists(p.removeprefix("file:")) for p in made] == [False] * (len(made) - 1) + [True]


def test_scratch_tables_go_as_they_are_used(spark, tmp_path, monkeypatch):
    """Near copies in large groups: when the stage is done, the numbered rows and the rows that go are all that is left of it."""
    import random

    from blockloom.llm import common

    r = random.Random(2)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 8)):
            words[r.randrange(len(words))] = f"v{r.randrange(50)}"
        texts.append((i, " ".join(words)))
    monkeypatch.setattr(resemblance, "BUCKET", 8)
    monkeypatch.setattr(common, "scratch_root", lambda spark: str(tmp_path))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = resemblance.keep_one_of_each(docs).count()
    assert 0 < kept < 150
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert left == ["near-copies", "numbered"]
    size = lambda name: sum(f.stat().st_size for p in tmp_path.glob(f"{name}-*") for f in p.glob("*.parquet"))
    assert size("near-copies") < size("numbered")
