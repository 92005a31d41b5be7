import random

import numpy as np
import pytest
import xxhash
from blockloom.llm import simhash
from blockloom.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(values):
    """doc -> smallest doc reachable, by comparing every pair."""
    docs = list(values)
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[:i]:
            if bin((values[a] ^ values[b]) & (2**64 - 1)).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = {d: plain_fingerprint(t) for d, t, *_ in rows}
    comp = plain_components(want)
    assert got == {d: (f"{want[d]:016x}", comp[d]) for d in want}


def test_texts_of_every_kind(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "The", "THE"]
    long = [r.choice(words) for _ in range(3000)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c"), (8, "a b c a b c")]
    rows += [(10 + i, " ".join(long[: 3000 - i])) for i in range(12)]
    rows += [(100 + i, " ".join(r.choices(words, k=r.randint(1, 60)))) for i in range(60)]
    check(spark, [(d, t, "x", 7) for d, t in rows])


def test_large_bucket_is_linked_as_pairs_would(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = int(r.integers(0, 2**63))
    values = {base}
    for _ in range(150):
        v = base
        for b in r.choice(64, size=int(r.integers(1, 6)), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values |= {int(x) for x in r.integers(0, 2**63, size=200)}
    values = sorted(simhash._signed(v & (2**64 - 1)) for v in values)
    want = plain_components({v: v for v in values})
    for bucket in (1, 64, 10**6):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
        got = {v: v for v in values} | {x.vertex: x.root for x in components(found, "x", "y").collect()}
        assert got == want


def test_repeated_rows_and_empty_tables(spark):
    rows = [(3, "a b c d", None), (3, "a b c d", None), (None, "a b c d", 1), (4, "other words are here", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert simhash.near_duplicates(docs).count() == 4
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "fp"] and kept.count() == 2
    empty = docs.filter("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 9)], [(i, i + 1) for i in range(60)]])
def test_components(spark, edges):
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: r for v, r in root.items() if v in linked}
