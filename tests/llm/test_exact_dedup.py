import hashlib
import random
from collections import defaultdict

from blockloom.llm import exact_dedup as E


def test_fingerprints_compose_and_match_the_definition():
    r = random.Random(1)
    for n in (0, 1, 5, E.CHUNK - 1, E.CHUNK, E.CHUNK + 1, 5000):
        t = r.randbytes(n)
        want = []
        for base, p in zip(E.BASES, E.PRIMES):
            h = 0
            for b in t:
                h = (h * base + b) % p
            want.append(h)
        assert E.fingerprints([t]) == [tuple(want)]
        cut = n // 3
        a, b = E.fingerprints([t[:cut], t[cut:]])
        assert E.combine(a, b, n - cut) == tuple(want)
    assert E.fingerprints([]) == []


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return sorted((d, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)


def make(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, kept int")


ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "c" * 200_000), (7, "c" * 200_000), (8, "c" * 199_999 + "d"), (9, "a ")] + [(100 + i, "copy") for i in range(150)]


def test_groups(spark):
    got = E.exact_groups(make(spark, ROWS)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain(ROWS)
    assert {r.doc_id for r in got if r.kept} == {r.keep_id for r in got}


def test_collisions_are_settled_by_comparison(spark, monkeypatch):
    """Texts of equal length always collide; comparison still tells them apart."""
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "aa", "d"])]
    fake = lambda df, keep: df.selectExpr(*keep, "length(coalesce(text, '')) * 1L AS n_bytes", "1L AS fp", "sha2(coalesce(text, ''), 256) AS text_sha256")
    monkeypatch.setattr(E, "with_fingerprints", fake)
    got = E.exact_groups(make(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain(rows)


def test_repeated_rows_leave_one_and_columns_stay(spark):
    docs = make(spark, [(3, "x"), (3, "x"), (None, "x"), (4, "y")])
    kept = E.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "x"), (4, "y")]
    assert sum(r.kept for r in E.exact_groups(docs).collect()) == 2
    empty = docs.filter("false")
    assert E.exact_groups(empty).count() == 0 and E.keep_one_of_each(empty).count() == 0


def test_documents_stored_in_parts(spark):
    text = "0123456789" * 500
    parts = spark.createDataFrame([(1, k, text[k * 700 : k * 700 + 700]) for k in range(8)] + [(2, 0, None)], "doc long, part int, text string")
    got = {r.doc: (r.n_bytes, r.fp) for r in E.combine_parts(parts, "doc", "part").collect()}
    (a, b), (c, d) = E.fingerprints([text.encode(), b""])
    assert got == {1: (5000, a << 31 | b), 2: (0, c << 31 | d)}
