import random
import time

import numpy as np
import pytest
from blockloom.kernels import assignment as A
from blockloom.kernels import distance as D
from blockloom.kernels import similar as K
from blockloom.operators import similar as S
from pyspark.sql import functions as F

from .test_similar import plain, some_blocks


def test_distances_of_a_tree_are_those_of_pairs():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab\0\xffc") for _ in range(r.randint(0, 64))) for _ in range(150)] + [bytes(r.choice(b"ab") for _ in range(r.randint(60, 70))) for _ in range(40)]
    texts += [b"", b"a", b"ab", b"ba", b"a" * 64, b"a" * 63 + b"b"]
    close = D.Closeness(texts).of(texts)
    assert all(close[i, j] == D.closeness(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts))
    assert D.Closeness([]).of(texts).shape == (len(texts), 0) and D.Closeness([b""]).of([b"", b"x"]).tolist() == [[0.0], [0.0]]


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.7, 0.95, 1.0])
@pytest.mark.parametrize("named", [True, False])
def test_rows_are_those_of_the_full_table(threshold, named):
    old, new = some_blocks(60, 1), some_blocks(70, 2)
    new += old[:5]
    assert len({len(b[2]) > D.WORD for b in new}) == 2
    want = {i: w for i, a in enumerate(old) if (w := [(j, s) for j, b in enumerate(new) if (s := plain(a, b, threshold, named)) is not None])}
    for keep in (lambda b: True, lambda b: len(b[2]) <= D.WORD, lambda b: len(b[2]) > D.WORD):
        some = [j for j, b in enumerate(new) if keep(b)]
        got = {i: [(some[j], t) for j, t in zip(at.tolist(), s.tolist())] for i, at, s in K.similar_rows(old, [new[j] for j in some], threshold, named)}
        assert got == {i: w for i, row in want.items() if (w := [(j, s) for j, s in row if j in set(some)])}
    assert list(K.similar_rows([], new, threshold, named)) == list(K.similar_rows(old, [], threshold, named)) == []


def test_short_bodies_that_all_differ_take_little_time():
    """2,000 by 2,000 blocks of one group, no two alike: pair by pair that takes more than 20 seconds."""
    r = random.Random(3)
    made = lambda: [("function", f"brand{r.randrange(25)}".encode(), f"{r.choice(['red', 'blue', 'old'])} bolt of {r.choice(['LARGE', 'PROMO'])} {i}".encode()) for i in range(2000)]
    began = time.process_time()
    assert sum(len(at) for _, at, _ in K.similar_rows(made(), made(), 0.5)) > 1_000_000
    assert time.process_time() - began < 10


def test_pairs_are_rounded_as_spark_rounds(spark):
    r = random.Random(2)
    x = [r.random() for _ in range(500)] + [0.5 + k / 2000 for k in range(100)] + [k / 64 for k in range(64)] + [0.0, 1.0]
    for digits in (2, 3, 9):
        want = [row[0] for row in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(F.round("x", digits)).collect()]
        assert S._rounded(np.array(x), digits).tolist() == want


def test_pairs_of_copies_over_batches(spark, monkeypatch):
    """Batches, shares and classes of few rows; ids that aren't numbers."""
    monkeypatch.setattr(S, "_BATCH", 7)
    monkeypatch.setattr(S, "SHARE", 5)
    monkeypatch.setattr(S, "MEMBERS", 3)
    some = some_blocks(6, 8)
    r = random.Random(4)
    old, new = ([(r.choice("xy"), f"{s}{i}", *r.choice(some)) for i in range(40)] for s in "on")
    frames = [spark.createDataFrame([(g, i, k, n.decode(), b.decode()) for g, i, k, n, b in side], "g string, id string, kind string, name string, body string") for side in (old, new)]
    want = sorted((a[0], a[1], b[1], s) for a in old for b in new if a[0] == b[0] and (s := plain(a[2:], b[2:], 0.5, True)) is not None)
    assert sorted(map(tuple, S.similar_pairs(*frames, ["g"]).collect())) == want


def test_classes_that_all_differ_are_assigned_in_little_time():
    """700 by 700 classes with most pairs allowed, in the same pairs as by single rows; before, each search kept all of them."""
    r = random.Random(6)
    near = {i: (np.arange(700, dtype=np.int32), np.array([r.choice([0.5, 0.6, 0.75, 0.8]) for _ in range(700)])) for i in range(700)}
    pushed = []
    push = A.heapq.heappush
    A.heapq.heappush = lambda heap, x: pushed.append(1) or push(heap, x)
    try:
        got = A.best_of_classes(near, range(700), range(700))
    finally:
        A.heapq.heappush = push
    assert got == A.best_edges((i, j, s) for i, (at, of) in near.items() for j, s in zip(at.tolist(), of.tolist()))
    assert len(pushed) < 700 * 700


def test_assignment_shuffles_no_pairs(spark):
    """Pairs of classes are found where they are assigned: the plan has one step of Python."""
    rows = [("x", i, k, n.decode(), b.decode()) for i, (k, n, b) in enumerate(some_blocks(30, 5))]
    frame = spark.createDataFrame(rows, "g string, id long, kind string, name string, body string")
    pairs = S.assigned_similar(frame, frame, ["g"])
    assert pairs._jdf.queryExecution().executedPlan().toString().count("InArrow") == 1
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, S.assigned(S.similar_pairs(frame, frame, ["g"]), ["g"], "old_id", "new_id").collect()))
