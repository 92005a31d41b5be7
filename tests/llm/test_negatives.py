import math

import numpy as np
import pytest
from blockloom.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, row int, score string"


def plain(rows, every, positives=5, wanted=5, low=80):
    live = []
    for at, (i, x, label, *_) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        live.append((at, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    order = lambda t: (-t[1], t[0][1] is None, t[0][1] or 0, t[0][0])
    out = []
    for a in live:
        if a[1] is None or a[1] % every:
            continue
        scored = [(b, dot(a[3], b[3])) for b in live if b[0] != a[0]]
        for b, high in sorted((s for s in scored if s[0][2] == a[2]), key=order)[:positives]:
            inside = sorted((s for s in scored if s[0][2] != a[2] and low * high <= 100 * s[1] <= 100 * high), key=order)
            out += [(a[1], b[1], n + 1, c[1], high, s) for n, (c, s) in enumerate(inside[:wanted])]
    return sorted(out, key=str)


def vectors(n, d, seed):
    r = np.random.default_rng(seed)
    made = [(int(i), [float(x) for x in np.round(r.normal(size=d) + (i % 3), 1)], int(i % 4), 1, "s") for i in range(n)]
    return made


def check(spark, rows, monkeypatch, block, chunk=3):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "ANCHORS", 10)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in negatives.hard_negatives(frame).collect()), key=str)
    assert got == plain(rows, 10)


@pytest.mark.parametrize("block", [7, 1000])
def test_tiles_add_up_to_all_pairs(spark, monkeypatch, block):
    check(spark, vectors(120, 10, 1), monkeypatch, block)


def test_odd_rows(spark, monkeypatch):
    rows = vectors(40, 4, 2)
    rows += [(10, None, 1, 1, "s"), (20, [1.0, None, 1.0, 1.0], 1, 1, "s"), (30, [1.0, float("nan"), 1.0, 1.0], 1, 1, "s"), (40, [float("inf")] * 4, 1, 1, "s"), (50, [1.0] * 4, None, 1, "s")]
    rows += [(None, [2.0] * 4, 1, 1, "s"), (None, [2.0] * 4, 2, 1, "s"), (60, [], 3, 1, "s"), (70, [3.0], 1, 1, "s"), (80, [3.0] * 6, 2, 1, "s"), rows[20], rows[20], rows[3], (90, [0.0] * 4, 9, 1, "s"), (100, [-1.0] * 4, 0, 1, "s")]
    check(spark, rows, monkeypatch, 9)


def test_many_ties(spark, monkeypatch):
    check(spark, [(i, [1.0, 1.0], i % 2, 0, "") for i in range(60)], monkeypatch, 8, 1)


def test_large_components_stay_exact(spark, monkeypatch):
    rows = [(i, [float(2**22 + i), float(-(2**22) + 3 * i), 1.5], i % 3, 0, "") for i in range(30)]
    check(spark, rows, monkeypatch, 10, 1)
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1, 0, "")], SCHEMA))


def test_no_anchor_no_row(spark):
    frame = spark.createDataFrame(vectors(30, 4, 3), SCHEMA)
    assert negatives.hard_negatives(frame.filter("false")).count() == 0
    assert negatives.mine(frame, F.col("vec_id") == -1).count() == 0
    assert negatives.hard_negatives(frame.filter("vec_id % 4 = 1")).count() == 0


def test_best_of_a_tile():
    scores = np.array([[5, 7, 7, 1], [0, 0, 0, 0]])
    r, c = negatives._best(scores, np.array([[True, True, True, True], [False, True, False, True]]), 2)
    assert list(zip(r, c)) == [(0, 1), (0, 2), (1, 1), (1, 3)]
