import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from blockloom.llm import resampling


def plain_features(text, order):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return ws, [" ".join(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1)]


def plain(docs, target, order, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x, *_ in docs for f in plain_features(x, order)[1])
    t = Counter(bucket(f) for _, x, *_ in target for f in plain_features(x, order)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    rows = []
    for doc, text, *_ in docs:
        ws, fs = plain_features(text, order)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    place = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=str)


def texts(n):
    r = random.Random(4)
    vocabulary = [f"wort{i}" for i in range(60)] + ["É", "The", "the", "ab-c", "x1", "größe", "日本"]
    return [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 3])
@pytest.mark.parametrize("nodes", [4, 1 << 18])
def test_against_plain_counts(spark, monkeypatch, order, nodes):
    monkeypatch.setattr(resampling, "NODES", nodes)
    odd = [(900, None), (901, ""), (902, " \n-- !"), (903, "a" * 50_000), (904, "mot " * 30_000), (None, "wort1 " * 25), (5, texts(9)[5][1]), (5, texts(9)[5][1]), (6, "the " * 21)]
    docs = [(*d, "x", 1.5) for d in [*texts(150), *odd]]
    target = [(1, "wort1 wort2 the größe"), (2, None), (3, "wort1 wort1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, rank string, score double").repartition(3)
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(frame, goal, order, 97, 20, 40, 7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, order, 97, 20, 40, 7)


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resampling, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    docs = spark.createDataFrame([(i, "one two three") for i in (5, 3, 9, 1, 7)], "doc_id long, text string")
    got = {r.doc_id: r["rank"] for r in resampling.resample(docs, docs, least=1, percent=60).collect()}
    assert got == {1: 1, 3: 2, 5: 3, 7: None, 9: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame(texts(30), "doc_id long, text string")
    none = docs.filter("false")
    assert resampling.resample(none, docs).count() == 0
    assert sorted((tuple(r) for r in resampling.resample(docs, none).collect()), key=str) == plain(texts(30), [], 1, 10_000, 20, 10, 2024)


def test_a_longer_feature_continues_the_state_of_the_shorter():
    trie = resampling.WordTrie(3, 1000)
    assert trie.walk([b"a", b"b", b"c", b"a", b"b"]) == (12, 0)
    below = trie.root
    for word in (b"a", b"b", b"c"):
        below = below[resampling.NEXT][word]
    assert below[resampling.CRC] == zlib.crc32(b"a b c") and below[resampling.COUNT] == 1
    trie.fold()
    assert trie.totals.sum() == 12 and trie.totals[zlib.crc32(b"a b") % 1000] >= 2
