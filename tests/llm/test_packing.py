import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from blockloom.llm import packing as P
from tokenizers import Tokenizer


def plain_best_fit(lengths, capacity):
    """Rooms left by best-fit decreasing, piece after piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    r = random.Random(6)
    for _ in range(200):
        capacity = r.choice([7, 16, 64])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 120))]
        used, spans, ranks = defaultdict(int), defaultdict(list), Counter()
        for length, first, n, seq, per, off in P.plan(dict(Counter(lengths)), capacity):
            for k in range(n):
                s, o = seq + k // per, off + k % per * length
                spans[s].append((o, o + length))
                used[s] += length
                ranks[length, first + k] += 1
        assert set(ranks.values()) <= {1} and len(ranks) == len(lengths)
        assert sorted(capacity - u for u in used.values()) == plain_best_fit(lengths, capacity)
        for found in spans.values():
            found.sort()
            assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:])) and found[-1][1] <= capacity


def test_tree_finds_the_tightest():
    t, r, held = P.CapacityTree(50), random.Random(1), Counter()
    for _ in range(500):
        c = r.randint(1, 50)
        t.add(c, 1)
        held[c] += 1
        need = r.randint(0, 50)
        assert t.tightest(need) == min((x for x in held if x >= need and held[x]), default=None)
        if r.random() < 0.5:
            gone = r.choice([x for x in held if held[x]])
            t.add(gone, -1)
            held[gone] -= 1


def test_documents(spark, tokenizer_path):
    r = random.Random(3)
    texts = [None, "", "word", "a b c"] + [" ".join(r.choices(["alpha", "beta", "gamma"], k=r.randint(1, 400))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5)], "doc_id long, text string, length int").repartition(3)
    tok = Tokenizer.from_file(tokenizer_path)
    capacity = 64
    got = P.pack_documents(docs, tokenizer_path, capacity).collect()
    pieces, fill = defaultdict(list), defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
        fill[x.sequence_id].append((x.offset, x.offset + x.length))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        found = sorted(pieces[i], key=lambda x: (x.piece, x.sequence_id))[:: 2 if i == 3 else 1]
        assert [x.piece for x in found] == list(range(len(found))) and sum(x.length for x in found) == len(ids)
        assert all(x.length == capacity for x in found[1:])
        for x in found:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], dtype="<u4").tobytes())
    for spans in fill.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
    assert len(fill) == len(plain_best_fit([x.length for x in got], capacity))
    assert P.pack_documents(docs.filter("false"), tokenizer_path).count() == 0


def test_pieces_take_one_worker_a_task(spark, tokenizer_path, monkeypatch):
    plans, keep = {}, P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    docs = spark.createDataFrame([(i, "a b c " * (i % 3), i) for i in range(12)], "doc_id long, text string, length int").repartition(3)
    got = P.pack_documents(docs, tokenizer_path, 16)
    assert plans["pieces"].count("MapInArrow") == 1
    rows = got.selectExpr("doc_id", "length AS `a length`", "length").repartition(2)
    again = P.pack(rows, 16)  # rows that don't come from pieces()
    assert again.columns == ["length", "doc_id", "a length", "sequence_id", "offset"]
    assert again.select("sequence_id", "offset").distinct().count() == rows.count()
