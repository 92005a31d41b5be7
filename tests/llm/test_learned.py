"""Toxicity, quality, language and language-model operators: kernels against plain versions, queries on odd rows."""

import itertools
import math
import random
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from blockloom.llm import attention, langid, lm, quality, toxicity

from .conftest import prose


def within_one(a, b):
    """Whether one insert, delete, replace or swap of neighbours makes a into b."""
    if a == b:
        return True
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))}
    for i, c in itertools.product(range(len(a) + 1), "abcdex"):
        edits |= {a[:i] + c + a[i:], a[:i] + c + a[i + 1 :]}
    edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in edits


def test_automaton_against_all_edits():
    r = random.Random(3)
    terms, stems = ["abcde", "bbaca", "dead"], ["cabb"]
    lexicon = toxicity.Lexicon(terms, stems)
    words = ["".join(r.choices("abcde", k=r.randint(1, 7))) for _ in range(3000)]
    words += ["abcd", "abcdee", "abxde", "bacde", "abced", "abdce", "dead", "deed", "cabbage", "cabb", "cab", "xabcde"]
    for w in words:
        want = 2 if w in terms or any(w.startswith(s) for s in stems) else int(any(len(t) >= 5 and within_one(t, w) for t in terms))
        assert lexicon.match(w) == want, w


def test_quotation_lowers_the_count():
    s = toxicity.Scorer(toxicity.Lexicon(["scoundrel"], []), [0.0] * 5)
    assert s.features("you scoundrel")[1] > 0 and s.features("you scoundrrel")[2] > 0
    assert s.features('he called him a scoundrel')[3] > 0 and s.features("“scoundrel”")[3] > 0
    assert s.features(None) == s.features("") == [1.0, 0.0, 0.0, 0.0, 0.0]


def check_scores(got, docs, folds, held):
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % folds == held)


def accuracy(got, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None}
    known = [r for r in got if r.doc_id in truth and r.held_out]
    return sum(r.predicted == truth[r.doc_id] for r in known) / len(known)


def test_toxicity(spark, labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).collect()
    check_scores(got, docs, 5, 0)
    assert accuracy(got, labels, "toxic") > 0.95
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    none = labels.filter("false")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.filter("false"), labels).count() == 0


def test_quality(spark, labelled):
    docs, labels = labelled
    got = quality.quality(docs, labels).collect()
    check_scores(got, docs, 4, 2)
    assert accuracy(got, labels, "quality") > 0.95
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert {r.score for r in quality.quality(docs, labels.filter("false")).collect()} == {0.5}
    assert quality.quality(docs.filter("false"), labels).count() == 0


def test_forward_backward_against_all_labellings():
    r = np.random.default_rng(1)
    score, pairs = r.normal(size=(2, 4)), r.normal(size=(2, 2))
    valid = np.array([[True] * 4, [True, True, True, False]])
    p, both = quality.forward_backward(score, valid, pairs)
    total = np.zeros((2, 2))
    for row, n in ((0, 4), (1, 3)):
        weights = {y: math.exp(sum(score[row, i] * y[i] for i in range(n)) + sum(pairs[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        for i in range(n):
            assert p[row, i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for i in range(n - 1):
                total[y[i], y[i + 1]] += w / z
    assert both == pytest.approx(total)


def test_lines_of_mixed_documents():
    """In bad documents that are partly good, the good lines are the likelier good ones; P(all good) against all labellings."""
    r = random.Random(4)
    good = lambda: prose(r, n=12)
    junk = lambda: "$$$ BUY NOW!!! " * r.randint(2, 4)
    texts, bad = [], []
    for i in range(200):
        marks = [bool(i % 2) and r.random() < 0.6 for _ in range(10)]
        texts.append("\n".join((junk if m else good)() for m in marks))
        bad.append(marks)
    labels = np.array([int(not any(m)) for m in bad])
    field = quality.fit_field([quality.line_features(pa.array([t]))[0] for t in texts], labels)
    x, _, per_text = quality.line_features(pa.array(texts))
    p, m = field.marginals(x, per_text), np.array(bad).ravel()
    mixed = np.repeat(labels == 0, 10)
    assert p[mixed & ~m].mean() > 5 * p[m].mean() and p[~mixed].mean() > 0.9
    assert np.isfinite(field.pairs).all() and field.pairs[0, 1] > -2.5
    log_good = quality._pass(np.array([[0.3, -0.2, 0.1]]), np.ones((1, 3), dtype=bool), np.array([[0.4, 0.1], [-0.3, 0.2]]))[2]
    score, pairs = [0.3, -0.2, 0.1], [[0.4, 0.1], [-0.3, 0.2]]
    weights = {y: math.exp(sum(a * b for a, b in zip(score, y)) + pairs[y[0]][y[1]] + pairs[y[1]][y[2]]) for y in itertools.product((0, 1), repeat=3)}
    assert log_good[0] == pytest.approx(math.log(weights[1, 1, 1] / sum(weights.values())))


def test_line_features_against_plain_counts():
    x, size, per_text = quality.line_features(pa.array(["Ab CD ab!\n\nword word 12 $", None, "É"]))
    assert per_text.tolist() == [3, 1, 1] and size.tolist() == [9, 0, 14, 0, 2]
    assert x[0, 1] == pytest.approx(3 / 6) and x[0, 3] == pytest.approx(min(1 / 9 * 8, 2)) and x[1, 8] == 1
    assert x[2, 6] == pytest.approx(1 / 4) and x[2, 4] == pytest.approx(2 / 14) and x[2, 2] == pytest.approx(1 / 14 * 8)
    assert x[1, quality.OWN : 2 * quality.OWN] == pytest.approx(x[0, : quality.OWN]) and (x[0, quality.OWN : 2 * quality.OWN] == 0).all()
    field = quality.Field(np.zeros(quality.WIDTH, dtype=np.float32), np.zeros((2, 2)))
    field.marginals = lambda x, per_text: np.array([1.0, 0.0, 0.5, 0.25, 0.75])
    assert field.quality(pa.array(["Ab CD ab!\n\nword word 12 $", None, "É"])) == pytest.approx([(9 * 1 + 1 * 0 + 14 * 0.5) / 24, 0.25, 0.75])


def test_masked_words_and_open_quotes():
    s = toxicity.Scorer(toxicity.Lexicon(["scoundrel", "scum"], [], ["scum"]), [0.0] * 5)
    for text in ("you sc0undrel", "you sc*undrel", "you scoundre1s scoundr3l", "5 s0undrel sc0undr3l"):
        assert s.features(text)[2] > 0, text
    assert s.features("room 12 a1b2 covid19x")[1:] == [0.0, 0.0, 0.0, 0.0]
    assert s.features('he is 6" tall\nyou scoundrel')[1] > 0 and s.features('the "scoundrel" of the play')[3] > 0


def test_language_kernel_against_sets_and_an_explicit_ridge():
    """Shared n-grams over the geometric mean of the sets' sizes, and the dual ridge over the landmarks, written out."""
    r = random.Random(7)
    texts = [prose(r, lang, 8) for lang in ("en", "de") * 6]
    langs = ["en", "de"] * 6
    slots = lambda t: set(np.flatnonzero(langid.presence([t])[0][0]).tolist())
    pieces = lambda t: {c[i : i + n] for c in ["".join(x if x.isalpha() else " " for x in t.lower())] for n in (1, 2, 3) for i in range(len(c) - n + 1)}
    assert all(len(pieces(t)) * 0.97 <= len(slots(t)) <= len(pieces(t)) for t in texts)
    kernel = lambda a, b: len(slots(a) & slots(b)) / math.sqrt(len(slots(a)) * len(slots(b)))
    model = langid.fit([np.packbits(langid.presence([t])[0][0].astype(bool)).tobytes() for t in texts], langs)
    k = np.array([[kernel(a, b) for b in texts] for a in texts])  # every text is a landmark here
    weight = np.full(len(texts), 1 / 6)
    target = np.array([[x == n for n in model.languages] for x in langs], dtype=float)
    dual = np.linalg.solve(k @ np.diag(weight) @ k + langid.RIDGE * k, k @ np.diag(weight) @ target)
    asked = [prose(r, "en", 5), prose(r, "de", 5), "und the"]
    want = np.array([[kernel(a, b) for b in texts] for a in asked]) @ dual
    names, scores = model.predict(asked)
    assert names == [model.languages[i] for i in want.argmax(axis=1)]
    assert scores == pytest.approx(np.clip(want.max(axis=1), 0, 1), abs=2e-3)


def test_marginals_do_not_depend_on_the_other_texts():
    texts = ["one line", "A\nB!!\n$$$ x\n\nlong line of words here", "", "x\n" * 70]
    r = np.random.default_rng(0)
    f = quality.Field(r.normal(size=quality.WIDTH).astype(np.float32), r.normal(size=(2, 2)))
    together = f.quality(pa.array(texts))
    assert together == pytest.approx(np.concatenate([f.quality(pa.array([t])) for t in texts]))


def test_language(spark, labelled):
    docs, _ = labelled
    got = langid.language(docs).collect()
    check_scores(got, docs, 4, 2)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and (r.doc_id or 0) < 1000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == by[1002] == by[1004] == ("und", 0.0)
    assert langid.language(docs.filter("false")).count() == 0
    assert {r.lang_pred for r in langid.language(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_kernel_presence_in_pieces(monkeypatch):
    text = prose(random.Random(1), "de")
    whole = langid.presence([text])[0]
    monkeypatch.setattr(langid, "LETTERS", 7)
    assert (langid.presence([text])[0] == whole).all()


def test_gradient_against_differences():
    r = np.random.default_rng(0)
    flat = attention.start(np.ones(attention.SLOTS)).astype(np.float64)
    x, y = r.integers(0, attention.SLOTS, (2, 3, attention.T))
    mask = r.random((3, attention.T)) < 0.8
    g = attention.gradient(attention.unpack(flat), x, y, mask)[1]
    for i in np.concatenate([np.argsort(-np.abs(g))[:12], r.integers(0, attention.SIZE, 8)]):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        f = lambda p: attention.gradient(attention.unpack(p), x, y, mask)[0]
        assert g[i] == pytest.approx((f(flat + step) - f(flat - step)) / 2e-5, abs=1e-4)


@pytest.mark.parametrize("n", [2, 5, attention.T + 1, attention.T + 2, 200])
def test_every_target_is_scored_once(n):
    ids = np.arange(n)
    x, y, m = attention.windows(ids)
    assert sorted(y[m].tolist()) == list(range(1, n)) and (y[m] - x[m] == 1).all()


def test_fast_scores_are_the_plain_softmax():
    r = np.random.default_rng(2)
    flat = attention.start(np.arange(attention.SLOTS))
    x, y, m = attention.windows(r.integers(0, attention.SLOTS, 120))
    p = attention.unpack(flat)
    state = attention.forward(p, x)[0][m]
    want = []
    for h, slot in zip(state, y[m]):
        g = slot // attention.MEMBERS
        a, b = h @ p["gw"] + p["gb"], h @ p["mw"][g] + p["mb"][g]
        want.append(a[g] - np.log(np.exp(a).sum()) + b[slot % attention.MEMBERS] - np.log(np.exp(b).sum()))
    assert attention.log_probs(attention.prepare(flat), x, y, m) == pytest.approx(np.array(want), abs=1e-4)


@pytest.mark.parametrize("scale", [1, 30])
def test_scores_stay_finite_and_agree_with_training(scale):
    """Parameters thirty times as large give logits far outside the range of exp."""
    flat = attention.start(np.arange(attention.SLOTS)) * np.float32(scale)
    x, y, m = attention.windows(np.random.default_rng(6).integers(0, attention.SLOTS, 300))
    got = attention.log_probs(attention.prepare(flat), x, y, m)
    loss, _ = attention.gradient(attention.unpack(flat), x, y, m)
    assert np.isfinite(got).all() and (got < 1e-3 * scale).all()
    assert -got.mean() == pytest.approx(loss, rel=1e-3)


def test_score_of_a_text_against_a_plain_softmax(tokenizer_path):
    """Whole texts, id by id, with the context that windows give; the probabilities of all next ids sum to 1."""
    rd = lm.reader(tokenizer_path)
    texts = ["", "The one and the other, the1 the.", "some words " * 40, "unmet ids: zyx"]
    met = Counter(i for t in texts[:3] for i in np.frombuffer(rd.ids(t), dtype="<u4").tolist())
    table = lm.Table(dict(met), rd.codec.bytes_of, 50256)
    flat = attention.start(table.counts, seed=3)
    p, groups = attention.unpack(flat), math.isqrt(len(table.counts))

    def next_ids(before):
        """Log probability of every slot after these inputs, written out."""
        h = [p["e"][i] + p["pos"][k] for k, i in enumerate(before)]
        q, ks, vs = h[-1] @ p["q"], [x @ p["k"] for x in h], [x @ p["v"] for x in h]
        w = np.exp([q @ k / math.sqrt(attention.D) for k in ks])
        state = h[-1] + sum(a * v for a, v in zip(w / w.sum(), vs)) @ p["o"]
        a = state @ p["gw"] + p["gb"]
        a = a - np.log(np.exp(a).sum())
        inner = [state @ p["mw"][g] + p["mb"][g] for g in range(groups)]
        return np.concatenate([a[g] + z - np.log(np.exp(z).sum()) for g, z in enumerate(inner)])

    got = lm.log_probs([rd.ids(t) for t in texts], table, attention.prepare(flat))
    for t, g in zip(texts, got):
        ids = np.frombuffer(rd.ids(t), dtype="<u4")
        seq, want = table.sequence(rd.ids(t)), 0.0
        for at in range(1, len(seq)):
            first = 0 if at <= attention.T else -(-(at - attention.T) // attention.STRIDE) * attention.STRIDE
            logs = next_ids(seq[first:at])
            want += logs[seq[at]]
            if at < 4:
                every = logs[table.slot[sorted(rd.codec.bytes_of)]] + table.within[sorted(rd.codec.bytes_of)]
                spare = set(range(len(table.counts))) - set(table.slot.tolist())
                assert np.exp(every).sum() + np.exp(logs[sorted(spare)]).sum() == pytest.approx(1, abs=1e-4)
        assert g == pytest.approx(want + table.within[ids].sum(), abs=1e-2)


def test_training_windows_hold_every_target_once():
    for n in (2, 5, attention.T + 1, attention.T + 2, 200):
        x, y, m = attention.training_windows(np.arange(n))
        assert sorted(y[m].tolist()) == list(range(1, n)) and (y[m] - x[m] == 1).all()


def test_language_model(spark, labelled, tokenizer_path, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)  # most words take the way by join
    docs, _ = labelled
    got = lm.score(docs, tokenizer_path, 50256).collect()
    assert len(got) == docs.count()
    words = lambda t: (t or "").encode().lower().split()
    train = [words(r.text) for r in docs.collect() if r.doc_id is not None and crc32(str(r.doc_id).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((len(train) + 1) / (n + v + 1))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        ws = words(text[r.doc_id])
        assert r.n_tokens == len(ws) + 1 and r.n_known == sum(w in c for w in ws) + 1 and r.train_tokens == n
        assert r.base_score == pytest.approx(base(text[r.doc_id])) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.1
    nothing = lm.score(docs.filter("doc_id is null or doc_id = 1000").drop("lang"), tokenizer_path, 50256).collect()
    assert len(nothing) == 2


def test_terms_and_stems_take_misspellings(spark):
    """A stem leaves its terms tolerant; long stems and short terms are tolerant unless clean words come with it."""
    lexicon = toxicity.Lexicon(["idiot", "scum"], ["idio", "wretch"], ["wretch", "scum"])
    for word, want in {"idiotic": 2, "idoit": 1, "idjot": 1, "wretchedly": 2, "wrechedly": 1, "wertches": 1, "scmu": 1, "skum": 1, "scu": 0, "scumm": 0, "idoo": 0}.items():
        assert lexicon.match(word) == want, word
    rows = [(f"you {w} of a man", 1) for w in ("scum", "dolt", "idiot", "idiots", "idiotic") for _ in range(8)]
    rows += [("some bolt and colt here", 0), *[("a kind word to the other", 0)] * 60]
    learned = toxicity.lexicon_of(spark.createDataFrame(rows, "text string, toxic int"))
    for word, want in {"idoit": 1, "idjot": 1, "idiotically": 2, "skum": 1, "dolt": 2, "bolt": 0, "delt": 0}.items():
        assert learned.match(word) == want, word


def test_every_training_text_trains_the_network(spark, tokenizer_path, monkeypatch):
    """Even a corpus of one text moves the network from its starting point."""
    monkeypatch.setattr(lm, "WARM_STEPS", 0)
    for i in range(3):
        docs = spark.createDataFrame([(i, "some words that are all there is")], "doc_id long, text string")
        table, flat = lm.train(docs, {257: 4, 262: 2}, tokenizer_path, 50256)
        assert (flat != attention.start(table.counts)).any()


def test_windows_overlap_by_half():
    assert attention.T >= 32 and attention.T - attention.STRIDE >= attention.T // 2


@pytest.mark.parametrize("met", [1, 3000, 50256])
def test_every_id_in_use_has_its_own_slot(met):
    table = lm.Table({i: met - i + 1 for i in range(met)}, {i: i.to_bytes(2) for i in range(50257)}, 50256)
    used = [*range(met), 50256]
    assert len(set(table.slot[used].tolist())) == len(used) and table.other not in table.slot[used]
    assert (table.slot[met:50256] == table.other).all() and len(attention.start(table.counts)) <= attention.SIZE


def test_first_windows_come_from_all_places(spark, tokenizer_path):
    texts = [(i, " ".join(["alpha"] * 4000 + ["omega"] * 4000)) for i in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rd = lm.reader(tokenizer_path)
    first, last = (np.frombuffer(rd.encode(w), dtype="<u4").tolist() for w in (b"alpha", b"omega"))
    table = lm.Table({i: 16_000 for i in {*first, *last}}, rd.codec.bytes_of, 50256)
    rows = [np.frombuffer(r.cells, dtype="<i4")[: attention.T] for r in lm.drawn_windows(docs, table, tokenizer_path, 400).collect()]
    late = sum(bool(set(x.tolist()) & set(table.slot[last].tolist()) - set(table.slot[first].tolist())) for x in rows)
    assert 300 < len(rows) < 700 and 0.35 < late / len(rows) < 0.75


def test_texts_have_a_draw_for_each_window(tokenizer_path):
    """So a text without a low draw need not be read as ids."""
    r, rd = random.Random(3), lm.reader(tokenizer_path)
    for text in (None, "", " ", "a", "\x00\x01" * 40, "\u00e9\u4e16\U0001f600" * 70, *(" ".join(chr(r.randrange(33, 900)) for _ in range(n)) for n in range(1, 200))):
        table = lm.Table({}, rd.codec.bytes_of, 50256)
        assert len(attention.training_windows(table.sequence(rd.ids(text)))[0]) <= len(lm.draws(7, text))
    assert (lm.draws(7, "ab" * 64)[:4] == np.random.default_rng(crc32(("7 " + "ab" * 64).encode())).random(4)).all()


def test_later_windows_compute_only_what_they_score(monkeypatch):
    r, shapes, sums = np.random.default_rng(4), [], attention._row_sums
    x, y, m = attention.windows(r.integers(0, attention.SLOTS, 10 * attention.T))
    monkeypatch.setattr(attention, "_row_sums", lambda z: shapes.append(z.shape) or sums(z))
    attention.log_probs(attention.prepare(attention.start(np.ones(attention.SLOTS))), x, y, m)
    assert sum(s[0] * s[1] for s in shapes if len(s) == 3) == attention.T + (len(x) - 1) * attention.STRIDE


def test_gradient_copies_no_products():
    """The products by q, k and v are made in place, not beside one another and then joined."""
    r, flat = np.random.default_rng(1), attention.start(np.ones(16))
    x, y = r.integers(0, 16, (2, attention.BATCH, attention.T))
    tracemalloc.start()
    attention.gradient(attention.unpack(flat), x, y, np.ones(x.shape, dtype=bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 17.5 * x.size * attention.D * 4


def test_training_uses_its_memory_again():
    """A second batch takes no arrays of its own for all places: the first one's serve it."""
    r, flat = np.random.default_rng(1), attention.start(np.ones(16))
    x, y = r.integers(0, 16, (2, attention.BATCH, attention.T))
    mask = np.ones(x.shape, dtype=bool)
    _, first = attention.gradient(attention.unpack(flat), x, y, mask)
    kept = first.copy()
    tracemalloc.start()
    attention.gradient(attention.unpack(flat), y, x, mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * x.size * attention.D * 4 and (first == kept).all()


def test_words_in_use_stay_in_memory(tokenizer_path, monkeypatch):
    monkeypatch.setattr(lm, "WORDS_KEPT", 50)
    rd, met = lm.Reader(tokenizer_path), Counter()
    encode = rd.encode
    monkeypatch.setattr(rd, "encode", lambda w: met.update([w]) or encode(w))
    for i in range(600):
        rd.ids(f"the same words and x{i}")
    assert met[b"words"] == 1 and met.total() == 604


def test_coded_texts_hold_their_words_and_draws(spark, tokenizer_path):
    texts = ["", None, "Some\tWORDS\x0b\x1c and\u00a0more\u2028 \U0001f600\x00, e\u0301! 12.5%", " \n", "\u00c4rger a\x85b"]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rd, got = lm.reader(tokenizer_path), lm.coded(docs, tokenizer_path).collect()
    for text, r in zip(texts, got, strict=True):
        ids = lm.unpacked(bytes(r.ids))
        assert ids.astype("<u4").tobytes() == rd.ids(text) and rd.words_of(ids) == rd.words(text)
        assert (lm._draws(r.seed, r["size"]) == lm.draws(r.doc_id, text)).all()


def test_means_of_gradients_end_at_zero():
    """Those of an id that is not met any more would shrink to numbers that processors are slow with, and stay there."""
    trainer = attention.Trainer(attention.start(np.ones(16)), 0.001)
    trainer.m[:], trainer.v[:] = 1e-37, 1e-37
    for _ in range(40):
        trainer.step(*np.zeros((2, 3, attention.T), dtype=int), np.zeros((3, attention.T), dtype=bool))
    assert not trainer.m.any() and not trainer.v.any()


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_sums_of_frequent_and_rare_ids(n):
    r = np.random.default_rng(n)
    ids, rows = np.minimum(r.geometric(0.02, n), 400), r.standard_normal((n, attention.D))
    got, want = np.zeros((2, 401, attention.D))
    attention._sums_by(ids, rows, got)
    np.add.at(want, ids, rows)
    assert got == pytest.approx(want, abs=1e-9)


def test_loss_with_numbers_beyond_the_range_of_exp():
    r = np.random.default_rng(6)
    flat = attention.start(np.ones(16)) * np.float32(60)
    x, y = r.integers(0, 16, (2, 5, attention.T))
    mask = np.ones(x.shape, dtype=bool)
    loss, g = attention.gradient(attention.unpack(flat), x, y, mask)
    want, _ = attention.gradient(attention.unpack(flat.astype(np.float64)), x, y, mask)
    assert np.isfinite(g).all() and loss == pytest.approx(want, rel=1e-3)
    z = np.array([[300.0, -300.0, 10.0], [0.0, -400.0, 1.0]], dtype=np.float32)
    got, d = attention._losses(z.copy(), np.array([1, 2]), 1)
    assert got == pytest.approx(600 + math.log1p(math.exp(-1)), rel=1e-6) and abs(d.sum(axis=1)).max() < 1e-6


def test_rarer_languages_are_learned_too(spark, labelled, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    model = langid.learn(labelled[0])
    assert model.languages == ["de", "en"]
