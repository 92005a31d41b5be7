"""Quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. Its features describe the line (shares of
capitals, symbols, digits, exclamation marks, repeated words, ...) and its two neighbours. The
field adds weights for neighbouring labels; forward-backward gives each line's marginal
probability of being good, and the mean of these, weighted by line length, is the quality of
the document. A logistic curve over its log odds, fitted on the training sample, turns that
mean into a probability.

Learning uses a bounded sample of labelled rows: SAMPLE documents, cut whole into blocks of
BLOCK_LINES lines, of which at most BLOCKS, from all places, are drawn by hash. Lines have no
labels of their own: a good document says that its lines are good, a bad one that not all are.
Scoring reads every line of every text; features come from whole-array operations over the
bytes of many texts at once.

Defined results: a null or empty text is one empty line; without usable labels every score is
0.5; repeated rows are scored each, and rows of one doc_id train as one text, the largest; an
empty table gives no rows; very long texts are scored line by line with memory in proportion to
their own length; other columns may have any names, those of the result included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_batches, text_filter, text_slices
from .toxicity import fit_logistic

#: Labelled documents of the training sample at most; their texts are cut into blocks of lines, of which BLOCKS at most are drawn by hash.
SAMPLE, BLOCKS, BLOCK_LINES = 3_000, 4_000, 64
#: Weight, beside the hidden labels, of giving every line its document's label.
TRUST = 0.25
#: Fixed: characters that count as symbols.
SYMBOLS = b"#*$%&|<>~^=_{}[]\\@"
#: Bytes of text whose arrays are held at once (about forty bytes of arrays for each byte of text).
SLICE = 1 << 20
OWN = 9
WIDTH = 3 * OWN + 3

_LETTER, _UPPER, _SYMBOL, _DIGIT, _MARK, _SPACE = (1 << i for i in range(6))


def _classes() -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128:
            t[b] |= _LETTER
        if 65 <= b <= 90:
            t[b] |= _UPPER
        if b in SYMBOLS:
            t[b] |= _SYMBOL
        if 48 <= b <= 57:
            t[b] |= _DIGIT
        if b in b"!?":
            t[b] |= _MARK
        if b in b" \t\r\x0b\x0c":
            t[b] |= _SPACE
    return t


_CLASS = _classes()
_CODE = np.random.default_rng(7).integers(1, 1 << 40, size=256)


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[first:end] per pair."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[end] - c[first]


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, number of lines of each text)."""
    text = pc.fill_null(text, "")
    data = np.frombuffer(b"\n".join(x.encode() for x in text.to_pylist()) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    per_text = pc.add(pc.count_substring(text, "\n"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = _CLASS[data]
    size = (ends - starts).astype(np.float64)
    count = lambda bit: _sums((kind & bit) != 0, starts, ends).astype(np.float64)
    letters = np.maximum(count(_LETTER), 1)
    high = np.zeros(len(data), dtype=bool)  # two-byte capitals of Latin-1, as in É
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = count(_UPPER) + 2 * _sums(high, starts, ends)

    gap = ((kind & _SPACE) != 0) | (data == 10)
    begin = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    stop = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
    line_of = np.searchsorted(ends, begin)
    code = _sums(_CODE[data | 32 * ((kind & _UPPER) != 0).astype(np.uint8)], begin, stop)
    again = np.zeros(len(begin), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & (line_of[1:] == line_of[:-1])
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float64)
    repeats = np.bincount(line_of[again], minlength=len(ends)).astype(np.float64)

    full = np.maximum(size, 1)
    own = np.stack(
        [
            np.log1p(size) / 5,
            upper / letters,
            np.minimum(count(_SYMBOL) / full * 8, 2),
            np.minimum(count(_MARK) / full * 8, 2),
            count(_DIGIT) / full,
            count(_LETTER) / full,
            repeats / np.maximum(words, 1),
            np.minimum(size / np.maximum(words, 1), 40) / 10,
            (size == 0).astype(np.float64),
        ],
        axis=1,
    )
    lines = len(ends)
    last = np.cumsum(per_text) - 1
    first = last - per_text + 1
    x = np.zeros((lines, WIDTH), dtype=np.float32)
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[first, OWN : 2 * OWN] = 0
    x[last, 2 * OWN : 3 * OWN] = 0
    x[first, 3 * OWN] = 1
    x[last, 3 * OWN + 1] = 1
    x[:, 3 * OWN + 2] = 1
    return x, size, per_text


@dataclass
class Field:
    """Weights of the good label's emission, log weights of label pairs (bad, good), and the logistic curve."""

    emission: np.ndarray
    pairs: np.ndarray
    curve: tuple[float, float] = (0.0, 0.0)

    def marginals(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """P(good) of every line. Texts are sorted by lines and run side by side, padded to a power of two."""
        score = x @ self.emission
        first = np.cumsum(per_text) - per_text
        out = np.empty(len(x))
        shape = np.ceil(np.log2(np.maximum(per_text, 1))).astype(int)
        for s in np.unique(shape):
            rows = np.flatnonzero(shape == s)
            for part in np.array_split(rows, max(1, (len(rows) << int(s)) // 2_000_000)):
                t = int(per_text[part].max())
                at = first[part][:, None] + np.arange(t)
                valid = np.arange(t) < per_text[part][:, None]
                p, _ = forward_backward(np.where(valid, score[np.minimum(at, len(x) - 1)], 0.0), valid, self.pairs)
                out[at[valid]] = p[valid]
        return out

    def quality(self, text: pa.Array) -> np.ndarray:
        """Mean marginal of each text, weighted by line length."""
        x, size, per_text = line_features(text)
        weight = np.maximum(size, 1)
        text_of = np.repeat(np.arange(len(per_text)), per_text)
        good = np.bincount(text_of, weights=weight * self.marginals(x, per_text), minlength=len(per_text))
        return good / np.bincount(text_of, weights=weight, minlength=len(per_text))

    def score(self, text: pa.Array) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * log_odds(self.quality(text))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _pass(score: np.ndarray, valid: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line (texts x lines), the expected label pairs of each text (texts x 2 x 2), and log P(all lines good)."""
    n, t = score.shape
    shifted = np.clip(score, -30, 30)
    e = np.stack([np.ones((n, t)), np.exp(shifted)], axis=2)
    e /= e.sum(axis=2, keepdims=True)
    step = np.exp(pairs)
    ahead = np.empty((n, t, 2))
    ahead[:, 0] = e[:, 0]
    for i in range(1, t):
        a = (ahead[:, i - 1] @ step) * e[:, i]
        a /= a.sum(axis=1, keepdims=True)
        ahead[:, i] = np.where(valid[:, i, None], a, ahead[:, i - 1])
    back = np.ones((n, 2))
    p, both, log_good = np.empty((n, t)), np.zeros((n, 2, 2)), np.zeros(n)
    for i in range(t - 1, -1, -1):
        m = ahead[:, i] * back
        p[:, i] = m[:, 1] / m.sum(axis=1)
        if i:
            v = valid[:, i]
            arrive = e[:, i] * back
            joint = ahead[:, i - 1][:, :, None] * step * arrive[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            both += np.where(v[:, None, None], joint, 0.0)
            # P(all good) is P(first good) times P(next good | this one good) of every line.
            log_good += np.where(v, np.log(np.maximum(joint[:, 1, 1], 1e-300)) - np.log(np.maximum(joint[:, 1].sum(axis=1), 1e-300)), 0.0)
            b = arrive @ step.T
            back = np.where(v[:, None], b / b.sum(axis=1, keepdims=True), back)
    return p, both, log_good + np.log(np.maximum(p[:, 0], 1e-300))


def forward_backward(score: np.ndarray, valid: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line (texts x lines) and the expected label pairs (2 x 2) summed over all texts."""
    p, both, _ = _pass(score, valid, pairs)
    return p, both.sum(axis=0)


def fit_field(blocks: list[np.ndarray], labels: np.ndarray, docs: list | None = None, rounds: int = 100, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam, in two phases of `rounds`.

    The labels of lines are hidden; only documents have one. In the first phase each line carries
    its document's. In the second a good document says that all of its lines are good, a bad one
    only that not all of them are, so that bad documents may hold good lines and steps between the
    two labels are learned; the first phase's aim keeps the weight TRUST. docs names the document of each block (one each if left out).
    """
    t = max(len(b) for b in blocks)
    x = np.zeros((len(blocks), t, WIDTH))
    valid = np.zeros((len(blocks), t), dtype=bool)
    for i, b in enumerate(blocks):
        x[i, : len(b)] = b
        valid[i, : len(b)] = True
    doc_of = np.unique(np.arange(len(blocks)) if docs is None else np.array(docs), return_inverse=True)[1]
    y = np.repeat(labels[:, None], t, axis=1)
    steps = valid.sum(axis=1) - 1
    seen = np.zeros((len(blocks), 2, 2))
    seen[np.arange(len(blocks)), labels, labels] = steps
    all_good = np.zeros_like(seen)
    all_good[:, 1, 1] = steps
    total = valid.sum()
    w = np.zeros(WIDTH + 4)
    for phase in (0, 1):
        m, v = np.zeros_like(w), np.zeros_like(w)
        for i in range(1, rounds + 1):
            p, both, log_good = _pass(x @ w[:WIDTH], valid, w[WIDTH:].reshape(2, 2))
            if phase:
                # d log(1 - P) = -P / (1 - P) d log P, P being that all lines of the document are good
                good = np.exp(np.minimum(np.bincount(doc_of, weights=log_good), -1e-3))[doc_of]
                share = (1 - TRUST) * np.where(labels == 1, 1.0, -np.minimum(good / (1 - good), 20.0))
                d_line = TRUST * (p - y) + (p - 1.0) * share[:, None]
                d_pair = TRUST * (both - seen) + (both - all_good) * share[:, None, None]
            else:
                d_line, d_pair = p - y, both - seen
            g = np.concatenate((np.einsum("ntk,nt->k", x, np.where(valid, d_line, 0.0)), d_pair.sum(axis=0).ravel())) / total + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - (rate / (1 + 4 * phase)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Field(w[:WIDTH].astype(np.float32), w[WIDTH:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 4, held_out: int = 2) -> Field:
    """Fit on labelled rows outside the held-out fold; of those, a sample of at most SAMPLE documents."""
    usable = labels.filter(F.col(column).isNotNull() & (fold("doc_id", folds) >= 0) & (fold("doc_id", folds) != held_out))
    usable = usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    drawn = F.broadcast(bounded_sample(usable, "doc_id", SAMPLE))  # at most SAMPLE rows of two numbers
    sample = docs.select("doc_id", "text").join(drawn, "doc_id")
    sample = sample.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))  # SAMPLE texts at most

    def blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(b, limit=SLICE):
            x, _, per_text = line_features(part.column("text"))
            out, row, first = [], [], 0
            for i, n in enumerate(per_text.tolist()):
                for at in range(first, first + n, BLOCK_LINES):
                    out.append(x[at : min(first + n, at + BLOCK_LINES)].tobytes())
                    row.append(i)
                first += n
            of = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc").take(of), part.column("label").take(of), pa.array(out, pa.binary())], names=["doc", "label", "block"])

    as_number = sample.select(F.xxhash64(F.col("doc_id").cast("string")).alias("doc"), "text", "label")
    made = map_batches(as_number, blocks, "doc bigint, label int, block binary")
    rows = made.orderBy(F.xxhash64("doc", "block"), "doc", "block").limit(BLOCKS).collect()
    y = np.array([r["label"] for r in rows], dtype=int)
    if len(rows) == 0 or y.min() == y.max():
        return Field(np.zeros(WIDTH, dtype=np.float32), np.zeros((2, 2)))
    field = fit_field([np.frombuffer(r["block"], dtype=np.float32).reshape(-1, WIDTH) for r in rows], y, [r["doc"] for r in rows])

    def means(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(b, limit=SLICE):
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(field.quality(part.column("text")), pa.float64())], names=["label", "q"])

    got = map_batches(sample.select("text", "label"), means, "label int, q double").orderBy("q", "label").collect()  # SAMPLE rows of two numbers at most
    q = log_odds(np.array([r["q"] for r in got]))
    field.curve = tuple(fit_logistic(np.stack([np.ones(len(q)), q], axis=1), np.array([float(r["label"]) for r in got]), l2=1e-5).tolist())
    return field


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    field = learn(docs, labels)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(b, limit=SLICE):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(field.score(part.column("text")), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_batches(docs.select("doc_id", "text"), batch, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score below the threshold; all columns are kept."""
    field = learn(docs, labels)
    return text_filter(docs, lambda text: pa.array(field.score(text) >= threshold), SLICE)
