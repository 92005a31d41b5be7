"""Language-model scores of whole texts, beside a word-unigram base.

A text is the sequence of its words (cut at ASCII white space, A-Z lower-cased) and an end.
The model reads each word, led by a space, as subword ids. A causal self-attention network
(attention.py) gives the probability of every id from the ids before it; a text's score is the
log10 of the product of its ids' and its end's. The probabilities of all next ids sum to 1: ids
in use have an entry each, and those that training never met share one evenly.

Passes over the corpus:
1. Every text is read as ids once and these are written (coded()); they hold the text's words, led
   by spaces, so that no later pass reads texts.
2. Counts of every word and every subword id over all training texts (partial counts per task,
   then one shuffle by word).
3. Training: a first network is fitted on the driver on windows drawn from all places of all
   training texts (WARM_STEPS * WARM_BATCH at most), which only fixes the starting point. Then
   every task trains a copy on its own training texts, all of them whole, and the copies are
   averaged, weighted by how much each has seen.
4. Scoring: the ids of a text are cut into overlapping windows that score every id once;
   windows of many texts go through masked attention together.

Word counts are needed for the base only. Words at or above a count threshold, chosen so that
there are at most FREQUENT of them, are looked up in a broadcast table of that bounded size; all
other words are joined by word, one row for each text and distinct word. So a word's count is
always its whole count and no vocabulary is collected.

Defined results: a null or empty text is the end alone; a row with a null doc_id is scored but
never learned from; repeated rows are scored each; without training texts every base term is
log10(1) = 0 and the network is at its starting point; words of equal count are on the same side
of the threshold; an empty table gives no rows; other columns may have any names, those of the
result included; very long texts are scored some windows at a time.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from .bpe import library_codec as codec
from .common import fold, latest, map_batches, materialize, scrap, small_batches, text_slices

#: Steps of the driver's first model, and windows of a step.
WARM_STEPS, WARM_BATCH = 500, 64
WARM_RATE, TASK_RATE = 0.01, 0.001
#: Words in the broadcast table at most.
FREQUENT = 1 << 17
#: Partial counts a task holds before it hands them on.
HELD = 400_000
#: Words a worker remembers; those that it last met before are kept for as long again.
WORDS_KEPT = 150_000
#: Windows scored at once, and ids whose windows are made at once.
SCORED, SLICE = 2048, 1 << 18
#: Parameters in one row of the table of models: bounds a batch of such rows.
PIECE = 1 << 14
#: Tasks that average the models.
FOLDS = 8


class Reader:
    """Words of texts and their packed ids; a bounded memory of words."""

    def __init__(self, path: str) -> None:
        self.codec, self.memory, self.before = codec(path), {}, {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only

    def packed(self, words: list[bytes]) -> list[bytes]:
        memory = self.memory
        try:
            return list(map(memory.__getitem__, words))
        except KeyError:
            pass
        if len(memory) > WORDS_KEPT:
            self.before, self.memory = memory, {}
            memory = self.memory
        for w in words:
            if w not in memory:
                memory[w] = self.before.get(w) or self.encode(w)
        return list(map(memory.__getitem__, words))

    def encode(self, word: bytes) -> bytes:
        """Packed ids of one word led by a space."""
        c, text = self.codec, word.decode()
        if text.isalpha():
            return array("I", c.merge(b" " + word)).tobytes()
        if word[-1:] in b".,!" and text[:-1].isalpha():  # letters and one mark are two pre-tokens
            return (self.memory.get(word[:-1]) or array("I", c.merge(b" " + word[:-1])).tobytes()) + array("I", c.merge(word[-1:])).tobytes()
        return array("I", [i for p in c.pattern.findall(" " + text) for i in c.merge(p.encode())]).tobytes()

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.packed(self.words(text)))

    def words_of(self, ids: np.ndarray) -> list[bytes]:
        """The words that ids() read: each is led by a space and holds no other white space of ASCII."""
        return b"".join(map(self.codec.bytes_of.__getitem__, ids.tolist())).split()


@lru_cache(maxsize=2)
def reader(path: str) -> Reader:
    return Reader(path)


def unpacked(cells: bytes) -> np.ndarray:
    """The ids of a coded text."""
    return np.frombuffer(cells[1:], dtype=f"<u{cells[0]}")


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, seed and size of every row of (doc_id, text), with ids as wide as the tokenizer needs, and what draws() takes."""
    if "ids" in docs.columns:
        return docs

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rd = reader(path)
        width = 2 if max(rd.codec.bytes_of) < 1 << 16 else 4
        for p in text_slices(b, limit=1 << 20):
            ids, seeds, sizes = [], [], []
            for doc_id, text in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist()):
                cells = np.frombuffer(rd.ids(text), dtype="<u4").astype(f"<u{width}")
                ids.append(bytes([width]) + cells.tobytes())
                seeds.append(seed(doc_id, text))
                sizes.append(len((text or "").encode()))
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(ids, pa.binary()), pa.array(seeds, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "ids", "seed", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids binary, seed bigint, size bigint")


def counts(training: DataFrame, path: str) -> DataFrame:
    """(kind, token, n): kind 0 words, 1 subword ids, 2 the ends of texts, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rd, words, ends = reader(path), Counter(), 0
        times = np.zeros(max(rd.codec.bytes_of) + 1, dtype=np.int64)

        def rows(found: dict[bytes, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([0] * len(found), pa.int32()), pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "token", "n"]
            )

        for b in batches:
            for cells in b.column("ids").to_pylist():
                ids = unpacked(cells)
                words.update(rd.words_of(ids))
                some = np.bincount(ids)
                times[: len(some)] += some
                ends += 1
                if len(words) >= HELD:
                    yield rows(words)
                    words = Counter()
        if words:
            yield rows(words)
        some = np.flatnonzero(times)
        kinds = [1] * len(some) + [2]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([*map(str, some.tolist()), ""], pa.string()), pa.array([*times[some].tolist(), ends], pa.int64())], names=["kind", "token", "n"])

    small_batches(training.sparkSession)
    parts = coded(training, path).select("ids").mapInArrow(run, "kind int, token string, n bigint")
    return parts.groupBy("kind", "token").agg(F.sum("n").alias("n")).filter("n > 0")


class Table:
    """Slots of the model: one for each subword id that training texts hold, a last one for those they never hold."""

    def __init__(self, id_counts: dict[int, int], bytes_of: dict[int, bytes], end: int) -> None:
        n = dict(id_counts)
        n[end] = n.get(end, 0) + 1
        top = sorted(n, key=lambda i: (bytes_of[i], i))
        slots = (math.isqrt(len(top)) + 1) ** 2  # the least square over len(top)
        self.other, self.end = slots - 1, end
        self.slot = np.full(max(bytes_of) + 1, self.other, dtype=np.int32)
        self.slot[top] = np.arange(len(top))
        rest = [i for i in bytes_of if self.slot[i] == self.other]
        self.within = np.zeros(len(self.slot))
        self.within[rest] = -math.log(max(1, len(rest)))
        self.counts = np.bincount(self.slot[list(n)], weights=list(n.values()), minlength=slots)

    def sequence(self, ids: bytes | np.ndarray) -> np.ndarray:
        """Slots of end, the ids (or packed ids), end."""
        ids = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        out = np.empty(len(ids) + 2, dtype=np.int32)
        out[0] = out[-1] = self.slot[self.end]
        out[1:-1] = self.slot[ids]
        return out


def _batches(sequences: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Full batches of training windows from sequences, then the rest."""
    held: list[tuple] = []
    n = 0
    for s in sequences:
        held.append(A.training_windows(s))
        n += len(held[-1][0])
        if n >= A.BATCH:
            x, y, m = (np.concatenate(c) for c in zip(*held))
            full = n - n % A.BATCH
            for at in range(0, full, A.BATCH):
                yield tuple(c[at : at + A.BATCH] for c in (x, y, m))
            held, n = [tuple(c[full:] for c in (x, y, m))], n - full
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def warm_up(rows: list[np.ndarray], table: Table) -> np.ndarray:
    """The starting point: a model fitted once on the drawn windows (T inputs, T targets and T marks each)."""
    flat = A.start(table.counts)
    if not rows:
        return flat
    x, y, m = np.stack(rows).reshape(-1, 3, A.T).transpose(1, 0, 2)
    trainer, r = A.Trainer(flat, WARM_RATE), np.random.default_rng(5)
    for i in range(WARM_STEPS):
        trainer.rate = WARM_RATE * (1 - 0.9 * i / WARM_STEPS)
        at = r.integers(0, len(x), size=min(WARM_BATCH, len(x)))
        trainer.step(x[at], y[at], m[at].astype(bool))
    return trainer.flat


def seed(doc_id: int | None, text: str | None) -> int:
    return crc32(f"{doc_id} {text}".encode())


def draws(doc_id: int | None, text: str | None) -> np.ndarray:
    """A number from 0 to 1 for each window that a text can have: it has no more ids than bytes, a first space and an end."""
    return _draws(seed(doc_id, text), len((text or "").encode()))


def _draws(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng(seed).random(size // A.T + 2)


def drawn_windows(training: DataFrame, table: Table, path: str, cap: int) -> DataFrame:
    """(at, cells): about cap windows from all places of all texts of (doc_id, text), or of their coded(), drawn by a hash that a rerun repeats."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(table)
    chance = cap / max(1.0, table.counts.sum() / A.T)  # texts have a window for each T ids and at most one more

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for cells, start, size in zip(*(b.column(c) for c in ("ids", "seed", "size"))):
            at = _draws(start.as_py(), size.as_py())
            if at.min() >= chance:
                continue  # no window of this text is drawn, however many it has
            w = A.training_windows(table.sequence(unpacked(cells.as_py())))
            at = at[: len(w[0])]
            mine = np.flatnonzero(at < chance)
            if len(mine):
                drawn = np.stack([c[mine] for c in w], axis=1).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(at[mine]), pa.array([c.tobytes() for c in drawn], pa.binary())], names=["at", "cells"])

    return map_batches(coded(training, path).select("ids", "seed", "size"), run, "at double, cells binary")


def train(training: DataFrame, id_counts: dict[int, int], path: str, end: int) -> tuple[Table, np.ndarray]:
    """The model's table and its averaged parameters."""
    spark, training = training.sparkSession, coded(training, path)
    table = Table(id_counts, codec(path).bytes_of, end)
    cap = WARM_STEPS * WARM_BATCH
    drawn = drawn_windows(training, table, path, cap).orderBy("at", "cells").limit(cap).collect()
    flat = warm_up([np.frombuffer(bytes(r["cells"]), dtype="<i4") for r in drawn], table)
    shared = spark.sparkContext.broadcast((table, flat))  # bounded by the tokenizer's ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, flat), seen = shared.value, 0
        trainer = A.Trainer(flat, TASK_RATE)
        texts = (t for b in batches for t in b.column("ids").to_pylist())
        for x, y, m in _batches(table.sequence(unpacked(t)) for t in texts):
            trainer.step(x, y, m)
            seen += int(m.sum())
        if seen:
            yield rows(seen, trainer.flat)

    def rows(seen: int, flat: np.ndarray) -> pa.RecordBatch:
        """A model as rows of PIECE parameters."""
        cut = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([seen] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["k", "seen", "params"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(shared.value[1])), 0
        for b in batches:
            for k, n, raw in zip(*(b.column(c).to_pylist() for c in ("k", "seen", "params"))):
                piece = np.frombuffer(raw, dtype=np.float32)
                total[k * PIECE : k * PIECE + len(piece)] += n * piece.astype(np.float64)
                seen += n if k == 0 else 0
        if seen:
            yield rows(seen, (total / seen).astype(np.float32))

    schema = "k int, seen bigint, params binary"
    small_batches(spark)
    models = materialize(training.select("ids").mapInArrow(run, schema), "models")
    # Averages of averages: FOLDS tasks fold the models of all others, the driver theirs. Rows of a model stay in one file, but a
    # file may be cut between tasks, so sums are taken by piece.
    means = models.coalesce(FOLDS).mapInArrow(mean, schema).collect()
    if means:
        total, seen = np.zeros(len(flat)), np.zeros(len(flat))
        for r in means:
            piece = np.frombuffer(bytes(r["params"]), dtype=np.float32)
            at = slice(r["k"] * PIECE, r["k"] * PIECE + len(piece))
            total[at] += r["seen"] * piece.astype(np.float64)
            seen[at] += r["seen"]
        flat = (total / np.maximum(seen, 1)).astype(np.float32)
    return table, flat


def log_probs(packed: list[bytes | np.ndarray], table: Table, params: A.Params) -> list[float]:
    """The network's natural log probability of each text, given as its ids or packed ids, with its end."""
    if not packed:
        return []
    texts = [np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids for ids in packed]
    x, y, m = (np.concatenate(p) for p in zip(*(A.windows(table.sequence(ids)) for ids in texts)))
    got = [A.log_probs(params, x[i : i + SCORED], y[i : i + SCORED], m[i : i + SCORED]) for i in range(0, len(x), SCORED)]
    ends = np.cumsum([len(ids) + 1 for ids in texts])
    sums = np.add.reduceat(np.concatenate(got), np.concatenate(([0], ends[:-1])))
    return [s + float(table.within[ids].sum()) for s, ids in zip(sums.tolist(), texts)]


def _slices(texts: list[np.ndarray]) -> Iterator[slice]:
    """Runs of texts of at most SLICE ids together (a longer text alone)."""
    first = total = 0
    for i, ids in enumerate(texts):
        if i > first and total + len(ids) > SLICE:
            yield slice(first, i)
            first, total = i, 0
        total += len(ids)
    if first < len(texts):
        yield slice(first, len(texts))


def score(docs: DataFrame, path: str, end: int, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    src = materialize(coded(docs.select("doc_id", "text"), path), "coded")
    written = latest()
    part = fold("doc_id", folds)
    training = src.filter((part >= 0) & (part != held_out))
    found = materialize(counts(training, path), "counts")
    small = {(r["kind"], r["token"]): r["n"] for r in found.filter("kind > 0").collect()}  # at most one row per id of the tokenizer
    ends = small.pop((2, ""), 0)
    words = found.filter("kind = 0")
    facts = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (facts["n"] or 0) + ends, facts["v"] + int(ends > 0)
    table, flat = train(training, {int(t): n for (_, t), n in small.items()}, path, end)

    octave = F.floor(F.log2("n") * 4).cast("int")
    sizes = {r["b"]: r["v"] for r in words.groupBy(octave.alias("b")).agg(F.count("*").alias("v")).collect()}
    least, room = 1 << 30, FREQUENT
    for b in sorted(sizes, reverse=True):
        room -= sizes[b]
        if room < 0:
            break
        least = b
    frequent = octave >= least
    base_of = lambda n: math.log10((n + 1) / (total + distinct + 1))
    known = {r["token"].encode(): r["n"] for r in words.filter(frequent).collect()}  # FREQUENT words at most
    shared = spark.sparkContext.broadcast((table, flat, known))
    none = len(known)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, flat, _ = shared.value
        params, rd = A.prepare(flat), reader(path)
        place, base_at = _lookup(shared, base_of)
        whole = [unpacked(c) for c in b.column("ids").to_pylist()]
        for some in _slices(whole):
            p, ids = b.slice(some.start, some.stop - some.start), whole[some]
            net = [v / math.log(10) for v in log_probs(ids, table, params)]
            texts = map(rd.words_of, ids)
            n, n_known, base, rare, times = [], [], [], [], []
            for ws in texts:
                at = np.fromiter(map(place, ws, repeat(none)), dtype=np.int64, count=len(ws))
                far = Counter(ws[i] for i in np.flatnonzero(at == none).tolist())
                n.append(len(ws) + 1)
                n_known.append(len(ws) - far.total() + (ends > 0))
                base.append(float(base_at[at].sum()) + base_of(ends))
                rare.append(list(far))
                times.append(list(far.values()))
            rows = [p.column("doc_id"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(net, pa.float64())]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "n_known", "base", "score", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = map_batches(src.select("doc_id", "ids"), batch, f"doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, rare array<string>, times array<bigint>")
    one = materialize(one.withColumn("row", F.monotonically_increasing_id()), "scored")
    scrap(written)
    others = words.filter(~frequent).select("token", "n")
    met = one.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    met = met.join(others, "token", "left")
    term = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))
    sums = met.groupBy("row").agg(F.sum(term).alias("rare_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"))
    out = one.drop("rare", "times").join(sums, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias
    return out.select(
        "doc_id", (part == held_out).alias("held_out"), "n_tokens", plus("n_known", "rare_known")("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "rare_base")("base_score"), "score",
    )


_tables: dict[int, tuple] = {}


def _lookup(shared, base_of) -> tuple:
    """(place of a word, base term at each place); the place after the last is for other words and adds nothing."""
    key = id(shared.value)
    if key not in _tables:
        _tables.clear()
        known = shared.value[2]
        _tables[key] = ({w: i for i, w in enumerate(known)}.get, np.array([*map(base_of, known.values()), 0.0]))
    return _tables[key]
