"""Toxicity by Levenshtein automata over a learned lexicon trie, with scores for context windows.

Learning. A bounded, hash-drawn sample of labelled rows gives, for every word and every word
beginning of MIN_STEM letters or more, the number of toxic and of clean documents that hold
it. Words and beginnings that are found almost only in toxic ones make the lexicon: whole
terms and stems. A small logistic model then weighs, per document, exact and misspelled hits
inside and outside of quotation.

Matching. The lexicon is a trie. A word is run through the product of the trie and a
Levenshtein automaton: a state is a set of (trie node, edits so far), so one walk over the
word's letters finds every term within the allowed number of edits (insert, delete, replace,
swap of neighbours), which is one for terms from FUZZY_LETTERS on. Stems from FUZZY_LETTERS on
take one edit and terms of SHORT letters one replaced or swapped letter, each only if the words
that this adds leave it as pure in the sample as a term has to be. A stem takes nothing from the
terms that begin with it. States and transitions are built when first met and kept, so words walk through a plain DFA.

Context. Around each hit a window of WINDOW words is looked at: hits inside quotation marks or
close to a word of reporting count as quotation. Both shares are features, so how much
quotation excuses is learned.

Words may hold single digits or marks between letters (sc0undrel, s*um); where these stand for
letters, the word is also read with the letters in place. A quotation mark left open ends with
its line.

Defined results: null and empty texts have no hits and get the score of such documents; with
no usable labels every score is 0; repeated rows are scored each, and of rows that share a doc_id
the greatest text is learned from; texts are scored whole; ties of terms go by count, then by letters; an empty table gives no rows; other columns may have any
names, those of the result included.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_batches, materialize, text_filter, text_slices

#: Labelled rows of the sample at most.
SAMPLE = 12_000
#: Pure terms and stems of the lexicon at most: those in most toxic documents of the sample stay.
TERMS = 20_000
MIN_STEM, MAX_STEM = 4, 8
#: Toxic documents that a term needs, and the least ratio of its shares among toxic and clean ones.
SUPPORT, RATIO = 4, 20.0
#: Letters from which a term may be misspelled by one edit.
FUZZY_LETTERS = 5
#: Letters of the shorter terms that may have one letter replaced or swapped.
SHORT = 4
WINDOW = 8
#: Distinct words whose result a worker keeps.
WORDS_KEPT = 100_000
#: Fixed: words that report what somebody else said, in the languages met.
REPORTING = frozenset("said says say called calls quoted quote wrote writes reported alleged term word slur sagte nannte schrieb zitiert wort dit disait mot écrit cité dijo dice palabra escribió cita".split())
#: Fixed: opening and closing quotation marks.
QUOTES = "\"“”„«»‹›"

#: Fixed: digits and marks that stand for letters in masked words.
MASKS = str.maketrans("013457@$", "oieastas")

#: Words (letters, with single digits or marks between them), quotation marks and line ends.
_word = re.compile(r"[^\W\d_]+(?:[\d*@$#][^\W\d_]+)*|[" + QUOTES + "]|\n")
_no_words = frozenset(QUOTES) | {"\n"}


class Lexicon:
    """Trie of terms with a lazily built automaton of all words within the allowed edits.

    A state's members are (node, edit, letter that a swap waits for); edit is 0 none, 1 a replaced
    or swapped letter, 2 a letter too many or missing.
    """

    def __init__(self, terms: list[str], stems: list[str], tolerant: Iterable[str] = ()) -> None:
        """tolerant: the stems, and the terms under FUZZY_LETTERS, that may be misspelled."""
        tolerant = frozenset(tolerant)
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [0]  # 0 none, 1 whole term, 2 stem
        self.edits: list[int] = [0]  # largest number of edits of a term below
        self.loose: set[int] = set()  # ends of terms that may be misspelled
        self.open: set[int] = set()  # ends of stems that may be misspelled
        self.short: set[int] = set()  # ends of terms that allow no letter more or less
        for kind, words in ((1, terms), (2, stems)):
            for w in words:
                at, path = 0, [0]
                for c in w:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.term.append(0)
                        self.edits.append(0)
                    at = self.next[at][c]
                    path.append(at)
                self.term[at] = max(self.term[at], kind)
                k = int(w in tolerant or kind == 1 and len(w) >= FUZZY_LETTERS)
                if k:
                    (self.open if kind == 2 else self.loose if len(w) >= FUZZY_LETTERS else self.short).add(at)
                for p in path:
                    self.edits[p] = max(self.edits[p], k)
        self.fuzzy = {n for n in range(len(self.next)) if self.edits[n]}
        self.sets: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.start = self._state(frozenset({(0, 0, "")}))

    def _closed(self, members: set) -> frozenset:
        """With what letters missing from the word reach: (node, 0) may skip one letter of a term that allows an edit."""
        out = set(members)
        for node, k, swap in members:
            if k == 0 and not swap:
                out.update((n, 2, "") for n in self.next[node].values() if n in self.fuzzy)
        return frozenset(out)

    def _state(self, members) -> int:
        full = self._closed(set(members))
        if full not in self.known:
            self.known[full] = len(self.sets)
            self.sets.append(full)
            self.steps.append({})
            best = 0
            for node, k, swap in full:
                if not swap and (self.term[node] if k == 0 else node in self.loose or node in self.open or k == 1 and node in self.short):
                    best = max(best, 2 if k == 0 else 1)
            self.ends.append(best)
        return self.known[full]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, k, swap in self.sets[state]:
            if swap:  # the letters before and this one are swapped
                if c == swap:
                    out.add((node, 1, ""))
                continue
            after = self.next[node].get(c)
            if after is not None and (k == 0 or after in self.fuzzy):
                out.add((after, k, ""))
            if self.term[node] == 2 and k == 0:
                out.add((node, 0, ""))  # a stem takes any ending
            if node in self.open and k:
                out.add((node, k, ""))
            if k == 0 and node in self.fuzzy:
                out.add((node, 2, ""))  # one letter too many
                for letter, n in self.next[node].items():
                    if n in self.fuzzy:
                        out.add((n, 1, ""))  # another letter
                        deep = self.next[n].get(c)
                        if deep in self.fuzzy:
                            out.add((deep, 1, letter))
        return self._state(out) if out else -1

    def match(self, word: str) -> int:
        """0 no term, 1 a misspelled term, 2 a term or a word that begins with a stem."""
        at = self.start
        for c in word:
            to = self.steps[at].get(c)
            if to is None:
                to = self.steps[at][c] = self._step(at, c)
            if to < 0:
                return 0
            at = to
        return self.ends[at]


FEATURES = ("bias", "exact", "misspelled", "quoted", "density")


class Scorer:
    """A lexicon, the weights of FEATURES, and a bounded memory of words."""

    def __init__(self, lexicon: Lexicon, weights: list[float]) -> None:
        self.lexicon, self.weights, self.words = lexicon, weights, {}

    def hits(self, distinct) -> set[str]:
        """The words of a collection that match, all looked up once."""
        memory, match, found = self.words, self.lexicon.match, set()
        for w in distinct:
            got = memory.get(w)
            if got is None:
                if len(memory) >= WORDS_KEPT:
                    memory.clear()
                got = match(w)
                if got < 2 and not w.isalpha():  # masked letters: as far as the plain word goes, a misspelling
                    got = max(got, min(1, match(w.translate(MASKS))))
                memory[w] = got
            if got:
                found.add(w)
        return found

    def features(self, text: str | None) -> list[float]:
        """bias, log counts of exact and misspelled hits outside quotation, log of quoted hits, hits per hundred words."""
        words = _word.findall((text or "").lower())
        found = self.hits(set(words))
        if not found:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        exact = fuzzy = quoted = n = 0
        inside = False
        for i, w in enumerate(words):
            if w == "\n":
                inside = False  # a mark that is left open ends with its line
            elif w in QUOTES:
                inside = not inside if w == '"' else w in "“„«‹"
            elif w in found:
                n += 1
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                if inside or not REPORTING.isdisjoint(near):
                    quoted += 1
                elif self.words.get(w, 0) == 2 or self.lexicon.match(w) == 2:
                    exact += 1
                else:
                    fuzzy += 1
        return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), min(5.0, 100 * (exact + fuzzy) / (len(words) - words.count("\n")))]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + l2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def misspellings(unit: str, stem: bool) -> Iterator[str]:
    """What a word (for a stem, a beginning of it) within the edits of unit looks like; a NUL stands for any letter."""
    for i in range(len(unit)):
        yield unit[:i] + "\0" + unit[i + 1 :]
        if i:
            yield unit[: i - 1] + unit[i] + unit[i - 1] + unit[i + 1 :]
        if stem:
            yield unit[:i] + unit[i + 1 :]
            yield unit[:i] + "\0" + unit[i:]


def tolerated(counts: DataFrame, units: list[tuple[str, bool]], pure) -> list[str]:
    """The units, (term of SHORT letters or stem, whether a stem), that stay pure with all words of the sample within their edits."""
    looks: dict[tuple[str, bool], list[int]] = defaultdict(list)
    for n, (unit, stem) in enumerate(units):
        for look in set(misspellings(unit, stem)):
            looks[look, stem].append(n)
    lengths = sorted({(len(look), stem) for look, stem in looks})

    def met(b: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for w, bad, good in zip(*(b.column(c).to_pylist() for c in ("w", "bad", "good"))):
            found: set[int] = set()
            for n, stem in lengths:
                if len(w) == n or stem and len(w) > n:
                    for look in (w[:n], *(w[:i] + "\0" + w[i + 1 : n] for i in range(n))):
                        found.update(looks.get((look, stem), ()))
            for unit in found:
                sums[unit][0] += bad
                sums[unit][1] += good
        cols = [pa.array(list(sums), pa.int64()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, names=["unit", "bad", "good"])

    words = counts.filter("w <> '' AND NOT stem").select("w", "bad", "good")
    got = map_batches(words, met, "unit bigint, bad bigint, good bigint").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = {r["unit"]: r for r in got.collect()}  # a row per unit
    return sorted(u for n, (u, _) in enumerate(units) if n not in sums or pure(sums[n]))


def lexicon_of(sample: DataFrame) -> Lexicon:
    """Learn terms and stems from (doc_id, text, toxic): counted in Spark, at most TERMS rows reach the driver."""

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        """One row per batch, word or stem and label: in how many documents it is."""
        counts: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
        total = [0, 0]
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            total[toxic] += 1
            words = set(_word.findall((text or "").lower())) - _no_words
            for w in words:
                counts[w, False][toxic] += 1
            for stem in {w[:n] for w in words for n in range(MIN_STEM, min(MAX_STEM, len(w) - 1) + 1)}:
                counts[stem, True][toxic] += 1
        counts["", False] = total
        keys = list(counts)
        cols = [[k[0] for k in keys], [k[1] for k in keys], [counts[k][1] for k in keys], [counts[k][0] for k in keys]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["w", "stem", "bad", "good"])

    counts = map_batches(sample.select("text", "toxic"), spread, "w string, stem boolean, bad bigint, good bigint")
    counts = counts.groupBy("w", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialize(counts, "word-labels")
    total = counts.filter("w = '' AND NOT stem").first()
    if total is None or not total["bad"]:
        return Lexicon([], [])
    n_bad, n_good = total["bad"], max(1, total["good"])
    pure = lambda r: (r["bad"] / n_bad) / ((r["good"] + 0.5) / n_good) >= RATIO
    found = counts.filter(f"w <> '' AND bad >= {SUPPORT} AND bad / {n_bad} >= {RATIO} * (good + 0.5) / {n_good}")
    found = found.orderBy(F.desc("bad"), "w", "stem").limit(TERMS).collect()
    terms = sorted(r["w"] for r in found if not r["stem"])
    stems: list[str] = []
    for s in sorted((r["w"] for r in found if r["stem"]), key=lambda s: (len(s), s)):
        endings = [t for t in terms if t.startswith(s)]
        if len(endings) >= 3 and not any(s.startswith(x) for x in stems):
            stems.append(s)
    units = [(t, False) for t in terms if len(t) == SHORT] + [(s, True) for s in stems if len(s) >= FUZZY_LETTERS]
    return Lexicon(terms, stems, tolerated(counts, units, pure) if units else ())


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, held_out: int = 0) -> Scorer:
    """Fit on labelled rows outside the held-out fold; of those, a sample of at most SAMPLE rows."""
    usable = labels.filter(F.col(column).isNotNull() & (fold("doc_id", folds) >= 0) & (fold("doc_id", folds) != held_out))
    usable = usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("toxic"))
    drawn = F.broadcast(bounded_sample(usable, "doc_id", SAMPLE))  # at most SAMPLE rows of two numbers
    sample = docs.select("doc_id", "text").join(drawn, "doc_id")
    sample = sample.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))  # SAMPLE texts at most
    lexicon = lexicon_of(sample)
    if not lexicon.next[0]:
        return Scorer(lexicon, [-30.0, 0, 0, 0, 0])
    probe = Scorer(lexicon, [0.0] * len(FEATURES))

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([probe.features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(got[:, i], pa.float64()) for i in range(len(FEATURES)))], names=["toxic", *FEATURES])

    made = map_batches(sample.select("text", "toxic"), rows, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    grouped = made.groupBy("toxic", *FEATURES).count().orderBy("toxic", *FEATURES).collect()  # SAMPLE rows of numbers at most
    data = np.array([[r[f] for f in FEATURES] for r in grouped])
    y, n = np.array([float(r["toxic"]) for r in grouped]), np.array([r["count"] for r in grouped])
    return Scorer(lexicon, fit_logistic(np.repeat(data, n, axis=0), np.repeat(y, n)).tolist())


def scored(rows: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """The columns in keep, and score."""
    shared = rows.sparkSession.sparkContext.broadcast(scorer)  # TERMS terms at most

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for p in text_slices(b):
            yield pa.RecordBatch.from_arrays([*(p.column(c) for c in keep), pa.array([s.score(t) for t in p.column("text").to_pylist()], pa.float64())], names=[*keep, "score"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows.select(*dict.fromkeys([*keep, "text"])), batch, f"{kept}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = scored(docs, learn(docs, labels), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores as toxic; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return text_filter(docs, lambda text: pa.array([shared.value.score(t) < threshold for t in text.to_pylist()], pa.bool_()))
