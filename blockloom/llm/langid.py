"""Language by string kernels.

A text is the set of its letter n-grams (blended spectrum, n = 1, 2, 3; presence, not counts),
hashed into a table per n. The kernel of two texts is the number of shared entries over the
geometric mean of their sizes. Texts are compared with a bounded set of landmark texts only
(Nystrom): with the landmarks' own kernel matrix K, a text's features are its kernel values
times K^-1/2. A ridge regression per language, one against the rest, gives its score. Scoring
a batch is one product of its presence matrix with the landmarks' and one with the weights.

Learning draws about PER_LANGUAGE texts of each language by hash of the id, and takes the
landmarks in the order of that hash. Every language is learned; where there are more than
LANGUAGES the texts of each are fewer, LEAST or more. The driver holds the drawn texts' packed
presence rows (1.6 KB each) and unpacks ROWS at a time.

Defined results: `und` with score 0 where text is null or has no letter, or nothing could be
learned; letters of any script count; whole texts are used; repeated rows are scored each; of
equal scores the language first by name is taken; an empty table gives no rows; other columns
may have any names, those of the result included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, materialize, text_slices

#: Hash table entries for n-grams of 1, 2 and 3 letters.
TABLES = (1 << 9, 1 << 12, 1 << 13)
WIDTH = sum(TABLES)
PER_LANGUAGE, LANGUAGES, LEAST = 400, 150, 8
#: Landmark texts of each language, and in all, at most.
LANDMARKS_EACH, LANDMARKS = 24, 600
RIDGE = 1e-2
#: Texts whose presence matrix is held at once, and letters taken at once.
ROWS, LETTERS = 256, 1 << 21
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(presence matrix, texts x WIDTH of 0 and 1; whether a text has a letter)."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    has = np.zeros(len(texts), dtype=bool)
    flat = out.reshape(-1)
    for r, text in enumerate(texts):
        for at in range(0, len(text), LETTERS):
            part = text[max(0, at - 2) : at + LETTERS].lower()
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letter = _letters()[code]
            has[r] |= bool(letter.any())
            c = np.where(letter, code, 32).astype(np.uint64)
            base = r * WIDTH
            h = c * np.uint64(0x9E3779B97F4A7C15)
            flat[base + (h >> np.uint64(55)).astype(np.int64)] = 1
            if len(c) > 1:
                two = (h[:-1] ^ (h[:-1] >> np.uint64(29))) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
                flat[base + TABLES[0] + ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)] = 1
            if len(c) > 2:
                three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0xD6E8FEB86659FD93)
                flat[base + TABLES[0] + TABLES[1] + ((three * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)] = 1
    return out, has


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # WIDTH x landmarks, scaled to unit length
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), ROWS):
            x, has = presence([t or "" for t in texts[at : at + ROWS]])
            if not self.languages:
                names += [UNKNOWN] * len(has)
                scores += [0.0] * len(has)
                continue
            size = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            s = (x @ self.landmarks / size) @ self.weights
            best = s.argmax(axis=1)
            top = np.clip(s[np.arange(len(best)), best], 0, 1)
            names += [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
            scores += [float(v) if h else 0.0 for v, h in zip(top.tolist(), has.tolist())]
        return names, scores


def _unit(bits: list[bytes]) -> np.ndarray:
    """Presence rows of unit length from packed ones."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1), axis=1)[:, :WIDTH].astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(bits: list[bytes], languages: list[str]) -> Model:
    """Landmarks, the first texts of each language in the order given, then ridge regressions on Nystrom features.

    bits are packed presence rows; ROWS of them are unpacked at a time.
    """
    names = sorted(set(languages))
    at_name = {v: k for k, v in enumerate(names)}
    y = np.array([at_name[v] for v in languages])
    each = max(1, min(LANDMARKS_EACH, LANDMARKS // len(names)))
    marks = _unit([bits[i] for k in range(len(names)) for i in np.flatnonzero(y == k)[:each]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    weight = 1.0 / np.bincount(y)[y]  # languages count alike, however many texts each has
    gram, cross = RIDGE * np.eye(root.shape[1]), np.zeros((root.shape[1], len(names)))
    for at in range(0, len(bits), ROWS):
        phi = (_unit(bits[at : at + ROWS]) @ marks.T).astype(np.float64) @ root
        scaled = phi * weight[at : at + ROWS, None]
        gram += phi.T @ scaled
        np.add.at(cross.T, y[at : at + ROWS], scaled)
    w = np.linalg.solve(gram, cross)
    return Model(names, np.ascontiguousarray(marks.T), (root @ w).astype(np.float32))


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Fit on texts with a language outside the held-out fold: about PER_LANGUAGE of each, drawn by hash."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) >= 0) & (fold("doc_id", folds) != held_out))
    counts = materialize(usable.groupBy("lang").count(), "languages")
    n = counts.count()
    each = min(PER_LANGUAGE, max(LEAST, PER_LANGUAGE * LANGUAGES // max(1, n)))
    shares = counts.select("lang", F.when(F.col("count") <= each, 1 << 30).otherwise((F.lit(each) / F.col("count") * (1 << 30)).cast("long")).alias("share"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 30))
    drawn = usable.withColumn("place", place).join(F.broadcast(shares), "lang").filter("place < share")  # a row per language

    def pack(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(b):
            texts, langs, places = (part.column(c).to_pylist() for c in ("text", "lang", "place"))
            for at in range(0, len(texts), ROWS):
                x, has = presence(texts[at : at + ROWS])
                mine = np.flatnonzero(has)
                rows = [[v[at + i] for i in mine] for v in (langs, places)] + [[np.packbits(x[i].astype(bool)).tobytes() for i in mine]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.string(), pa.int64(), pa.binary()))], names=["lang", "place", "bits"])

    # In order of the id's hash: `each` of a language in expectation, and a bound for tables whose ids repeat.
    made = map_batches(drawn.select("text", "lang", "place"), pack, "lang string, place bigint, bits binary")
    rows = made.orderBy("place", "lang", "bits").limit(2 * each * max(1, n)).collect()
    if not rows:
        return Model([], np.zeros((WIDTH, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    return fit([bytes(r["bits"]) for r in rows], [r["lang"] for r in rows])


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))  # LANDMARKS texts at most

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(b):
            names, scores = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_batches(docs.select("doc_id", "text"), batch, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
