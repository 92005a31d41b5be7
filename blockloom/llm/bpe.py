"""Byte-level BPE: encoding by a contiguous rank array per short word, and decoding.

A text is cut at special tokens, then into pre-tokens by the tokenizer's pattern. A
pre-token's bytes are held as an array of part boundaries beside an array of the ranks of
adjacent pairs. Each step scans the ranks for the minimum, deletes that boundary and looks up
the two ranks that changed. Words are short, so the scan over a contiguous array is cheaper
than a heap; pre-tokens over LONG bytes use a heap over the same ranks with the same result.

Encoded words are kept in a dictionary of bounded size per Python worker.

Defined results: null and empty texts have no tokens; texts of any length and without a
single space are encoded whole; the strings of special tokens inside a text become their ids;
repeated rows are encoded each; of pairs with the same rank the leftmost merges first; an empty
table gives no rows; other columns may have any names, those of the result included.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Bytes of a pre-token from which a heap replaces the scan.
LONG = 256
#: Entries of the word memory of a worker; when it is full it starts again.
WORDS_KEPT = 300_000
LIBRARY_WORDS_KEPT = 200_000
#: Fixed: the pre-token pattern that byte-level tokenizer files leave to the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where visible, else 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE, no normalizer, no added prefix space)."""

    #: Words remembered.
    keep = WORDS_KEPT

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {k: bytes(letters[c] for c in k) for k in spec["model"]["vocab"]}
        self.ids = {raw[k]: i for k, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        #: Adjacent parts' ids, packed into one integer -> rank of the pair; rank -> id of the merged part.
        self.ranks = {vocab[x] << 32 | vocab[y]: i for i, (x, y) in reversed([*enumerate(pairs)])}
        self.merged = [vocab[x + y] for x, y in pairs]
        self.byte_ids = [self.ids[bytes([i])] for i in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, bytes] = {"": b""}
        self.short = self.merge_short

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token's parts after all merges."""
        return self.short(word) if len(word) <= LONG else self.merge_long(word)

    def merge_short(self, word: bytes) -> list[int]:
        """merge() for short pre-tokens: the adjacent ranks in one array, scanned for the least."""
        parts = [self.byte_ids[x] for x in word]
        get, merged, none = self.ranks.get, self.merged, len(self.merged)
        ranks = [get(x << 32 | y, none) for x, y in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = new = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, none)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """merge() for long pre-tokens: a heap of (rank, place), stale entries skipped."""
        n, get = len(word), self.ranks.get
        part = [self.byte_ids[x] for x in word]  # -1: merged into the part before
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or get(part[i] << 32 | part[j]) != r:
                continue
            part[i], part[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(part[i] << 32 | part[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(part[h] << 32 | part[i])) is not None:
                heapq.heappush(heap, (x, h))
        return [p for p in part if p >= 0]

    def _learn(self, w: str) -> bytes:
        """Ids of one pre-token that isn't remembered, as bytes; short ones are remembered from now on."""
        word, known = w.encode(), self.words
        if len(word) > LONG:
            got = array("I", self.merge_long(word)).tobytes()
        else:
            got = array("I", self.short(word)).tobytes()
        if len(w) <= LONG:
            if len(known) >= self.keep:
                known.clear()
                known[""] = b""
            known[w] = got
        return got

    def _new(self, words: list[str]) -> bytes:
        """Little-endian 32-bit ids of pre-tokens, from memory where known."""
        known, out = self.words, []
        for w in words:
            got = known.get(w)
            if got is None:
                got = self._learn(w)
            out.append(got)
        return b"".join(out)

    def _cut_words(self, words: list[str]) -> bytes:
        """The same for space-led words, each one pre-token or several."""
        known, out = self.words, []
        for w in words:
            got = known.get(w)
            if got is None:
                if (w[1:] if w[0] == " " else w).isalpha():
                    got = self._learn(w)
                else:
                    got = self._new(self.pattern.findall(w))
                    if len(w) <= LONG and len(known) < self.keep:
                        known[w] = got
            out.append(got)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        A space before a non-space always starts a pre-token, and a line feed not followed by
        other white space than one space is a pre-token. A text whose spaces are all like that
        is cut there and whole words are looked up; other texts go through the pattern.
        """
        if self.cut is not None and any(s in text for s in self.special):
            return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.packed(x) for x in self.cut.split(text) if x)
        if not text:
            return b""
        if "\0" in text or _loose(text) is not None:
            return self._new(self.pattern.findall(text))
        words = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            return self._cut_words(words)

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: White space for which cutting there would be wrong.
_loose = re.compile(r" (?=\s|\Z)|\n(?=[^\S ])").search


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


class LibraryCodec(Codec):
    """The same ids, with new short words merged by a compiled library where the file's ids are in merge order.

    New words cost little here, so fewer are remembered.
    """

    keep = LIBRARY_WORDS_KEPT

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if all(a < b for a, b in zip(self.merged, self.merged[1:])):
            import tiktoken

            made = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})
            self.short = getattr(made, "_encode_single_piece", self.merge_short)  # not a public name: without it words are merged here


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    """One library codec per worker and file, for operators that only need the ids."""
    return LibraryCodec(path)


def roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: each text is encoded, then decoded from its ids."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c, n, ids_sha, text_sha = codec(path), [], [], []
        decimal, raw = _decimals(path), c.bytes_of
        for text in b.column("text").to_pylist():
            ids = c.encode(text or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            data = b"".join(map(raw.__getitem__, ids))
            text_sha.append(hashlib.sha256(_valid(data)).hexdigest())
        cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), batch, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _valid(data: bytes) -> bytes:
    return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def _decimals(path: str) -> dict[int, str]:
    return {i: str(i) for i in codec(path).bytes_of}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = pa.array([c.encode(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), batch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids give an empty text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        texts = pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), texts], names=["doc_id", "text"])

    return map_batches(rows.select("doc_id", "ids"), batch, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
