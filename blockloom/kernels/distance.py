"""Restricted Damerau-Levenshtein distance over bytes, bit-parallel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: For each byte the table that makes it a one and all others a zero.
_ONLY = [b"0" * c + b"1" + b"0" * (255 - c) for c in range(256)]


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving: slices are compared whole."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def osa(a: bytes, b: bytes, cutoff: int | None = None) -> int:
    """Edits (insert, delete, replace, swap of neighbours, no byte edited twice) from a to b.

    With a cutoff, distances above it are all cutoff + 1, and the pass ends as soon as that is
    certain. Common ends are trimmed; the rest is one pass over the shorter text with the longer
    one's column held in big integers.
    """
    limit = max(len(a), len(b)) if cutoff is None else cutoff
    if a == b:
        return 0
    lead = _shared(a, b)
    a, b = a[lead:], b[lead:]
    tail = _shared(a[::-1], b[::-1])
    if tail:
        a, b = a[:-tail], b[:-tail]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return limit + 1
    if not a:
        return len(b)
    reverse = b[::-1]
    where = {c: int(reverse.translate(_ONLY[c]), 2) for c in set(a)}  # bit i: b[i] is c
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, zero, before, score = full, 0, 0, 0, len(b)
    left = len(a)  # bytes to come; each lowers the score by one at most
    for c in a:
        match = where[c]
        swap = ((~zero & match) << 1) & before
        zero = ((((match & up) + up) ^ up) | match | down | swap) & full
        plus, minus = (down | ~(zero | up)) & full, zero & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        left -= 1
        if score - left > limit:
            return limit + 1
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down, before = (minus | ~(zero | plus)) & full, plus & zero, match
    return min(score, limit + 1)


def closeness(a: bytes, b: bytes, least: float = 0.0) -> float:
    """1 - distance / longer length; 0 if either is empty, 1 if equal. Values below `least` may come as any that is below it."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    cutoff = None if least <= 0 else int((1 - least) * longest + 1e-6) + 1
    return 1 - osa(a, b, cutoff) / longest


#: Longest text, in bytes, that Distances takes: the bits of a machine word.
WORD = 64
#: Numbers of an array of Distances, about: it should stay in a core's cache.
_AT_ONCE = 1 << 16


class Distances:
    """Distances from short texts to many others, none longer than WORD.

    The others are a tree of their beginnings, read level by level as arrays: texts that begin alike share the steps of
    osa() for that beginning.
    """

    def __init__(self, texts: Sequence[bytes]) -> None:
        order = sorted(range(len(texts)), key=texts.__getitem__)
        size = np.array([len(texts[i]) for i in order], dtype=np.int64)
        width = int(size.max(initial=0))
        data = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in order), dtype=np.uint8).reshape(len(order), width)
        differs = np.ones((len(order), width + 1), dtype=bool)  # from the text before, in its first bytes that both have
        differs[1:, :width] = (data[1:] != data[:-1]) | (np.arange(width) >= np.minimum(size[1:], size[:-1])[:, None])
        shared = np.argmax(differs, axis=1)
        self.n, self.levels = len(texts), []
        place = np.array(order, dtype=np.int64)
        above = np.zeros(len(order), dtype=np.int64)
        for d in range(width):
            first = (size > d) & (shared <= d)
            node = np.cumsum(first) - 1
            end = np.flatnonzero(size == d + 1)
            self.levels.append((above[first], data[first, d], node[end], place[end]))
            above = node
        self.block = int(min(max(_AT_ONCE // max((len(b) for _, b, *_ in self.levels), default=1), 16), 64))

    def of(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of distances for each of the texts, which have a byte at least."""
        return np.concatenate([self._some(texts[i : i + self.block]) for i in range(0, len(texts), self.block)]) if texts else np.empty((0, self.n), dtype=np.int32)

    def _some(self, texts: Sequence[bytes]) -> np.ndarray:
        k = len(texts)
        where = np.zeros((256, k), dtype=np.uint64)  # bit i: byte i of the text is that byte
        for j, t in enumerate(texts):
            for i, c in enumerate(t):
                where[c, j] |= np.uint64(1 << i)
        size = np.array([len(t) for t in texts], dtype=np.uint64)
        one, mine = np.uint64(1), ~np.uint64(0) >> (np.uint64(WORD) - size)
        out = np.empty((self.n, k), dtype=np.int32)
        out[:] = size
        up, down, zero, before = np.full((1, k), ~np.uint64(0)), *(np.zeros((1, k), dtype=np.uint64) for _ in range(3))
        # As in osa(), but the distance is the sum of a column's steps up and down, taken where a text ends. Bits beyond a
        # text's size never move down, so they are left out only there.
        for length, (above, byte, end, place) in enumerate(self.levels, 1):
            up, down, zero, before = (x.take(above, axis=0) for x in (up, down, zero, before))
            match = where.take(byte, axis=0)
            swap = np.bitwise_and(np.invert(zero, out=zero), match, out=zero)
            swap <<= one
            swap &= before
            swap |= down
            swap |= match
            plus = np.bitwise_and(match, up, out=before)
            plus += up
            plus ^= up
            zero = np.bitwise_or(swap, plus, out=swap)
            plus = np.invert(np.bitwise_or(zero, up, out=plus), out=plus)
            plus |= down
            minus = np.bitwise_and(zero, up, out=up)
            minus <<= one
            plus <<= one
            plus |= one
            down = np.bitwise_and(plus, zero, out=down)
            up = np.bitwise_or(minus, np.invert(np.bitwise_or(zero, plus, out=plus), out=plus), out=minus)
            before = match
            if len(end):
                out[place] = length + np.bitwise_count(up.take(end, axis=0) & mine).astype(np.int32) - np.bitwise_count(down.take(end, axis=0) & mine)
        return np.ascontiguousarray(out.T)


class Closeness:
    """closeness() of texts to each of many others, as arrays."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.texts = texts
        self.size = np.array([len(t) for t in texts], dtype=np.int32)
        self.long = [(i, t) for i, t in enumerate(texts) if len(t) > WORD]
        self.short = np.flatnonzero(self.size <= WORD)
        self.near = Distances([texts[i] for i in self.short.tolist()])

    def of(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row for each of the texts."""
        able = [i for i, t in enumerate(texts) if 0 < len(t) <= WORD]
        size = np.array([len(texts[i]) for i in able], dtype=np.int32)
        close = self.near.of([texts[i] for i in able]) / np.maximum(size[:, None], self.size[self.short])
        np.subtract(1, close, out=close)
        close[:, self.size[self.short] == 0] = 0.0
        if len(able) == len(texts) and not self.long:
            return close
        out = np.zeros((len(texts), len(self.size)))
        out[np.ix_(able, self.short)] = close
        for i, t in enumerate(texts):
            if len(t) > WORD:
                out[i, self.short] = [closeness(t, self.texts[j]) for j in self.short.tolist()]
            for j, other in self.long:
                out[i, j] = closeness(t, other)
        return out
