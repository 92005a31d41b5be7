"""Blocks that are similar enough, found by an inverted index instead of a table of all pairs.

The similarity of two blocks is a weighted sum of how close their names and bodies are, and of
their kinds. Two texts have an edit distance of at least the longer length less the bytes they
share, counted; so a closeness is at most the share of the longer text that both have. Each
byte of a text, with its number among equal bytes, is a token that weighs its part of the sum.
Blocks can reach the threshold only if common tokens weigh enough in both, so they share one
of the tokens that are left when each drops its commonest up to that weight: these alone are
indexed and looked up. The candidates' shared bytes are then counted, and what can still reach
the threshold is compared. That is for long bodies: short ones are compared with all others by
arrays, each distinct text once, which is quicker than to leave any out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np

from ..kinds import eligible, kind_similarity
from .distance import WORD, Closeness, closeness

#: Weights of name, body and kind in the similarity of two blocks.
NAME, BODY, KIND = 0.35, 0.50, 0.15
#: Similarity of two names that are both empty.
UNNAMED = 0.5
_SLACK = 1e-9
_NO_NAME = -1


def name_closeness(a: bytes, b: bytes, unnamed: float = UNNAMED) -> float:
    """Closeness of two folded names; `unnamed` where both are empty."""
    return unnamed if not a and not b else closeness(a, b)


def reaches(a: tuple[str, bytes, bytes], b: tuple[str, bytes, bytes], threshold: float, named: bool = True) -> float | None:
    """The similarity of two blocks (kind, folded name, body) if it is the threshold or more; bodies are compared only as far as that takes."""
    if not eligible(a[0], b[0]):
        return None
    name = name_closeness(a[1], b[1]) if named else 0.0
    kind = KIND * kind_similarity(a[0], b[0])
    least = (threshold - NAME * name - kind) / BODY - _SLACK
    if min(len(a[2]), len(b[2])) < least * max(len(a[2]), len(b[2])):
        return None
    close = closeness(a[2], b[2], least)
    if close < least:
        return None
    total = NAME * name + BODY * close + kind
    return total if total >= threshold else None


def _tokens(text: bytes, field: int) -> np.ndarray:
    """A code for each byte of a text: the field, the byte, and its number among equal bytes."""
    data = np.sort(np.frombuffer(text, dtype=np.uint8)).astype(np.int64)
    starts = np.searchsorted(data, data, side="left")
    return (field << 8 | data) << 40 | (np.arange(len(data)) - starts)


def _counts(texts: Sequence[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), 256), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
    return out


class SimilarIndex:
    """Blocks (kind, folded name, body) to be asked for those that are similar to another one."""

    def __init__(self, blocks: Sequence[tuple[str, bytes, bytes]], threshold: float, named: bool = True) -> None:
        self.blocks, self.threshold, self.named = blocks, threshold, named
        self.need = threshold - KIND - _SLACK  # of names and bodies, where the kinds are alike
        self.bodies = _counts([b for _, _, b in blocks])
        self.names = _counts([n for _, n, _ in blocks])
        self.body_size = np.array([len(b) for _, _, b in blocks], dtype=np.int64)
        self.name_size = np.array([len(n) for _, n, _ in blocks], dtype=np.int64)
        found = [self._weighed(n, b) for _, n, b in blocks]
        codes, often = np.unique(np.concatenate([c for c, _ in found]), return_counts=True) if found else (np.empty(0, dtype=np.int64),) * 2
        self.codes, self.often = codes, often
        lists: dict[int, list[int]] = defaultdict(list)
        for i, (code, weight) in enumerate(found):
            for c in self._rare(code, weight).tolist():
                lists[c].append(i)
        self.lists = {c: np.array(v) for c, v in lists.items()}

    def _weighed(self, name: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        code = [_tokens(body, 0)]
        weight = [np.full(len(body), BODY / max(len(body), 1))]
        if self.named:
            code.append(_tokens(name, 1) if name else np.array([_NO_NAME]))
            weight.append(np.full(max(len(name), 1), NAME / len(name) if name else NAME * UNNAMED))
        return np.concatenate(code), np.concatenate(weight)

    def _rare(self, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The tokens without the commonest that together weigh less than what is needed."""
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        often = np.where(self.codes[at] == code, self.often[at], 0) if len(self.codes) else np.zeros(len(code))
        order = np.lexsort((code, often))
        rest = np.cumsum(weight[order][::-1])[::-1]  # weight from each token on
        return code[order][rest >= self.need]

    def near(self, kind: str, name: bytes, body: bytes) -> Iterator[tuple[int, float]]:
        """(number, similarity) of the blocks whose similarity to this one reaches the threshold, in order."""
        if not self.blocks:
            return
        if self.need <= 0:  # kinds alone may be enough: every block can be
            at = np.arange(len(self.blocks))
        else:
            met = [self.lists[c] for c in self._rare(*self._weighed(name, body)).tolist() if c in self.lists]
            if not met:
                return
            at = np.unique(np.concatenate(met))
        most = BODY * self._share(self.bodies, self.body_size, at, body)
        if self.named:
            share = self._share(self.names, self.name_size, at, name)
            most += NAME * np.where((self.name_size[at] == 0) & (not name), UNNAMED, share)
        for i in at[most >= self.need].tolist():
            total = reaches((kind, name, body), self.blocks[i], self.threshold, self.named)
            if total is not None:
                yield i, total

    @staticmethod
    def _share(counts: np.ndarray, size: np.ndarray, at: np.ndarray, text: bytes) -> np.ndarray:
        """What part of the longer text both have, at most; 0 where one is empty."""
        own = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        used = np.flatnonzero(own)
        both = np.minimum(counts[np.ix_(at, used)], own[used]).sum(axis=1)
        return both / np.maximum(np.maximum(size[at], len(text)), 1)


#: Numbers that are remembered of names.
_KNOWN = 1 << 22


def _coded(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct texts, and the number of each text among them."""
    place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    return list(place), np.array([place[t] for t in texts], dtype=np.int64)


class _Short:
    """Blocks with bodies of WORD bytes at most, to be compared with others of that kind."""

    def __init__(self, blocks: Sequence[tuple[str, bytes, bytes]], threshold: float, named: bool) -> None:
        kinds, names, bodies = zip(*blocks)
        self.threshold, self.named = threshold, named
        self.kinds, self.kind = _coded(kinds)
        self.names, self.name = _coded(names)
        bodies, self.body = _coded(bodies)
        self.body_closeness, self.name_closeness = Closeness(bodies), Closeness(self.names) if named else None
        self.by_kind: dict[str, np.ndarray] = {}
        self.by_name: dict[bytes, np.ndarray] = {}

    def _kind(self, kind: str) -> np.ndarray:
        if kind not in self.by_kind:
            self.by_kind[kind] = np.array([KIND * kind_similarity(kind, k) if eligible(kind, k) else -np.inf for k in self.kinds])[self.kind]
        return self.by_kind[kind]

    def _learn(self, names: Sequence[bytes]) -> None:
        """Remember what names count for; what was known is forgotten when it grows too large."""
        if not all(n in self.by_name for n in names):
            if len(self.by_name) * len(self.name) > _KNOWN:
                self.by_name.clear()
            names = [n for n in dict.fromkeys(names) if n not in self.by_name]
            close = self.name_closeness.of(names)
            for n, row in zip(names, close):
                if not n:
                    row = np.array([0.0 if m else UNNAMED for m in self.names])
                self.by_name[n] = (NAME * row)[self.name]

    def near(self, blocks: Sequence[tuple[str, bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block the numbers, in order, and similarities of those that reach the threshold; blocks of equal bodies should be neighbours."""
        bodies, body = _coded([b for *_, b in blocks])
        close = BODY * self.body_closeness.of(bodies)
        if self.named:
            self._learn([n for _, n, _ in blocks])
        last = -1
        for (kind, name, _), b in zip(blocks, body.tolist()):
            if b != last:
                row, last = close[b][self.body], b
            total = (self.by_name[name] + row if self.named else row) + self._kind(kind)
            at = np.flatnonzero(total >= self.threshold)
            yield at, total[at]


def similar_rows(old: Sequence[tuple[str, bytes, bytes]], new: Sequence[tuple[str, bytes, bytes]], threshold: float, named: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of an old block, numbers of new ones in order, similarities) of what reaches the threshold; old blocks in any order, each once.

    Memory holds the new blocks and what one block of old ones has found.
    """
    short, long = ([j for j, b in enumerate(new) if (len(b[2]) <= WORD) == s] for s in (True, False))
    table = _Short([new[j] for j in short], threshold, named) if short else None
    place = np.array(short, dtype=np.int64)
    far = SimilarIndex([new[j] for j in long], threshold, named) if long else None
    near = SimilarIndex([new[j] for j in short], threshold, named) if short and any(len(b[2]) > WORD for b in old) else None
    order = sorted(range(len(old)), key=lambda i: old[i][2])
    for lo in range(0, len(order), 64):
        some = order[lo : lo + 64]
        quick = [i for i in some if len(old[i][2]) <= WORD]
        rows = table.near([old[i] for i in quick]) if table and quick else iter(())
        for i in some:
            at, s = np.empty(0, dtype=np.int64), np.empty(0)
            if len(old[i][2]) <= WORD:
                if table:
                    at, s = next(rows)
                    at = place[at]
                asked = [(far, long)]
            else:
                asked = [(near, short), (far, long)]
            more = [(numbers[j], t) for index, numbers in asked if index for j, t in index.near(*old[i])]
            if more:
                at, s = np.concatenate([at, np.array([j for j, _ in more], dtype=np.int64)]), np.concatenate([s, np.array([t for _, t in more])])
                by = np.argsort(at, kind="stable")
                at, s = at[by], s[by]
            if len(at):
                yield i, at, s
