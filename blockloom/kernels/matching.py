"""Correlate the blocks of two versions: cheap exact stages first, then maximum-similarity assignment."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache

from ..kinds import ELEMENT, HOISTABLE, kind_similarity
from .assignment import INELIGIBLE, best_edges
from .blocks import Block, Pair, text
from .comments import equal_comments
from .distance import closeness
from .elements import element_text, plain_text
from .similar import BODY, KIND, NAME, SimilarIndex, name_closeness, reaches
from .spans import smallest_around

#: Pairs of blocks up to which an index isn't worth making.
FEW = 256
_offset = re.compile(r"(?s)^(.+):[0-9]+$")
_fold = re.compile(r"[^A-Za-z0-9]")


def clamp(threshold: float) -> float:
    if math.isnan(threshold) or threshold > 1:
        return 1.0
    return max(0.0, threshold)


def fold_name(name: str) -> str:
    return _fold.sub("", name).lower()


@lru_cache(maxsize=1 << 14)
def _folded(name: str) -> bytes:
    return fold_name(name).encode()


@lru_cache(maxsize=1 << 14)
def _unplaced(block_id: str) -> str:
    """An id without its offset."""
    return _offset.sub(r"\1", block_id)


def name_similarity(a: str, b: str, unnamed: float = 0.5) -> float:
    """Similarity of names by letters and digits; `unnamed` where neither has any."""
    return name_closeness(_folded(a), _folded(b), unnamed)


def is_ordinal(kind: str, name: str) -> bool:
    """Whether a name is only the number given to an unnamed block."""
    return name.startswith(kind + ".") and all(c in "0123456789" for c in name[len(kind) + 1 :])


def shown_similarity(p: Pair) -> float:
    """Similarity as reported: of the sources as they now are, unnamed blocks counting as equally named."""
    a, b = p.old, p.new
    numbered = a.kind == b.kind and is_ordinal(a.kind, a.name) and is_ordinal(b.kind, b.name)
    name = 1.0 if numbered else name_similarity(a.name, b.name, 1.0)
    return NAME * name + BODY * closeness(a.source.encode("latin-1"), b.source.encode("latin-1")) + KIND * kind_similarity(a.kind, b.kind)


class Side:
    """The blocks of one version and what stages ask about them."""

    def __init__(self, blocks: list[Block]) -> None:
        self.blocks = blocks
        self.by_id = {b.id: b for b in blocks}
        for i, b in enumerate(blocks):
            b.index = i
        self.free = set(blocks)
        self.children: dict[str, list[Block]] = defaultdict(list)
        for b in blocks:
            if b.parent and b.kind != "comment":
                self.children[b.parent].append(b)
        self._texts: dict[Block, bytes] = {}
        paths = {p: self._path(p) for p in {b.parent for b in blocks}}
        self.scope = {b: paths[b.parent] for b in blocks}

    def _path(self, at: str) -> tuple[str, ...]:
        """kind:name of a parent and its ancestors, namespaces left out; an unknown parent ends the path."""
        up = self.by_id.get(at)
        if not at or up is None or (not up.parent and up.kind != "namespace"):
            return (_unplaced(at),) if at else ()
        out, seen = [], set()
        while at and at not in seen:
            seen.add(at)
            up = self.by_id.get(at)
            if up is None or up.kind != "namespace":
                out.append(_unplaced(at))
            if up is None:
                break
            at = up.parent
        return tuple(reversed(out))

    def body(self, b: Block) -> bytes:
        found = self._texts.get(b)
        if found is None:
            shape = element_text if b.kind in ELEMENT else plain_text
            found = self._texts[b] = shape(text(b.source)).encode()
        return found

    def rest(self, keep: Callable[[Block], bool]) -> list[Block]:
        free = self.free
        return [b for b in self.blocks if b in free and keep(b)] if free else []

    def container(self, b: Block) -> Block | None:
        """The nearest ancestor that isn't a namespace."""
        at = self.by_id.get(b.parent)
        while at is not None and at.kind == "namespace":
            at = self.by_id.get(at.parent)
        return at

    def is_root(self, b: Block) -> bool:
        """Whether only namespaces are above; a parent that can't be found isn't one."""
        while b.parent:
            b = self.by_id.get(b.parent)
            if b is None or b.kind != "namespace":
                return False
        return True

    def comment_scopes(self, comments: list[Block]) -> dict[Block, str]:
        """Kind and name of the smallest block around each comment's first byte; the first among equals."""
        code = [b for b in self.blocks if b.kind != "comment"]
        found = smallest_around([(b.start, b.end, b.index) for b in code], [(c.start, c.start + 1, None) for c in comments])
        return {c: "" if i is None else f"{code[i].kind}\0{code[i].name}" for c, i in zip(comments, found)}


class Matcher:
    def __init__(self, old: list[Block], new: list[Block], threshold: float = 0.5) -> None:
        self.old, self.new = Side(old), Side(new)
        self.threshold = clamp(threshold)
        self._numbers: dict[bytes, int] = {}
        self._known: dict[tuple[int, int], float] = {}

    def _close(self, a: Block, b: Block) -> float:
        """Closeness of bodies, remembered by their texts' numbers."""
        key = (self._number(self.old.body(a)), self._number(self.new.body(b)))
        if key not in self._known:
            self._known[key] = closeness(self.old.body(a), self.new.body(b))
        return self._known[key]

    def _number(self, body: bytes) -> int:
        return self._numbers.setdefault(body, len(self._numbers))

    def similarity(self, a: Block, b: Block, named: bool = True) -> float:
        name = name_similarity(a.name, b.name) if named else 0.0
        return NAME * name + BODY * self._close(a, b) + KIND * kind_similarity(a.kind, b.kind)

    def assign(self, old: list[Block], new: list[Block], score: Callable[[Block, Block], float], stage: str, match_type: str) -> list[Pair]:
        """The best pairs of a table that no threshold bounds; scores below 0 are no pairs."""
        if not old or not new:
            return []
        return self.paired(old, new, [(i, j, s) for i, a in enumerate(old) for j, b in enumerate(new) if (s := score(a, b)) >= 0], stage, match_type)

    def paired(self, old: list[Block], new: list[Block], edges: list[tuple[int, int, float]], stage: str, match_type: str) -> list[Pair]:
        if not edges:
            return []
        out = [Pair(old[i], new[j], s, match_type, stage) for i, j, s in best_edges(edges)]
        self.take(out)
        return out

    def take(self, pairs: Iterable[Pair]) -> None:
        for p in pairs:
            self.old.free.discard(p.old)
            self.new.free.discard(p.new)

    def by_similarity(self, old: list[Block], new: list[Block], stage: str, named: bool = True) -> list[Pair]:
        """The best pairs among those at the threshold, which an index over the new blocks finds (few pairs are all tested)."""
        if not old or not new:
            return []
        shape = lambda side, b: (b.kind, _folded(b.name), side.body(b))
        x, y = [shape(self.old, b) for b in old], [shape(self.new, b) for b in new]
        if len(x) * len(y) <= FEW:
            edges = [(i, j, s) for i, a in enumerate(x) for j, b in enumerate(y) if (s := reaches(a, b, self.threshold, named)) is not None]
        else:
            index = SimilarIndex(y, self.threshold, named)
            edges = [(i, j, s) for i, a in enumerate(x) for j, s in index.near(*a)]
        return self.paired(old, new, edges, stage, "similarity")

    def exact_names(self) -> list[Pair]:
        """Same kind, name and scope; several with one identity are told apart by their bodies."""
        groups: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
        for k, side in enumerate((self.old, self.new)):
            for b in side.blocks:
                if b.name:
                    groups[b.kind, b.name, side.scope[b]][k].append(b)
        found = []
        for old, new in groups.values():
            if old and new:
                found += self.assign(old, new, self.similarity, "1", "exact_name")
        return sorted(found, key=lambda p: p.old.index)

    def exact_comments(self) -> list[Pair]:
        """Equal comments, first within the same container, then anywhere; the nearest in order among the comments left."""
        is_comment = lambda b: b.kind == "comment"
        old, new = self.old.rest(is_comment), self.new.rest(is_comment)
        if not old or not new:
            return []
        where = self.old.comment_scopes(old) | self.new.comment_scopes(new)
        at = equal_comments(*([(i, b.source, where[b]) for i, b in enumerate(side)] for side in (old, new)))
        found = [Pair(old[i], new[j], 1.0, "similarity", "2") for i, j in at]
        self.take(found)
        return found

    def below(self, pairs: list[Pair], stage: str) -> list[Pair]:
        """Children of matched parents, level after level."""
        found, queue = [], list(pairs)
        for p in queue:
            under = self.old.children.get(p.old.id), self.new.children.get(p.new.id)
            if None in under:
                continue
            old = [b for b in under[0] if b in self.old.free]
            new = [b for b in under[1] if b in self.new.free]
            got = self.by_similarity(old, new, stage)
            found += got
            queue += got
        return found

    def same_scope(self, code: Callable[[Block], bool]) -> list[Pair]:
        """What is left, within equal scope paths: one assignment per path, in the order of the old blocks."""
        groups: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
        for k, side in enumerate((self.old, self.new)):
            for b in side.rest(code):
                groups[side.scope[b]][k].append(b)
        found = []
        for old, new in groups.values():
            if old and new:
                found += self.by_similarity(old, new, "3c")
        return sorted(found, key=lambda p: p.old.index)

    def hoisted(self) -> list[Pair]:
        """Named callables that moved to another scope while both their containers found no partner."""
        groups: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        orphan = {}
        for k, side in enumerate((self.old, self.new)):
            for b in side.rest(lambda b: b.name != "" and b.kind in HOISTABLE):
                above = side.container(b)
                if above is not None:
                    groups[b.name][k].append(b)
                    orphan[b] = above in side.free
        found = []
        for old, new in groups.values():
            score = lambda a, b: self.similarity(a, b) if orphan[a] and orphan[b] else INELIGIBLE
            found += self.assign(old, new, score, "3d", "exact_name")
        return found

    def run(self) -> list[Pair]:
        """All matched pairs in result order, then added blocks, then removed ones."""
        code = lambda b: b.kind != "comment"
        pairs = self.exact_names()
        pairs += self.exact_comments()
        pairs += self.by_similarity(self.old.rest(lambda b: code(b) and self.old.is_root(b)), self.new.rest(lambda b: code(b) and self.new.is_root(b)), "3a")
        pairs += self.below(pairs, "3b")
        pairs += self.same_scope(code)
        rescued = self.hoisted()
        pairs += rescued + self.below(rescued, "3d")
        comment = lambda b: b.kind == "comment"
        pairs += self.by_similarity(self.old.rest(comment), self.new.rest(comment), "4", False)
        pairs += [Pair(None, b) for b in self.new.rest(lambda b: True)]
        return pairs + [Pair(b, None) for b in self.old.rest(lambda b: True)]
