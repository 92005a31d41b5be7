"""Comments of equal text in two versions: each old one takes the nearest new one that is still free."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence


class _Free:
    """New comments in order, of which some are taken: the nearest free one on either side, by pointers that skip taken runs."""

    def __init__(self, places: list[int]) -> None:
        self.places = places
        self.up = list(range(len(places) + 1))  # from here on the first free one; the end is always free
        self.down = list(range(len(places) + 1))  # one more than the last free one before here

    @staticmethod
    def _find(link: list[int], k: int) -> int:
        top = k
        while link[top] != top:
            top = link[top]
        while link[k] != top:
            link[k], k = top, link[k]
        return top

    def nearest(self, place: int) -> int | None:
        """The free comment nearest to a place, the earlier among equally near ones."""
        k = bisect_left(self.places, place)
        after, before = self._find(self.up, k), self._find(self.down, k) - 1
        if before < 0:
            return after if after < len(self.places) else None
        if after == len(self.places) or place - self.places[before] <= self.places[after] - place:
            return before
        return after

    def take(self, k: int) -> None:
        self.up[k], self.down[k + 1] = k + 1, k


def equal_comments(old: Sequence[tuple[int, str, object]], new: Sequence[tuple[int, str, object]]) -> list[tuple[int, int]]:
    """(place in old, place in new) of the comments that pair: (ordinal, text, where) each, in order of the ordinals.

    First within one `where`, then anywhere; old comments choose in their order and use up what
    they choose. Empty texts never pair.
    """
    out: list[tuple[int, int]] = []
    taken: tuple[set[int], set[int]] = (set(), set())
    for inside in (True, False):
        groups: dict[tuple, list[int]] = defaultdict(list)
        key = (lambda c: (c[1], c[2])) if inside else (lambda c: (c[1],))
        for j, c in enumerate(new):
            if c[1] and j not in taken[1]:
                groups[key(c)].append(j)
        free = {k: _Free([new[j][0] for j in v]) for k, v in groups.items()}
        for i, c in enumerate(old):
            if i in taken[0] or (k := key(c)) not in free:
                continue
            at = free[k].nearest(c[0])
            if at is not None:
                free[k].take(at)
                out.append((i, groups[k][at]))
                taken[0].add(i)
                taken[1].add(groups[k][at])
    return out
