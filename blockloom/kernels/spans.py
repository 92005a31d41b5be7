"""The smallest span around each of many places of one document, by one sweep over their starts.

Spans enter as the sweep passes their start. A tree over the ends holds, for every stretch of
ends, the smallest two spans that have entered, so a place asks for the smallest that reaches far
enough, and for another one where that is its own. Everything takes logarithmic time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

#: Spans times places up to which they are simply compared.
FEW = 64


def smallest_around(spans: Sequence[tuple[int, int, object]], places: Sequence[tuple[int, int, int | None]], strict: bool = False) -> list[int | None]:
    """Per place (start, reach, own) the number of the smallest span (start, end, tie) that starts no later and ends no earlier than reach.

    The lower tie comes first among spans of one size; `own` numbers a span that isn't meant. If
    strict, a span of the very place (start and reach) isn't either. Empty spans hold nothing.
    """
    if len(spans) * len(places) <= FEW:
        return [_plainly(spans, *place, strict) for place in places]
    ends = sorted({e for s, e, _ in spans if s < e})
    n = len(ends)
    best: list[list[tuple]] = [[] for _ in range(n + 1)]

    def enter(number: int) -> None:
        s, e, tie = spans[number]
        entry, at = (e - s, tie, number), n - bisect_left(ends, e)
        while at <= n:
            held = best[at]
            if len(held) < 2 or entry < held[1]:
                best[at] = sorted((*held, entry))[:2]
            at += at & -at

    def ask(reach: int, own: int | None) -> tuple | None:
        found, at = None, n - bisect_left(ends, reach)
        while at > 0:
            for entry in best[at]:
                if entry[2] != own:
                    if found is None or entry < found:
                        found = entry
                    break
            at -= at & -at
        return found

    coming = sorted((s, i) for i, (s, e, _) in enumerate(spans) if s < e)
    out: list[int | None] = [None] * len(places)
    at = 0
    order = sorted(range(len(places)), key=lambda p: places[p][0])
    k = 0
    while k < len(order):
        start = places[order[k]][0]
        here = k
        while here < len(order) and places[order[here]][0] == start:
            here += 1
        group, k = order[k:here], here
        while at < len(coming) and coming[at][0] < start:
            enter(coming[at][1])
            at += 1
        before = [ask(places[p][1], places[p][2]) for p in group] if strict else []
        while at < len(coming) and coming[at][0] == start:
            enter(coming[at][1])
            at += 1
        for i, p in enumerate(group):
            _, reach, own = places[p]
            found = ask(reach + strict, own)
            if strict and before[i] is not None and (found is None or before[i] < found):
                found = before[i]
            out[p] = None if found is None else found[2]
    return out


def _plainly(spans: Sequence[tuple[int, int, object]], start: int, reach: int, own: int | None, strict: bool) -> int | None:
    """The same for one place, by looking at every span."""
    best = None
    for number, (s, e, tie) in enumerate(spans):
        if s <= start and e >= reach and s < e and number != own and not (strict and s == start and e == reach):
            if best is None or (e - s, tie, number) < best:
                best = (e - s, tie, number)
    return None if best is None else best[2]
