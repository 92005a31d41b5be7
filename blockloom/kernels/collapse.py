"""What happens to matched pairs before they are diffed: references, prefix comments, enclosed comments."""

from __future__ import annotations

from collections import Counter, defaultdict

from ..kinds import COLLAPSIBLE, ELEMENT, FUNCTION_LIKE
from .blocks import Block, Pair
from .spans import smallest_around

_blank = " \t\r\n"
SIDES = ("old", "new")


def number_unnamed(pairs: list[Pair]) -> None:
    """Give unnamed collapsible blocks kind.01, kind.02, ... by position, per side and kind."""
    for side in SIDES:
        count: Counter = Counter()
        for b in sorted((p.side(side) for p in pairs if p.side(side)), key=lambda b: (b.start, b.id)):
            if not b.name and b.kind in COLLAPSIBLE:
                count[b.kind] += 1
                b.name = f"{b.kind}.{count[b.kind]:02d}"


class _Side:
    """Children, comments and elements of every block of one side, and what folding has absorbed."""

    def __init__(self, pairs: list[Pair], side: str) -> None:
        blocks = list({b.id: b for p in pairs if (b := p.side(side))}.values())
        self.inside: dict[str, list[Block]] = defaultdict(list)
        self.comments: dict[str, list[Block]] = defaultdict(list)
        self.reference: dict[str, str] = {}
        self.texts: Counter = Counter()
        self.ids: set[str] = set()
        code = [b for b in blocks if b.kind != "comment"]
        place = {b: i for i, b in enumerate(code)}
        spans = [(b.start, b.end, b.id) for b in code]
        elements = [b for b in code if not b.parent and b.kind in ELEMENT]
        comments = [b for b in blocks if b.kind == "comment"]
        for b in blocks:
            if b.parent:
                self.inside[b.parent].append(b)
        for b, up in zip(elements, smallest_around(spans, [(b.start, max(b.end, b.start + 1), place[b]) for b in elements])):
            if up is not None:
                self.inside[code[up].id].append(b)
        for b, up in zip(comments, smallest_around(spans, [(b.start, b.start + 1, None) for b in comments])):
            if up is not None:
                self.comments[code[up].id].append(b)
        for found in self.inside.values():
            found.sort(key=lambda b: (b.start, b.id))
        for p in pairs:
            if p.both and p.side(side).kind in COLLAPSIBLE:
                self.reference[p.side(side).id] = f"// [matched: {p.new.kind} {p.new.name or '<anonymous>'}]"

    def fold(self, b: Block) -> None:
        """Replace matched children that begin a line by references, last first."""
        matched = [c for c in self.inside[b.id] if c.id in self.reference]
        if not matched:
            return
        near = {c.id: c for c in [*(c for c in self.inside[b.id] if c.kind == "comment"), *self.comments[b.id]]}
        near = sorted(near.values(), key=lambda c: c.start)
        src = b.source
        own_line = lambda at: not src[src.rfind("\n", 0, at) + 1 : at].strip(_blank)
        for child in reversed(matched):
            lo, hi = child.start - b.start, child.end - b.start
            if not 0 <= lo < hi <= len(src) or not own_line(lo):
                continue
            first = lo
            spans = [(c, c.start - b.start, c.end - b.start) for c in near if c.start >= b.start and c.end - b.start <= len(src)]
            for c, s, e in spans:
                if e <= first and src[e:first] and not src[e:first].strip(_blank) and own_line(s):
                    first = s
                    self.ids.add(c.id)
            line_end = src.find("\n", hi)
            line_end = len(src) if line_end < 0 else line_end
            for c, s, e in spans:
                if hi <= s < line_end and e <= line_end:
                    hi = e
                    self.ids.add(c.id)
                    break
            src = src[:first] + self.reference[child.id] + src[hi:]
        b.source = self.absorb(src)

    def absorb(self, src: str) -> str:
        """Drop comment lines that stand directly above a reference line."""
        out: list[str] = []
        for line in src.split("\n"):
            if is_reference(line):
                while out and not is_reference(out[-1]) and out[-1].strip().startswith(("//", "/*")):
                    self.texts[out.pop().strip()] += 1
            out.append(line)
        return "\n".join(out)

    def absorbed(self, c: Block) -> bool:
        """Whether folding took this comment: by its id, or one of the lines with its text."""
        if c.id in self.ids:
            return True
        key = c.source.strip()
        if self.texts[key]:
            self.texts[key] -= 1
            return True
        return False


def is_reference(line: str) -> bool:
    line = line.strip()
    return line.startswith("// [matched: ") and line.endswith("]")


def collapse(pairs: list[Pair]) -> list[Pair]:
    """Fold matched children into references on both sides; drop unchanged comments that both sides absorbed."""
    number_unnamed(pairs)
    sides = {s: _Side(pairs, s) for s in SIDES}
    if not any(x.reference for x in sides.values()):
        return pairs
    for p in pairs:
        if p.old is not None and p.old.kind == "namespace":
            continue
        for s in SIDES:
            if p.side(s) is not None:
                sides[s].fold(p.side(s))
    out = []
    for p in pairs:
        taken = [b is not None and b.kind == "comment" and sides[s].absorbed(b) for s, b in zip(SIDES, (p.old, p.new))] if p.is_comment() else [False]
        if not (all(taken) and len(taken) == 2 and p.old.source == p.new.source):
            out.append(p)
    return out


class _Order:
    """Blocks of one side by position, and the runs of comments among them."""

    def __init__(self, pairs: list[Pair], side: str) -> None:
        self.pair = {p.side(side): p for p in pairs if p.side(side) is not None}
        self.all = sorted(self.pair, key=lambda b: (b.start, b.id))
        self.place = {b: i for i, b in enumerate(self.all)}
        self.attached: set[Block] = set()

    @staticmethod
    def touch(a: Block, b: Block) -> bool:
        return a.end_line + 1 == b.start_line

    def next_component(self, c: Block | None) -> Block | None:
        """The block directly below a comment, if it isn't a comment."""
        at = self.place.get(c)
        if at is None or at + 1 == len(self.all):
            return None
        n = self.all[at + 1]
        return n if n.kind != "comment" and self.touch(c, n) else None

    def run_to(self, last: Block) -> list[Block]:
        """Comments without a gap that end with this one."""
        run, at = [last], self.place[last]
        while at and self.all[at - 1].kind == "comment" and self.touch(self.all[at - 1], run[0]):
            at -= 1
            run.insert(0, self.all[at])
        return run

    def run_through(self, c: Block) -> list[Block]:
        at = self.place[c]
        while at + 1 < len(self.all) and self.all[at + 1].kind == "comment" and self.touch(self.all[at], self.all[at + 1]):
            at += 1
        return self.run_to(self.all[at])

    def leads(self, run: list[Block], component: Block | None) -> bool:
        return component is not None and all(self.touch(a, b) for a, b in zip(run, [*run[1:], component]))

    def attach(self, component: Block | None, run: list[Block]) -> None:
        if component is None or not run:
            return
        component.source = "".join(c.source + "\n" for c in run) + component.source
        component.start, component.start_line, component.start_col = run[0].start, run[0].start_line, run[0].start_col
        self.attached.add(component)


def attach_prefixes(pairs: list[Pair]) -> list[Pair]:
    """Put comments directly above a block into it, where both versions agree; comments wholly represented go."""
    order = {s: _Order(pairs, s) for s in SIDES}
    mate = lambda s, b: order[s].pair[b].side("new" if s == "old" else "old")
    trim = lambda s, run, others: [b for b in run if mate(s, b) is None or mate(s, b) in set(others)]
    gone: set[Pair] = set()

    def settle(runs: dict[str, list[Block]], components: dict[str, Block | None]) -> None:
        for s in SIDES:
            order[s].attach(components[s], runs[s])
        for s, o in (("old", "new"), ("new", "old")):
            for b in runs[s]:
                if mate(s, b) is None or mate(s, b) in runs[o]:
                    gone.add(order[s].pair[b])

    for p in pairs:
        if not p.is_comment():
            continue
        after = {s: order[s].next_component(p.side(s)) for s in SIDES}
        if p.both:
            if None in after.values() or order["old"].pair[after["old"]] is not order["new"].pair[after["new"]]:
                continue
            if any(after[s] in order[s].attached for s in SIDES):
                continue
            runs = {s: order[s].run_to(p.side(s)) for s in SIDES}
            runs["old"] = trim("old", runs["old"], runs["new"])
            runs["new"] = trim("new", runs["new"], runs["old"])
            settle(runs, after)
            continue
        s, o = ("new", "old") if p.old is None else ("old", "new")
        if after[s] is None or after[s] in order[s].attached:
            continue
        component = order[s].pair[after[s]]
        run = order[s].run_to(p.side(s))
        other = sorted((m for b in run if (m := mate(s, b)) is not None), key=lambda b: (b.start, b.id))
        if other:
            other = order[o].run_through(other[-1])
            if not order[o].leads(other, component.side(o)):
                continue
            run = trim(s, run, other)
        settle({s: run, o: other}, {s: component.side(s), o: component.side(o)})
    return [p for p in pairs if p not in gone]


def suppress_enclosed(pairs: list[Pair]) -> list[Pair]:
    """Drop comments that a function's own diff shows: in any function of their side, or matched within one pair."""
    owner = {s: {p.side(s).id: p for p in pairs if p.side(s) is not None} for s in SIDES}
    around: dict[str, dict[Block, Pair]] = {}
    for s in SIDES:
        functions = [p.side(s) for p in owner[s].values() if p.side(s).kind in FUNCTION_LIKE and p.side(s).size > 0]
        comments = [p.side(s) for p in pairs if p.side(s) is not None and p.is_comment()]
        found = smallest_around([(f.start, f.end, f.id) for f in functions], [(c.start, max(c.end, c.start), None) for c in comments], strict=True)
        around[s] = {c: owner[s][functions[i].id] for c, i in zip(comments, found) if i is not None}

    def hidden(p: Pair) -> bool:
        if not p.is_comment():
            return False
        if not p.both:
            return p.any in around["old" if p.new is None else "new"]
        if p.old.kind != "comment" or p.new.kind != "comment":
            return False
        a, b = around["old"].get(p.old), around["new"].get(p.new)
        return a is not None and a is b

    return [p for p in pairs if not hidden(p)]
