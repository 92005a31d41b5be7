"""What the source scanners share: tokens with bracket partners, and the list of blocks found."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from ..kernels.blocks import Block, Document

OPEN, CLOSE = "([{", ")]}"
PARTNER = dict(zip(OPEN, CLOSE))


#: Frames that one level of nesting takes at most; a level has at least one character.
FRAMES = 12


@contextmanager
def nesting(src: str) -> Iterator[None]:
    """Let the walks of a text go as deep as it can nest. Their calls are Python to Python, whose frames are on the heap (from Python 3.11 on), not on the stack of the process."""
    before = sys.getrecursionlimit()
    if sys.version_info >= (3, 11):
        sys.setrecursionlimit(min(before + FRAMES * len(src), (1 << 31) - 1))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


@dataclass
class Token:
    type: str  # word, number, text, mark, comment, or a scanner's own
    start: int
    end: int
    text: str
    line: int = 0
    mate: int = -1  # index of the partner of a bracket
    value: object = None


class Scanner:
    """Base of the language scanners: subclasses fill blocks in source order of their walk."""

    language = ""

    def __init__(self, src: str) -> None:
        self.src, self.blocks, self.errors = src, [], 0
        self.breaks = [m.end() for m in re.finditer("\n", src)]

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at)

    def column(self, at: int) -> int:
        n = self.line(at)
        return at - (self.breaks[n - 1] if n else 0)

    def add(self, kind: str, name: str, start: int, end: int, parent: str = "") -> Block:
        b = Block(kind, name, start, end, self.src[start:end], parent)
        self.place(b)
        self.blocks.append(b)
        return b

    def place(self, b: Block) -> None:
        b.start_line, b.start_col = self.line(b.start), self.column(b.start)
        b.end_line, b.end_col = self.line(b.end), self.column(b.end)

    def pair(self, tokens: list[Token]) -> list[Token]:
        """Set the partners of brackets; count those without one. A closer ends the nearest opener of its kind."""
        stack: list[int] = []
        for i, t in enumerate(tokens):
            t.line = self.line(t.start)
            if t.type != "mark":
                continue
            if t.text in PARTNER:
                stack.append(i)
            elif t.text in CLOSE and t.text:
                while stack and PARTNER[tokens[stack[-1]].text] != t.text and any(PARTNER[tokens[k].text] == t.text for k in stack):
                    stack.pop()
                    self.errors += 1
                if stack and PARTNER[tokens[stack[-1]].text] == t.text:
                    k = stack.pop()
                    tokens[k].mate, t.mate = i, k
                else:
                    self.errors += 1
        self.errors += len(stack)
        return tokens

    def walk(self) -> None:
        raise NotImplementedError

    def document(self) -> Document:
        self.walk()
        return Document(self.language, self.merged(), self.errors)

    def own_line(self, at: int) -> bool:
        return not self.src[self.src.rfind("\n", 0, at) + 1 : at].strip(" \t\r")

    def merged(self) -> list[Block]:
        """Blocks with runs of one-line comments, each alone on its line and without a gap, as one block."""
        out: list[Block] = []
        single = False
        for b in self.blocks:
            last = out[-1] if out else None
            one_line = "\n" not in b.source
            if last and b.kind == last.kind == "comment" and single and one_line and b.start_line == last.end_line + 1 and self.own_line(last.start) and self.own_line(b.start):
                last.source += "\n" + b.source
                last.end, last.end_line, last.end_col = b.end, b.end_line, b.end_col
                continue
            out.append(b)
            single = one_line
        return out
