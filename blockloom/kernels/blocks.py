"""Blocks of a source text and pairs of them, as the kernels hold them.

Sources are kept as Latin-1 text of the raw bytes, so that every offset is a byte offset and
any input can be read; text() and raw() convert at the edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .lines import Line


def raw(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("latin-1")


def text(source: str) -> str:
    return source if source.isascii() else source.encode("latin-1").decode("utf-8", "replace")


@dataclass(eq=False)
class Block:
    kind: str
    name: str
    start: int
    end: int
    source: str
    parent: str = ""
    scope: str = ""
    start_line: int = 0
    start_col: int = 0
    end_line: int = 0
    end_col: int = 0
    id: str = ""
    index: int = 0

    def __post_init__(self) -> None:
        self.id = self.id or f"{self.kind}:{self.name}:{self.start}"

    @property
    def size(self) -> int:
        return self.end - self.start

    def holds(self, other: Block) -> bool:
        return self.start <= other.start and other.end <= self.end


@dataclass(eq=False)
class Pair:
    old: Block | None
    new: Block | None
    confidence: float = 0.0
    match_type: str = "no_match"
    stage: str = ""
    diff: list[Line] | None = None
    supplemental: bool = False

    @property
    def both(self) -> bool:
        return self.old is not None and self.new is not None

    @property
    def any(self) -> Block:
        return self.new or self.old

    def side(self, name: str) -> Block | None:
        return self.old if name == "old" else self.new

    def is_comment(self) -> bool:
        return any(b is not None and b.kind == "comment" for b in (self.old, self.new))

    def has_changes(self) -> bool:
        return any(line.type != "ctx" for line in self.diff or ())


@dataclass
class Document:
    language: str
    blocks: list[Block] = field(default_factory=list)
    errors: int = 0

