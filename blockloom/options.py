"""Options of a review."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    simple_diff: bool = False
    summary_only: bool = False
    skip_unchanged: bool = False
    ignore_space: bool = False
    word_diff: bool = False
    word_diff_span_threshold: float = 0.4
    no_color: bool = True
    added_style: str = "white"
    removed_style: str = "white"
    threshold: float = 0.5
    tool: str = "blockloom"
    #: Marks before and after removed words, then added ones.
    word_marks: tuple[str, str, str, str] = ("~", "~", "+", "+")
