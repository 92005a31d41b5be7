"""Review of one pair of texts, from source to report."""

from __future__ import annotations

from dataclasses import dataclass

from ..options import Options
from ..scan import detect, extension, extract
from .blocks import Block, Pair, raw, text
from .collapse import attach_prefixes, collapse, suppress_enclosed
from .lines import Line, diff_lines
from .matching import Matcher
from .report import Report


@dataclass
class Review:
    pairs: list[Pair]
    report: Report
    fallback: bool
    errors: tuple[int, int]
    old_name: str = ""
    new_name: str = ""

    def text(self) -> str:
        o = self.report.o
        return f"diff --{o.tool} {self.old_name} {self.new_name}\n" + text(self.report.render())


def _whole(source: str) -> Block:
    return Block("unknown", "", 0, 0, source)


def _diff(old: str, new: str, o: Options) -> list[Line]:
    """Line diff of Latin-1 sources; words are cut from real text."""
    lines = diff_lines(text(old), text(new), o.ignore_space, o.word_diff, o.word_diff_span_threshold)
    for line in lines:
        line.content = raw(line.content)
        line.new_content = None if line.new_content is None else raw(line.new_content)
        for w in line.words:
            w.text = raw(w.text)
    return lines


def whole_file(old: str, new: str, names: tuple[str, str], o: Options, supplemental: bool = False) -> Pair:
    a, b = _whole(old), _whole(new)
    a.name, b.name = names
    return Pair(a, b, 1.0, "similarity", "whole", _diff(old, new, o), supplemental)


def review(old: str, new: str, old_name: str, new_name: str, options: Options = Options()) -> Review:
    """Blocks of both texts, correlated, folded, diffed and classified; whole-file lines where there are no blocks."""
    old, new, names = raw(old), raw(new), (raw(old_name), raw(new_name))
    languages = (detect(old_name), detect(new_name))
    errors, pairs = (0, 0), []
    if not options.simple_diff and all(languages):
        macros = all(v in ("c", "cpp") for v in languages)
        a, b = (extract(src, "h" if extension(name).lower() == ".h" else v, macros) for src, name, v in zip((old, new), (old_name, new_name), languages))
        errors = (a.errors, b.errors)
        if a.blocks or b.blocks:
            pairs = suppress_enclosed(attach_prefixes(collapse(Matcher(a.blocks, b.blocks, options.threshold).run())))
            for p in pairs:
                if p.both:
                    p.diff = _diff(p.old.source, p.new.source, options)
            pairs.append(whole_file(old, new, names, options, True))
    fallback = not pairs
    if fallback:
        pairs = [whole_file(old, new, names, options)]
    shown = tuple(v or "" for v in (detect(old_name), detect(new_name)))
    return Review(pairs, Report(pairs, options, shown, errors), fallback, errors, old_name, new_name)
