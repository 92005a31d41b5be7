"""Scalar functions over text and blocks as Spark column expressions (no Python on the executors)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds
from ..scan import EXTENSIONS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapsed(source: str | Column) -> Column:
    """Every run of white space (any script's) as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(source), r"(?U)\s+", " "))


def squeezed(line: str | Column) -> Column:
    """Without the four characters that count as space when space is ignored."""
    return F.translate(_c(line), " \t\r\n", "")


def split_lines(text: str | Column) -> Column:
    """Lines at line feeds; a last empty one is dropped."""
    parts = F.split(_c(text), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_words(line: str | Column) -> Column:
    return F.regexp_extract_all(_c(line), F.lit(r"[ \t\n\r(){}\[\];,=:]|[^ \t\n\r(){}\[\];,=:]+"), F.lit(0))


def folded_name(name: str | Column) -> Column:
    return F.lower(F.regexp_replace(_c(name), "[^A-Za-z0-9]", ""))


def scope_key(block_id: str | Column) -> Column:
    """A block id without its offset."""
    return F.regexp_replace(_c(block_id), r"(?s)^(.+):[0-9]+$", "$1")


def clamped(threshold: str | Column) -> Column:
    t = _c(threshold)
    return F.when(F.isnan(t) | (t > 1), F.lit(1.0)).when(t < 0, F.lit(0.0)).otherwise(t)


def in_set(kind: str | Column, which: tuple[str, ...]) -> Column:
    return _c(kind).isin(*which)


def eligible(a: str | Column, b: str | Column) -> Column:
    a, b = _c(a), _c(b)
    return (a == b) | ~(in_set(a, kinds.ISOLATED) | in_set(b, kinds.ISOLATED))


def compatible(a: str | Column, b: str | Column) -> Column:
    a, b = _c(a), _c(b)
    return reduce(lambda x, s: x | (in_set(a, s) & in_set(b, s)), (kinds.CALLABLE, kinds.VALUE, kinds.ELEMENT), a == b)


def kind_similarity(a: str | Column, b: str | Column) -> Column:
    return F.when(_c(a) == _c(b), 1.0).when(compatible(a, b), 0.6).otherwise(0.3)


def language(name: str | Column) -> Column:
    """Language by file name, null if unknown."""
    base = F.element_at(F.split(_c(name), "/", -1), -1)
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    table = F.create_map(*(F.lit(v) for pair in EXTENSIONS.items() for v in pair))
    return F.when(ext == ".C", "cpp").otherwise(F.element_at(table, F.lower(ext)))


def has_macros(a: str | Column, b: str | Column) -> Column:
    """Whether function-like macros are a kind of their own: both languages are C or C++."""
    return F.coalesce(_c(a).isin("c", "cpp") & _c(b).isin("c", "cpp"), F.lit(False))


def is_ordinal(kind: str | Column, name: str | Column) -> Column:
    """Whether a name is only a number given to an unnamed block."""
    kind, name = _c(kind), _c(name)
    rest = F.substring(name, F.length(kind) + 2, F.length(name))
    return F.startswith(name, F.concat(kind, F.lit("."))) & rest.rlike("^[0-9]*$")


def own_line(source: str | Column, start: str | Column) -> Column:
    """Whether only blanks are before a byte offset on its line."""
    head = F.substring(F.encode(_c(source), "utf-8"), F.lit(1), _c(start).cast("int"))
    return F.substring_index(F.decode(head, "utf-8"), "\n", -1).rlike(r"^[ \t\r]*$")


def trimmed_directive(source: str | Column) -> Column:
    """Source of a directive without its line end."""
    return F.regexp_replace(_c(source), r"[\r\n]+$", "")


def block_range(start_byte, end_byte, start_line, end_line, source) -> tuple[Column, Column]:
    """(first line from 1, lines) of a block; of its source where it has no span."""
    s, e, a, b, src = map(_c, (start_byte, end_byte, start_line, end_line, source))
    real = (s < e) | (a != 0) | (b != 0)
    count = F.size(F.split(src, "\n", -1)) - F.when(F.endswith(src, F.lit("\n")), 1).otherwise(0)
    none = src.isNull() | (src == "")
    return F.when(real, a + 1).when(none, 0).otherwise(1).cast("long"), F.when(real, b - a + 1).when(none, 0).otherwise(count).cast("long")


def display_name(name: str | Column) -> Column:
    return F.when(F.coalesce(_c(name), F.lit("")) == "", "<anonymous>").otherwise(_c(name))


def scope_tag(scope: str | Column) -> Column:
    return F.when(F.coalesce(_c(scope), F.lit("")) == "", "").otherwise(F.concat(F.lit("  [in "), _c(scope), F.lit("]")))


def kind_header(kind: str | Column) -> Column:
    table = F.create_map(*(F.lit(v) for pair in kinds.HEADER.items() for v in pair))
    return F.coalesce(F.element_at(table, _c(kind)), _c(kind))


def kind_rank(kind: str | Column) -> Column:
    table = F.create_map(*(F.lit(v) for pair in kinds.RANK.items() for v in pair))
    return F.coalesce(F.element_at(table, _c(kind)), F.lit(1000))


def is_lifecycle(name: str | Column) -> Column:
    from ..scan.ecma import LIFECYCLE

    return _c(name).isin(*sorted(LIFECYCLE))
