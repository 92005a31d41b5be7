"""Edit-distance similarities as columns: equal and empty texts are settled in the plan, the rest by an Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kinds
from ..kernels import distance, elements, matching, tokens
from ..kernels.lines import align, word_diff
from . import columns as C


@F.pandas_udf(T.LongType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Restricted Damerau-Levenshtein distance of the UTF-8 bytes; null if either is null."""
    return pd.Series([None if x is None or y is None else distance.osa(x.encode(), y.encode()) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(T.StringType())
def element_text(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else elements.element_text(s))


def comparison_text(kind: str | Column, source: str | Column) -> Column:
    """The text by which blocks are compared: canonical for elements, else with white space collapsed."""
    src = F.col(source) if isinstance(source, str) else source
    return F.when(C.in_set(kind, kinds.ELEMENT), element_text(src)).otherwise(C.collapsed(src))


@F.pandas_udf(T.ArrayType(T.StringType()))
def lexical_tokens(source: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else [t.encode("latin-1").decode("utf-8", "replace") for t in tokens.tokens(s.encode().decode("latin-1"), v or "")] for s, v in zip(source, language)])


def lexical_changes(rows: DataFrame, text: str, before: str) -> DataFrame:
    """rows without their two texts, with tokens int and formatting_only boolean; null where a text is.

    formatting_only: the texts differ and have the same tokens. A row's tokens are counted and let go before the next
    row is read, so memory holds those of two texts; a text that the row before had already isn't read again.
    """
    kept = [c for c in rows.columns if c not in (text, before)]

    def read(s: str | None) -> list[str] | None:
        return None if s is None else [t.encode("latin-1").decode("utf-8", "replace") for t in tokens.tokens(s.encode().decode("latin-1"), "")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            count: list[int | None] = []
            same: list[bool | None] = []
            for x, y in zip(b.column(text), b.column(before)):
                x, y = x.as_py(), y.as_py()
                old = last[1] if y == last[0] else None
                last = x, read(x)
                count.append(None if x is None else len(last[1]))
                same.append(None if x is None or y is None else x != y and last[1] == (read(y) if old is None else old))
            made = [pa.array(count, pa.int32()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=[*kept, "tokens", "formatting_only"])

    own = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{own}, tokens int, formatting_only boolean")


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays."""
    return pd.Series([None if x is None or y is None else sum(i >= 0 <= j for i, j in align(list(x), list(y))) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(T.StringType())
def marked_words(old: pd.Series, new: pd.Series) -> pd.Series:
    """A line's word diff as text, ~removed~ and +added+."""
    marks = {"del": "~", "add": "+", "ctx": ""}
    return pd.Series([None if a is None or b is None else "".join(f"{marks[w.type]}{w.text}{marks[w.type]}" for w in word_diff(a, b)) for a, b in zip(old, new)])


def closeness(a: Column, b: Column) -> Column:
    """1 - distance / longer length in bytes; 0 if either is empty, 1 if equal."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(1 - osa_distance(a, b) / longest)


def name_similarity(a: str, b: str, unnamed: float = 0.5) -> Column:
    x, y = C.folded_name(a), C.folded_name(b)
    return F.when((x == "") & (y == ""), unnamed).otherwise(closeness(x, y))


def block_similarity(a: dict[str, str], b: dict[str, str], named: bool = True) -> Column:
    """Weighted similarity of two blocks given by their columns name, body and kind."""
    name = name_similarity(a["name"], b["name"]) if named else F.lit(0.0)
    return matching.NAME * name + matching.BODY * closeness(F.col(a["body"]), F.col(b["body"])) + matching.KIND * C.kind_similarity(a["kind"], b["kind"])


def shown_similarity(a: dict[str, str], b: dict[str, str]) -> Column:
    """Similarity as reported: blocks that are only numbered, or have no name at all, count as equally named."""
    both = F.col(a["kind"]), F.col(b["kind"])
    numbered = (both[0] == both[1]) & C.is_ordinal(a["kind"], a["name"]) & C.is_ordinal(b["kind"], b["name"])
    name = F.when(numbered, 1.0).otherwise(name_similarity(a["name"], b["name"], 1.0))
    return matching.NAME * name + matching.BODY * closeness(F.col(a["body"]), F.col(b["body"])) + matching.KIND * C.kind_similarity(*both)


def similarity_bound(a: dict[str, str], b: dict[str, str]) -> Column:
    """No pair is more similar than this; it needs lengths only, so pairs below a threshold never reach the kernel."""
    la, lb = F.octet_length(F.col(a["body"])), F.octet_length(F.col(b["body"]))
    na, nb = F.octet_length(C.folded_name(a["name"])), F.octet_length(C.folded_name(b["name"]))
    name = F.when((na == 0) & (nb == 0), 0.5).otherwise(F.least(na, nb) / F.greatest(na, nb))
    body = F.when(F.greatest(la, lb) == 0, 0.0).otherwise(F.least(la, lb) / F.greatest(la, lb))
    return matching.NAME * name + matching.BODY * body + matching.KIND * C.kind_similarity(a["kind"], b["kind"])


__all__ = ["osa_distance", "element_text", "comparison_text", "lexical_tokens", "lexical_changes", "lcs_length", "marked_words", "closeness", "name_similarity", "block_similarity", "shown_similarity", "similarity_bound"]
