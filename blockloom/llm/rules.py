"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one long
whose bit i says that rule i failed. A policy is a versioned set of rules: applying it, or
asking what would be kept without one of its rules, is a bitwise operation on the ledger and
never reads a text again.

Measurements are exact integers over the whole text; rules compare integers only.

Defined results: a null text has no words and fails `few_words`; texts of white space
likewise; repeated rows are measured each; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
#: Name -> SQL condition of failure over the measures. The place in this table is the bit; new rules go last.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "upper_case": "100 * n_upper > 50 * n_letters",
}


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a document passes if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("web-1", tuple(RULES)), Policy("prose-1", tuple(r for r in RULES if r != "upper_case")))}


def _per_row(parent: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(parent, weights=weights, minlength=rows).astype(np.int64)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number and value of every list element."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def repeated_words(words: np.ndarray, row: np.ndarray, rows: int, distinct: int) -> np.ndarray:
    """Per row, how many words lie in a 3-word window that occurs twice or more in that row.

    A stable sort by window code leaves equal windows of a row side by side.
    """
    n = len(words)
    if n < 3:
        return np.zeros(rows, dtype=np.int64)
    code = words[:-2].astype(np.int64) * distinct + words[1:-1]
    if distinct >= 2_000_000:  # else the code of three words fits 63 bits
        code = np.unique(code, return_inverse=True)[1]
    code = code * distinct + words[2:]
    at = np.flatnonzero(row[:-2] == row[2:])
    at = at[np.argsort(code[at], kind="stable")]
    same = (code[at[1:]] == code[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
    hit = np.zeros(n, dtype=bool)
    for found in (at[1:][same], at[:-1][same]):
        for k in range(3):
            hit[found + k] = True
    return _per_row(row[hit], rows)


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The measures of an array of texts."""
    rows = len(text)
    text = pc.fill_null(text, "")
    row, words = _flat(pc.ascii_split_whitespace(text))
    size = pc.utf8_length(words).to_numpy()
    real = size > 0
    row, words, size = row[real], words.filter(pa.array(real)), size[real]
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy()
    line_row, lines = _flat(pc.split_pattern(text, "\n"))
    worded = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    line_row, lines = line_row[worded], lines.filter(pa.array(worded)).dictionary_encode()
    line_code = line_row.astype(np.int64) * max(1, len(lines.dictionary)) + lines.indices.to_numpy()
    n_lines = _per_row(line_row, rows)
    unique_lines = _per_row(np.unique(line_code) // max(1, len(lines.dictionary)), rows)
    count = lambda pattern: pc.count_substring_regex(text, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "n_words": _per_row(row, rows),
        "word_chars": _per_row(row, rows, size),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": n_lines - unique_lines,
        "n_repeat_words": repeated_words(ids, row, rows, len(coded.dictionary)),
        "n_lines": n_lines,
        "n_letters": count(r"\p{L}"),
        "n_upper": count(r"\p{Lu}"),
    }


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(b):
            found = measure(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), batch, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measures and failures: bit i is set where rule i failed."""
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(RULES.values())]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measurements(docs).withColumn("failures", failures.cast("long"))


def fails(policy: Policy) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: how many rows fail it, fail it alone, and how many the policy keeps without it."""
    one = rows.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))  # 2^rules rows at most
    rules = [(r, 1 << list(RULES).index(r)) for r in policy.rules]
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{kind}_{r}") for r, bit in rules for kind, c in (
        ("failed", F.col("m").bitwiseAND(F.lit(bit)) != 0),
        ("alone", F.col("m") == bit),
        ("kept", F.col("m").bitwiseAND(F.lit(policy.mask & ~bit)) == 0),
    )]
    got = one.agg(*sums)
    pairs = ", ".join(f"'{policy.version}', '{r}', failed_{r}, alone_{r}, kept_{r}" for r, _ in rules)
    return got.selectExpr(f"stack({len(rules)}, {pairs}) AS (policy, rule, failed, failed_alone, kept_without)")


def verdicts(docs: DataFrame, policy: Policy = POLICIES["web-1"]) -> DataFrame:
    """The ledger with base_failed (the base policy's verdict) and kept (passes the base and the given policy)."""
    return ledger(docs).withColumn("base_failed", fails(BASE)).withColumn("kept", ~F.col("base_failed") & ~fails(policy))


#: The same in SQL.
SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
    p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
    g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS k FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g WHERE k IS NOT NULL) WHERE c > 1),
    rw AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
    m AS (
        SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
               coalesce(rw.n, 0) AS n_repeat_words, len(ls) AS n_lines,
               length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper
        FROM w LEFT JOIN rw USING (doc_id)),
    f AS (SELECT *, (""" + " | ".join(f"CASE WHEN {t} THEN {1 << i} ELSE 0 END" for i, t in enumerate(RULES.values())) + """)::BIGINT AS failures FROM m)
    SELECT *, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept FROM f
"""
