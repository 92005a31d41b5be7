"""Review of a table of text pairs.

Nothing in a review crosses a pair, so the whole pipeline is one narrow Arrow stage over the
pairs: no shuffle, any number of pairs, memory in proportion to one pair. The relational
operators over block tables (operators.relational) do the same steps as separate plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import review as kernel
from ..kernels.blocks import Block, raw, text
from ..kernels.lines import diff_lines
from ..kernels.report import COUNTERS
from ..options import Options
from ..scan import detect, extension, extract

#: Characters of sources whose results are handed on together.
HELD_CHARS = 1 << 19
#: Columns of a table of pairs.
PAIR_COLUMNS = ["pair_id", "old_name", "old_src", "new_name", "new_src"]
WORD = "struct<text:string,type:string,side:string>"
LINE = f"struct<type:string,content:string,old_no:int,new_no:int,new_content:string,words:array<{WORD}>,paired:boolean>"
SPAN = "start_byte bigint, end_byte bigint, start_line bigint, start_col bigint, end_line bigint, end_col bigint"
BLOCK = f"side string, block_ix int, id string, kind string, name string, scope string, parent string, {SPAN}, source string"
PAIR = (
    "pair_seq int, stage string, match_type string, confidence double, supplemental boolean, old_id string, new_id string, old_kind string, new_kind string, old_name string, "
    "new_name string, similarity int, tags array<string>, counted array<string>, has_changes boolean, old_source string, new_source string"
)
REVIEW = f"fallback boolean, old_parse_errors int, new_parse_errors int, report string, summary struct<{','.join(f'{c}:bigint' for c in COUNTERS)}>, pairs array<struct<{PAIR.replace(' ', ':').replace(',:', ',')}, lines:array<{LINE}>>>"


def _line(x) -> dict:
    words = [{"text": text(w.text), "type": w.type, "side": w.side} for w in x.words]
    return {"type": x.type, "content": text(x.content), "old_no": x.old_no or None, "new_no": x.new_no or None, "new_content": None if x.new_content is None else text(x.new_content), "words": words, "paired": x.paired}


def _block(b: Block, side: str, ix: int) -> dict:
    span = dict(start_byte=b.start, end_byte=b.end, start_line=b.start_line, start_col=b.start_col, end_line=b.end_line, end_col=b.end_col)
    return dict(side=side, block_ix=ix, id=text(b.id), kind=b.kind, name=text(b.name), scope=text(b.scope), parent=text(b.parent), source=text(b.source), **span)


def _per_pair(pairs: DataFrame, fields: str, rows_of) -> DataFrame:
    """pair_id and the rows that rows_of(old_name, old_src, new_name, new_src) gives for each pair."""
    kind = pairs.schema["pair_id"].dataType.simpleString()
    schema = pairs.sparkSession.createDataFrame([], f"pair_id {kind}, {fields}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in b.to_pylist():
                found = rows_of(row["old_name"] or "", row["old_src"] or "", row["new_name"] or "", row["new_src"] or "")
                held += [{"pair_id": row["pair_id"], **r} for r in found]
                size += len(row["old_src"] or "") + len(row["new_src"] or "")
                if size > HELD_CHARS:  # one pair at least: memory is bounded by the largest pair
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return pairs.select(*PAIR_COLUMNS).mapInArrow(run, schema)


def review(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per pair: fallback, parse errors, report, summary and the pairs of blocks with their diff lines.

    Null sources and names count as empty; names without a known ending give a whole-file diff.
    """

    def rows(old_name: str, old: str, new_name: str, new: str) -> list[dict]:
        r = kernel.review(old, new, old_name, new_name, options)
        out = []
        for i, p in enumerate(r.pairs):
            a, b = p.old, p.new
            get = lambda x, f: None if x is None else text(getattr(x, f))
            row = dict(pair_seq=i, stage=p.stage, match_type=p.match_type, confidence=p.confidence, supplemental=p.supplemental, has_changes=p.has_changes())
            for f in ("id", "kind", "name", "source"):
                row |= {f"old_{f}": get(a, f), f"new_{f}": get(b, f)}
            row |= dict(similarity=r.report.similarity(p) if p.both else None, tags=r.report.tags(p) if p.both else [], counted=[] if p.supplemental else r.report.classes_of(p), lines=[_line(x) for x in p.diff or ()])
            out.append(row)
        return [dict(fallback=r.fallback, old_parse_errors=r.errors[0], new_parse_errors=r.errors[1], report=r.text(), summary=r.report.summary(), pairs=out)]

    return _per_pair(pairs, REVIEW, rows)


def blocks(pairs: DataFrame) -> DataFrame:
    """The blocks of both sides of every pair, as tables of blocks have them; null where a language is unknown: no rows."""

    def rows(old_name: str, old: str, new_name: str, new: str) -> list[dict]:
        languages = (detect(old_name), detect(new_name))
        macros = all(v in ("c", "cpp") for v in languages)
        out = []
        for side, name, src, language in zip(("old", "new"), (old_name, new_name), (old, new), languages):
            if language:
                found = extract(raw(src), "h" if extension(name).lower() == ".h" else language, macros)
                out += [_block(b, side, i) for i, b in enumerate(found.blocks)]
        return out

    return _per_pair(pairs, BLOCK, rows)


def match_blocks(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Correlate tables of hand-made or scanned blocks: pair_id, pair_seq, stage, old_ix, new_ix, confidence, match_type.

    Blocks are dealt out by pair_id and sorted, then read as a stream: memory holds the blocks of
    one pair at a time, as the assignment over their similarity table needs.
    """
    from ..kernels.matching import Matcher

    need = ["pair_id", "side", "block_ix", "id", "kind", "name", "parent", "start_byte", "end_byte", "source"]
    names = ["pair_id", "pair_seq", "stage", "old_ix", "new_ix", "confidence", "match_type"]
    kind = rows.schema["pair_id"].dataType.simpleString()

    def match(pair_id, found: list[tuple]) -> Iterator[tuple]:
        sides: dict[str, list[Block]] = {"old": [], "new": []}
        ix: dict[Block, int] = {}
        for _, side, block_ix, block_id, kind, name, parent, start, end, source in found:
            b = Block(kind, raw(name or ""), start, end, raw(source or ""), raw(parent or ""), id=raw(block_id))
            ix[b] = block_ix
            sides[side].append(b)
        for i, p in enumerate(Matcher(sides["old"], sides["new"], threshold).run()):
            yield pair_id, i, p.stage or ("added" if p.old is None else "removed"), ix.get(p.old), ix.get(p.new), p.confidence, p.match_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        at = None

        def batch() -> pa.RecordBatch:
            types = (id_type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for b in batches:
            id_type = b.schema.field("pair_id").type
            for r in zip(*(b.column(c).to_pylist() for c in need)):
                if held and r[0] != at:
                    out += match(at, held)
                    held = []
                at = r[0]
                held.append(r)
            if len(out) > 10_000:
                yield batch()
                out = []
        if held:
            out += match(at, held)
        if out:
            yield batch()

    schema = f"pair_id {kind}, pair_seq int, stage string, old_ix int, new_ix int, confidence double, match_type string"
    sorted_rows = rows.select(*need).withColumn("block_ix", F.col("block_ix").cast("int")).repartition("pair_id").sortWithinPartitions("pair_id", "block_ix")
    return sorted_rows.mapInArrow(run, schema)


def line_diff(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per line of the whole-file diff of every pair: line_seq, type, content, old_no, new_no, new_content, words, ..."""

    def rows(old_name: str, old: str, new_name: str, new: str) -> list[dict]:
        found = diff_lines(old, new, options.ignore_space, options.word_diff, options.word_diff_span_threshold)
        words = lambda x: [{"text": w.text, "type": w.type, "side": w.side} for w in x.words]
        return [dict(line_seq=i, type=x.type, content=x.content, old_no=x.old_no or None, new_no=x.new_no or None, new_content=x.new_content, words=words(x), paired=x.paired) for i, x in enumerate(found)]

    return _per_pair(pairs, f"line_seq int, type string, content string, old_no int, new_no int, new_content string, words array<{WORD}>, paired boolean", rows)


def reports(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """(pair_id, line_seq, text): the report of every pair, line by line."""
    made = _per_pair(pairs, "report string", lambda old_name, old, new_name, new: [dict(report=kernel.review(old, new, old_name, new_name, options).text())])
    return made.select("pair_id", F.posexplode(F.split("report", "\n", -1)).alias("line_seq", "text"))


def summaries(pairs: DataFrame, options: Options = Options()) -> DataFrame:
    """The counters of every pair's summary, its parse errors and whether its lines were compared whole; no lines leave the kernel."""

    def rows(old_name: str, old: str, new_name: str, new: str) -> list[dict]:
        r = kernel.review(old, new, old_name, new_name, options)
        return [dict(**r.report.summary(), old_parse_errors=r.errors[0], new_parse_errors=r.errors[1], fallback=r.fallback)]

    return _per_pair(pairs, ", ".join([*(f"{c} bigint" for c in COUNTERS), "old_parse_errors int, new_parse_errors int, fallback boolean"]), rows)
