"""Table functions for SQL: the blocks of a source text, for use with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels.blocks import raw, text
from ..scan import detect, extension, extract

COLUMNS = (
    "block_ix int, id string, kind string, name string, scope string, parent string, "
    "start_byte bigint, end_byte bigint, start_line bigint, start_col bigint, end_line bigint, end_col bigint, source string"
)


class _Blocks:
    """The blocks of one text, in the order they were found; the file's name tells the language.

    A null text counts as empty; a null name, or one of no known language, gives no rows. In C and
    C++ macros that look like functions are blocks.
    """

    def eval(self, src: str, file_name: str) -> Iterator[tuple]:
        language = detect(file_name or "")
        if not language:
            return
        found = extract(raw(src or ""), "h" if extension(file_name).lower() == ".h" else language, language in ("c", "cpp"))
        for i, b in enumerate(found.blocks):
            yield i, text(b.id), b.kind, text(b.name), text(b.scope), text(b.parent), b.start, b.end, b.start_line, b.start_col, b.end_line, b.end_col, text(b.source)


#: blocks(src, file_name) as a table function; rows come back to Spark in Arrow batches.
blocks = F.udtf(_Blocks, returnType=COLUMNS, useArrow=True)


def register(spark: SparkSession, name: str = "blocks") -> None:
    """Make the function known to SQL: SELECT ... FROM files f, LATERAL blocks(f.src, f.path) b."""
    spark.udtf.register(name, blocks)
