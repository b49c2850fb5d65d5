"""Arrow-batched wrappers of udfs.py, for use in plans; workers import udfs.py alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udfs

#: Rows of a batch that are worked on, and handed back, at a time.
ROWS = 64

_CHUNKS = pa.list_(pa.struct([("content", pa.string()), ("hierarchy", pa.string())]))
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("size", pa.float64()), ("bold", pa.bool_())]))


def _mapped(f: Callable, kind: str, arrow: pa.DataType, rows: int = ROWS):
    """f on each row. A few rows at a time become Python objects and go back, so that a batch of long texts is
    held once, as it came."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for k in range(0, len(batch), rows):
                yield pa.array([f(x) for x in batch.slice(k, rows).to_pylist()], arrow)

    return F.arrow_udf(run, kind)


def recursive_split(text: Column | str) -> Column:
    return _mapped(udfs.split_text, "array<string>", pa.list_(pa.string()))(text)


def markdown_chunks(text: Column | str) -> Column:
    return _mapped(udfs.chunk_markdown, "array<struct<content:string,hierarchy:string>>", _CHUNKS)(text)


def sdt_html(xml: Column | str) -> Column:
    return _mapped(udfs.content_html, "string", pa.string())(xml)


def page_blocks(spans: Column | str) -> Column:
    """Blocks of a page from the array of its spans: one row a page, not one Python call a group."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for k in range(0, len(batch), ROWS * ROWS):
                pages = batch.slice(k, ROWS * ROWS)
                flat = pages.flatten()
                columns = [flat.field(c).to_pylist() for c in udfs.SPAN]
                ends = pages.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum().tolist()
                yield pa.array([udfs.blocks_of(*(c[a:b] for c in columns)) for a, b in zip([0, *ends], ends, strict=False)], _BLOCKS)

    return F.arrow_udf(run, "array<struct<text:string,size:double,bold:boolean>>")(spans)
