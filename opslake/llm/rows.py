"""Helpers shared by the operators on documents."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Rows handed to one call of a text function; a bound on what a Python worker holds besides its Arrow batch.
SLICE_ROWS = 256
#: Text of one call, in bytes; a longer text is a call of its own.
SLICE_BYTES = 8 << 20

#: The white space of the word rule ``[^\x20\x09-\x0D]+``; what ``bytes.split()`` splits at.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to give; its own columns take the place of the caller's."""
    return df.drop(*names)


def shielded(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that pass other columns through: input columns that start with ``_`` cannot meet those the operator makes on its way."""

    @wraps(fn)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        given = {a for a in (*args, *kwargs.values()) if isinstance(a, str)}
        names = [c for c in docs.columns if c.startswith("_") and c not in given]
        mark = "in"
        while any(c.startswith(mark) for c in docs.columns):
            mark += "_"
        out = fn(docs.withColumnsRenamed({c: mark + c for c in names}), *args, **kwargs)
        return out.withColumnsRenamed({mark + c: c for c in names})

    return run


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into slices of bounded size; the second part is the text column, null as empty, as binary."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary()).fill_null(b"")
        sizes = column.buffers()[1]
        offsets = memoryview(sizes).cast("q")[column.offset:column.offset + len(column) + 1] if len(column) else [0]
        start = 0
        for end in range(1, batch.num_rows + 1):
            full = end - start >= SLICE_ROWS or offsets[end] - offsets[start] >= SLICE_BYTES
            if full or end == batch.num_rows:
                yield batch.slice(start, end - start), column.slice(start, end - start)
                start = end


def per_text(df: DataFrame, text: str, fields: dict[str, str], make: Callable[[], Callable[[list], list]],
             as_bytes: bool = False, keep_text: bool = True) -> DataFrame:
    """Append columns that a Python function computes from each text, in Arrow slices.

    ``make()`` runs once per task and returns a function from a list of texts (null as empty) to one list per field.
    Other columns pass through; columns with the names of the new fields are replaced.
    """
    df = without(df, *fields)
    new = T.StructType([f for name, ddl in fields.items() for f in T.StructType.fromDDL(f"`{name}` {ddl}").fields])
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(kept + new.fields)
    names = [f.name for f in kept]
    types = _arrow_types(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for part, texts in text_slices(batches, text):
            values = texts.to_pylist() if as_bytes else texts.cast(pa.large_string()).to_pylist()
            arrays = [pa.array(v, type=t) for v, t in zip(call(values), types, strict=True)]
            old = [part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(old + arrays, names=names + list(fields))

    return df.mapInArrow(run, schema)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
