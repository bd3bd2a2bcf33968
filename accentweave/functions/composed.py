"""Unicode normal forms, which Spark has no function for, and accentuation of decomposed text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def with_form(df: DataFrame, column: str, into: str, form: str) -> DataFrame:
    """``df`` with ``into``, the text of ``column`` in a Unicode normal form; null stays null. ASCII is left as it is."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}, not {form!r}")
    at, keep = df.columns.index(column), [i for i, c in enumerate(df.columns) if c != into]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(out, pa.string())], names=[*(b.schema.names[i] for i in keep), into])

    return df.mapInArrow(rows, df.select(*(df.columns[i] for i in keep)).schema.add(into, "string"))


def accentuate_decomposed(engine, df: DataFrame, column: str = "text", into: str = "accentuated") -> DataFrame:
    """Text that comes decomposed (NFKD) is composed, accentuated with acutes, and decomposed again.

    Where the plan gives nothing for a text, the text comes back as it came.
    """
    work = "_composed"
    while work in df.columns:
        work = f"_{work}"
    composed = with_form(df, column, work, "NFC")
    out = with_form(engine.accentuate(composed, work, work, "combining_acute"), work, work, "NFKD")
    return out.select(*[c for c in df.columns if c != into], F.coalesce(work, column).alias(into))
