"""The engine's functions for SQL text: ``SELECT stress_normalize(text) FROM documents``."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import Engine
from . import text as T
from . import words as W
from .sentences import sentences
from .tokenizers import CharTokenizer

# Name, argument, and the column expression that the function stands for.
EXPRESSIONS: dict[str, Callable[[Column], Column]] = {
    "stress_normalize": T.normalize,
    "stress_normalize_keep_plus": T.normalize_keep_plus,
    "stress_canonical_marks": T.canonical_marks,
    "stress_has_marks": T.has_marks,
    "stress_plus_to_acute": T.plus_to_acute,
    "stress_close_up": T.close_up,
    "stress_count_vowels": T.count_vowels,
    "stress_sentences": sentences,
    "stress_words": W.words,
    "stress_gaps": W.gaps,
    "stress_bert_words": W.bert_words,
}


def expand(spark: SparkSession, table: str, column: str, names: list[str] | None = None, view: str | None = None) -> DataFrame:
    """A view of ``table`` with a column for each named function of ``column``; unused ones cost nothing."""
    rows = spark.table(table)
    out = rows.select("*", *[EXPRESSIONS[n](F.col(column)).alias(n) for n in names or EXPRESSIONS])
    out.createOrReplaceTempView(view or f"{table}_stress")
    return out


def register(spark: SparkSession) -> None:
    """Registers ``stress_char_ids(word)`` and a SQL function for each expression that SQL can write down."""
    tokenizer = CharTokenizer()

    @F.arrow_udf("array<int>")
    def char_ids(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else tokenizer.encode(w) for w in words.to_pylist()], pa.list_(pa.int32()))

    spark.udf.register("stress_char_ids", char_ids)
    arg = "x"
    for name in ("stress_normalize", "stress_has_marks", "stress_plus_to_acute", "stress_close_up", "stress_count_vowels", "stress_canonical_marks", "stress_words", "stress_bert_words"):
        body = _sql_of(name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg} STRING) RETURN {body}")


def _raw(value: str) -> str:
    return 'r"' + value.replace('"', r"\x22") + '"'


def _sql_of(name: str) -> str:
    from . import charsets as C

    vowel = f"[{C.VOWELS}]"
    if name == "stress_normalize":
        return f"regexp_replace(x, {_raw(f'[^{C.KEPT}]')}, '')"
    if name == "stress_has_marks":
        return f"x RLIKE {_raw(rf'{vowel}{C.ACUTE}|\+{vowel}')}"
    if name == "stress_plus_to_acute":
        return f"replace(regexp_replace(x, {_raw(r'(?s)\+(.)')}, '$1{C.ACUTE}'), '+', '')"
    if name == "stress_canonical_marks":
        once = f"regexp_replace(x, {_raw(f'({vowel}){C.ACUTE}')}, '+$1')"
        return f"replace(regexp_replace({once}, {_raw(f'({vowel}){C.ACUTE}')}, '+$1'), '{C.ACUTE}', '')"
    if name == "stress_count_vowels":
        return f"length(regexp_replace(x, {_raw(f'[^{C.VOWELS}]')}, ''))"
    if name == "stress_words":
        return f"regexp_extract_all(replace(x, ' - ', ' ~ '), {_raw(W.TOKEN)}, 0)"
    if name == "stress_bert_words":
        clean = f"regexp_replace(regexp_replace(regexp_replace(x, {_raw(C.BERT_CONTROL)}, ''), {_raw(r'[\t\n\r\p{Zs}]')}, ' '), {_raw(f'([{C.CJK}])')}, ' $1 ')"
        return f"regexp_extract_all({clean}, {_raw(rf'[^ {C.BERT_PUNCTUATION}]+|[{C.BERT_PUNCTUATION}]')}, 0)"
    out = "x"
    for c in C.CLOSE_UP:
        q = c.replace("\\", "\\\\").replace("'", "\\'")
        if c == "-":
            out = f"replace(replace({out}, ' -', '-'), '- ', '-')"
        out = f"replace({out}, ' {q}', '{q}')"
    return f"replace({out}, '~', '-')"


def stress_view(spark: SparkSession, table: str, engine: Engine, view: str, column: str = "text", notation: str = "combining_acute") -> DataFrame:
    """A view of ``table`` with its accentuated texts."""
    out = engine.accentuate(spark.table(table), column, notation=notation)
    out.createOrReplaceTempView(view)
    return out
