"""Whole texts worked out by plain functions: the same results as column expressions and as the plan by rows."""

import random

from pyspark.sql import functions as F

from accentweave import queries
from accentweave.functions import plain as P
from accentweave.functions import text as T
from accentweave.functions import words as W
from accentweave.functions.sentences import sentences
from accentweave.operators.gates import Gates, NativeAccentGate, NativeHomographGate, NativeUsageGate, NativeYoGate
from accentweave.plans.engine import Engine, Options
from accentweave.sources.lexicon import Lexicon

PIECES = [*"аеёкЗяQz7I .,!?:;'(){}[]«»„“”—-+", " ", " ", " - ", ". ", "! ", "т.е. ", "г. ", "1) ", "а) ", ":-) ", ";)", ". — и", "\n", "\xa0", " ", "\x0b", "им. ", "Замок ", "ежик ", "все ", "Небо "]
OTHER = ["ы́", "́", "+о", "é", "_", "²", "…", "\U0001f600", "а́+б"]


def texts(n, pieces, seed):
    rng = random.Random(seed)
    return ["", " ", "мама. Дом", *("".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(n))]


def lexicon_of(spark):
    return Lexicon.of(spark, [("ежик", "+ежик"), ("ёжик", "+ёжик"), ("з", "з"), ("зая", "з+а+я")], [("замок", ["з+амок", "зам+ок"]), ("всё", ["всё", "вс+ё"])], [("ежик", "ёжик"), ("все", "всё")], [("небо", "нёбо"), ("все", "всё")]).with_builtins()


def test_plain_functions(spark):
    rows = [T_ for T_ in map(P.normalize, texts(400, PIECES + OTHER, 1))] + [t.replace("_", "") for t in texts(400, PIECES, 2)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    t = F.col("t")
    got = table.select("i", sentences(t).alias("s"), W.words(t).alias("w"), W.gaps(t).alias("g"), W.bert_words(t).alias("b"), T.close_up(t).alias("c"), T.plus_to_acute(t).alias("a"), T.normalize(t).alias("n"))
    for r in got.collect():
        text = rows[r["i"]]
        words, gaps = P.words_and_gaps(text)
        assert (r["s"], r["w"], r["b"]) == (P.sentences(text), words, P.bert_words(text)), text
        assert gaps == (r["g"] if words else [""]) and P.tokens(text) == [w for s in r["s"] for w in P.words_and_gaps(s)[0]], text
        assert (r["c"], r["a"], r["n"]) == (P.close_up(text), P.plus_to_acute(text), P.normalize(text)), text
        some = [w for w in words if w]
        assert [P.marker(some, 0)(i) for i in range(len(some))] == [P.mark_word(some, i) for i in range(len(some))], text


def by_rows(engine):
    """An engine that takes the other way, as for gates that are no plain functions."""

    class ByRows(Engine):
        def _plain_gates(self):
            return None

    return ByRows(engine.lexicon, engine.gates, engine.options, engine.broadcast_bytes)


def test_same_as_by_rows(spark):
    table = spark.createDataFrame([(t,) for t in texts(150, PIECES + OTHER, 3)] + [(None,)], "text string")
    full = Gates(NativeUsageGate(), NativeYoGate(), NativeHomographGate(), NativeAccentGate())
    lexicon = lexicon_of(spark)
    for engine in (Engine(lexicon), Engine(lexicon, full), Engine(lexicon, full, Options(accent_scorer=False))):
        assert engine._plain_gates()
        assert sorted(engine.accentuate(table).collect(), key=str) == sorted(by_rows(engine).accentuate(table).collect(), key=str)
    engine = Engine(lexicon, full)
    assert sorted(engine.trace(table).collect(), key=str) == sorted(by_rows(engine).trace(table).collect(), key=str)


def test_words_are_not_rows(spark):
    """No word of a text goes through an exchange or a join: only the distinct words of a part do."""
    table = spark.createDataFrame([("дом " * 5000 + str(i),) for i in range(20)], "text string")
    plan = Engine(lexicon_of(spark)).accentuate(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan and "posexplode" not in plan


def test_test_tables(spark):
    """The documents and the vocabulary are what column expressions make of them."""
    folder = "/root/testdata/sf0.001"
    assert sorted(queries._plain_docs(spark, folder).where("text is not null").collect()) == sorted(queries._docs(spark, folder, "text").collect())
    each = queries._tokens(spark, folder).select(F.lower("word").alias("word")).where(F.col("word").rlike("^[а-яё]+$") & (T.count_vowels(F.col("word")) > 0)).distinct()
    assert sorted(queries._words(spark, folder).collect()) == sorted(each.collect())
