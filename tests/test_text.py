"""Pure text functions against tables of known results."""

import pytest
from pyspark.sql import functions as F

from accentweave.functions import charsets as C
from accentweave.functions import text as T
from accentweave.functions import words as W
from accentweave.functions.sentences import sentence_spans, sentences
from accentweave.operators.gates import NativeUsageGate

ACUTE = "́"

SINGLE = [
    *((T.normalize, a, b) for a, b in [('a"b', "ab"), ("a'b", "a'b"), ("a…b", "ab"), ("a...b", "a...b"), ("к+оса", "коса"), ("a–b", "ab"), ("a−b", "ab"), ("a—b", "a—b"), ("a-b", "a-b")]),
    *((T.normalize, a, b) for a, b in [("ма" + ACUTE + "р", "мар"), ("наїв", "нав"), ("café", "caf"), ("«»„“”", "«»„“”"), ("‘’", ""), ("a\xa0b", "a\xa0b")]),
    *((T.normalize_keep_plus, a, b) for a, b in [("к+оса", "к+оса"), ("+это", "это"), ("a++b", "ab"), ("2+2=4", "2+24"), ("a+b+c", "a+b+c"), ("a +b", "a b")]),
    *((T.close_up, a, b) for a, b in [("слово ,", "слово,"), ("слово  ,", "слово ,"), ("a - b", "a-b"), ("a ~ b", "a - b"), ("x  -  y", "x- y"), ("нет ~ да", "нет - да")]),
    *((T.close_up_plain, a, b) for a, b in [("a  , b", "a, b"), ("a\n\xa0…", "a…"), ("a - b", "a - b")]),
    *((T.hyphen_to_tilde, a, b) for a, b in [("a - b", "a ~ b"), (" - - ", " ~ - ")]),
    *((T.strip, a, b) for a, b in [("\xa0 a b ", "a b"), ("", "")]),
    *((T.count_vowels, a, b) for a, b in [("замок", 2), ("ёжик", 2), ("ыкий", 2), ("test123", 0), ("крк", 0)]),
    *((T.has_punctuation, a, b) for a, b in [("к+оса", True), ("сло~во", True), ("замок", False), ("дом.", True)]),
    *((T.plus_to_acute, a, b) for a, b in [("м+ой", "мо" + ACUTE + "й"), ("двер+и", "двери" + ACUTE), ("+это", "э" + ACUTE + "то"), ("наш+ёл", "нашё" + ACUTE + "л"), ("abc+", "abc")]),
    *((T.canonical_marks, a, b) for a, b in [("сл+ово", "сл+ово"), ("сло" + ACUTE + "во", "сл+ово"), ("слово", "слово"), ("2+2=4", "2+2=4"), ("т" + ACUTE, "т"), ("сло" + ACUTE * 2 + "во", "сл++ово")]),
    *((T.has_marks, a, b) for a, b in [("сл+ово", True), ("сло" + ACUTE + "во", True), ("слово", False), ("2+2=4", False)]),
]


@pytest.mark.parametrize("function", sorted({f for f, _, _ in SINGLE}, key=lambda f: f.__name__), ids=lambda f: f.__name__)
def test_single(spark, function):
    cases = [(a, b) for f, a, b in SINGLE if f is function]
    table = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, a string")
    got = {r["k"]: r["x"] for r in table.select("k", function(F.col("a")).alias("x")).collect()}
    assert [(a, got[k]) for k, (a, _) in enumerate(cases)] == cases


def test_two_arguments(spark):
    rows = spark.createDataFrame([("Все", "всё"), ("ВСЕ", "всё"), ("все", "ВСЁ"), ("Их", "ихний")], "a string, b string")
    assert [r[0] for r in rows.select(T.fix_capital(F.col("a"), F.col("b"))).collect()] == ["Всё", "ВСЁ", "всё", "ихний"]
    rows = spark.createDataFrame([("Молоко", "молок+о"), ("аб", "+а+б"), ("слово", "слово"), ("брр", "брр")], "a string, b string")
    assert [r[0] for r in rows.select(T.remap_plus(F.col("a"), F.col("b"))).collect()] == ["Молок+о", "+аб+", "слово", "брр"]
    rows = spark.createDataFrame([("молоко", 5), ("омск", None), ("это", 0)], "w string, p int")
    assert [r[0] for r in rows.select(T.insert_plus(F.col("w"), F.col("p"))).collect()] == ["молок+о", "омск", "+это"]
    assert spark.range(1).select(T.find(F.lit("абвабв"), F.lit("вa"), 0), T.find(F.lit("абвабв"), F.lit("аб"), 1)).first()[:] == (-1, 3)


SPLITS = [
    ("", [], ["", ""]),
    ("   ", [], ["", ""]),
    ("...", ["..."], ["", ""]),
    ("a", ["a"], ["", ""]),
    ("+", ["+"], ["", ""]),
    ("++", ["++"], ["", ""]),
    (" - ", ["~"], [" ", " "]),
    (" - - ", ["~", "-"], [" ", " ", " "]),
    ("«Цитата».", ["«", "Цитата", "»."], ["", "", "", ""]),
    ("Текст (в скобках).", ["Текст", "(", "в", "скобках", ")."], ["", " ", "", " ", "", ""]),
    ("кто - то", ["кто", "~", "то"], ["", " ", " ", ""]),
    ("a+b+c", ["a+b+c"], ["", ""]),
    ("word+", ["word", "+"], ["", "", ""]),
    ("_x_", ["_x_"], ["", ""]),
    ("  Как дела?", ["Как", "дела", "?"], ["  ", " ", "", ""]),
    ("что-то и кто-то", ["что", "-", "то", "и", "кто", "-", "то"], ["", "", "", " ", " ", "", "", ""]),
    ("к+оса уже+", ["к+оса", "уже", "+"], ["", " ", "", ""]),
    ("Что?! Невероятно...", ["Что", "?!", "Невероятно", "..."], ["", "", " ", "", ""]),
    ("a.b.c", ["a", ".", "b", ".", "c"], ["", "", "", "", "", ""]),
]


def test_word_splits(spark):
    table = spark.createDataFrame([(k, s[0]) for k, s in enumerate(SPLITS)], "k int, t string")
    t = F.col("t")
    for r in table.select("k", W.words(t).alias("w"), W.gaps(t).alias("g"), W.reassemble(W.words(t), W.gaps(t)).alias("r"), T.close_up(T.hyphen_to_tilde(t)).alias("c")).collect():
        assert (SPLITS[r["k"]][0], r["w"], r["g"]) == SPLITS[r["k"]]
        assert len(r["g"]) == len(r["w"]) + 1 or not r["w"]
        assert r["r"] == r["c"] or not r["w"]


SPANS = [
    ("Привет мир. Как дела?", [(0, 11), (12, 21)]),
    ("Это т.е. пример.", [(0, 16)]),
    ("В 1996 г. он родился. Потом уехал.", [(0, 21), (22, 34)]),
    ("А.С. Пушкин писал стихи.", [(0, 24)]),
    ("Цена 5 руб. за штуку. Дорого!", [(0, 21), (22, 29)]),
    ("Список: 1. Первое. 2. Второе.", [(0, 10), (11, 18), (19, 29)]),
    ("Что?! Невероятно... Да!", [(0, 5), (6, 19), (20, 23)]),
    ("Сравни ст. 5 ч. 2 закона.", [(0, 25)]),
    ("Дж. Р. Р. Толкин — автор.", [(0, 25)]),
    ("Смайл :) был тут. И тут.", [(0, 17), (18, 24)]),
    ("Точка.Без пробела.После.", [(0, 24)]),
    ("  Пробелы  в  начале.  Конец.  ", [(2, 21), (23, 29)]),
    ("Да. Да. Да.", [(0, 3), (4, 7), (8, 11)]),
    ("Он сказал: «Привет.» И ушёл.", [(0, 20), (21, 28)]),
    ("", [(0, 0)]),
    ("Один.Два.Три.", [(0, 13)]),
    ("Да." + " " * 10 + "Нет.", [(0, 17)]),
    ("«Да!» — сказал он.", [(0, 18)]),
    ("1. Первое дело. 2. Второе дело.", [(0, 15), (16, 31)]),
    ("Скобка (да) Нет.", [(0, 16)]),
]


def test_sentences(spark):
    table = spark.createDataFrame([(k, s[0]) for k, s in enumerate(SPANS)], "k int, t string")
    for r in table.select("k", "t", sentence_spans(F.col("t")).alias("s"), sentences(F.col("t")).alias("x")).collect():
        assert (r["t"], [(s["start"], s["stop"]) for s in r["s"]]) == SPANS[r["k"]]
        assert "".join(r["x"]) == r["t"]


def test_sentences_lose_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", sentences(F.col("text")).alias("s"))
    assert docs.where(F.array_join("s", "") != F.col("text")).count() == 0


def test_labels_drift_from_words(spark):
    cases = [("Что?! Невероятно...", 4, 7), ("Да!!! Нет???", 4, 8), ("Текст (в скобках).", 5, 6), ("«Цитата».", 3, 4), ("Привет... мир", 3, 5), ("Ого?! замок открыт.", 5, 6)]
    table = spark.createDataFrame([c[:1] for c in cases], "t string")
    got = table.select("t", F.size(W.words(F.col("t"))), F.size(NativeUsageGate().column(F.col("t")))).collect()
    assert [tuple(r) for r in got] == cases


def test_scores(spark):
    z = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, -1.0, -2.0],)], "z array<double>")
    got = z.select(T.argmax(F.col("z")).alias("k"), F.aggregate(T.softmax(F.col("z")), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert [r["k"] for r in got] == [1, 0] and all(abs(r["s"] - 1) < 1e-12 for r in got)
    no, yes = [0.9, 0.05, 0.05], [0.1, 0.8, 0.1]
    p = F.array(*[F.array(*map(F.lit, row)) for row in [no, no, yes, [0.4, 0.5, 0.1], no, yes, no, no]])
    assert spark.range(1).select(T.accent_from_scores(F.lit("молоко"), p)).first()[0] == "м+оло+ко"


def test_put_yo(spark):
    assert spark.range(1).select(T.put_yo(F.lit("Ежелень"), F.array(F.lit(0), F.lit(4)))).first()[0] == "Ёжелёнь"


def test_vowels_are_searched_and_cases_moved_as_letter_by_letter(spark):
    words = ["", "кот", "мо", "молоко", "Ёж", "ЁЖИК", "Ежик", "вЕрх", "x", "Σας", "е-ё", "ежик", "ОДИН"]
    rows = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.fix_capital(F.col("a"), F.col("b")).alias("c"), *(T.has_vowels(F.col("a"), n).alias(f"n{n}") for n in (1, 2))).collect()
    for r in got:
        moved = "".join(y.upper() if x == x.upper() and x != x.lower() else y.lower() for x, y in zip(r["a"], r["b"], strict=False))
        assert r["c"] == (moved if len(r["a"]) == len(r["b"]) else r["b"])
        vowels = sum(c in C.VOWELS for c in r["a"])
        assert (r["n1"], r["n2"]) == (vowels > 0, vowels > 1)
