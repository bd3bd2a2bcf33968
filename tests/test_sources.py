"""Dictionaries from JSON, packs and lists; bundles on disk; SQL functions."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from accentweave.functions import sqlfuncs
from accentweave.functions import text as T
from accentweave.functions import words as W
from accentweave.sources import bundle, pack
from accentweave.sources.lexicon import Lexicon, lower_unique, overlay, positions_of, validate


def entries(table):
    return {r[0]: r[1] for r in table.collect()}


DICTIONARIES = {
    "accents": {"коса": "кос+а", "брр": "брр", "омск": "омск", "молоко": "молок+о", "замок": "з+амок", "это": "+это", **{f"слово{k}": f"сл+ово{k}" for k in range(40)}},
    "omographs": {"коса": ["кос+а"], "замок": ["з+амок", "зам+ок"], "орган": ["+орган", "орг+ан"], "икрИщ": ["икр+ищ"], "сорвалИсь": ["x"], "сорвались": ["сорвал+ись"]},
    "yo_words": {"елка": "ёлка", "ежик": "ёжик", "самолет": "самолёт", "береза": "берёза", "еще": "ещё"},
    "yo_homographs": {"бег": "бёг", "белье": "бельё", "берег": "берёг"},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("dictionaries")
    for name, table in DICTIONARIES.items():
        with gzip.open(path / f"{name}.json.gz", "wt", encoding="utf-8") as f:
            json.dump(table, f, ensure_ascii=False)
    return path


def test_json_to_tables_to_packs_and_back(spark, folder, tmp_path):
    built = Lexicon.from_json(spark, str(folder))
    assert entries(built.accents) == DICTIONARIES["accents"]
    assert entries(built.yo_words) == DICTIONARIES["yo_words"]
    assert entries(built.omographs) == {"коса": ["к+оса", "кос+а"], "замок": ["з+амок", "зам+ок"], "орган": ["+орган", "орг+ан"], "икрищ": ["икр+ищ"], "сорвались": ["сорвал+ись"]}
    assert built.problems().count() == 0
    built.write(str(tmp_path / "tables"), files=2)
    again = Lexicon.from_dir(spark, str(tmp_path / "tables"))
    for name in DICTIONARIES:
        pack.write_pack(getattr(again, name), str(tmp_path / f"packs/{name}.rapack"), name)
    packed = Lexicon.from_packs(spark, str(tmp_path / "packs"))
    for name in DICTIONARIES:
        assert entries(getattr(packed, name)) == entries(getattr(built, name))
    source = built.accents.withColumnRenamed("stressed", "value")
    assert validate(source, packed.accents).first().asDict() == {"entries": 46, "mismatches": 0, "missing": 0, "duplicates": 0, "match_rate": 1.0}
    assert {r["word"]: r["pos"] for r in positions_of(packed.accents).collect() if "слово" not in r["word"]} == {"коса": 3, "брр": None, "омск": None, "молоко": 5, "замок": 1, "это": 0}


def test_packs_are_checked():
    good = pack.encode([("слово", 2), ("брр", None)], "accents")
    assert list(pack.decode(good, "accents")) == [("брр", None), ("слово", 2)]
    for data, name in ((good[:20], "accents"), (b"XXXX" + good[4:], "accents"), (good, "omographs"), (good + b"\0", "accents"), (good[:4] + b"\1" + good[5:], "accents")):
        with pytest.raises(pack.PackError):
            list(pack.decode(data, name))
    long = [("б" * 200, ["в" * 150, "г"]), ("б" * 201, [])]
    assert list(pack.decode(pack.encode(long, "omographs"), "omographs")) == long
    assert list(pack.decode(pack.encode([("ежеее", [0, 3])], "yo_words"), "yo_words")) == [("ежеее", [0, 3])]
    assert list(pack.decode(pack.encode([], "yo_words"), "yo_words")) == []


def test_overrides(spark):
    lex = Lexicon.of(spark, accents=[("О", "x"), ("дом", "д+ом")], omographs=[("выдумка", ["a"])]).with_builtins()
    assert entries(lex.accents) == {"о": "+о", "дом": "д+ом"}
    more = lex.with_overrides(omographs=[("Выдумка", ["первое"]), ("выдумка", ["в+ыдумка", "выд+умка"])])
    assert entries(more.omographs) == {"выдумка": ["в+ыдумка", "выд+умка"], "коса": ["к+оса", "кос+а"]}
    base = spark.createDataFrame([("а", "1"), ("б", "2")], "word string, stressed string")
    assert entries(overlay(base, spark.createDataFrame([("Б", "3"), ("в", "4")], base.schema))) == {"а": "1", "б": "3", "в": "4"}
    assert entries(Lexicon.empty(spark).accents) == {}


def test_lower_case_entries_win(spark):
    rows = spark.createDataFrame([("Аб", "first", 0), ("аБ", "second", 1), ("вГ", "third", 2), ("вг", "own", 3)], "word string, value string, ord int")
    assert entries(lower_unique(rows)) == {"аб": "first", "вг": "own"}


def test_problems_are_named(spark):
    lex = Lexicon(
        spark.createDataFrame([("Дом", "д+ом"), ("кот", "кит"), ("кот", "к+от")], "word string, stressed string"),
        spark.createDataFrame([("замок", [])], "word string, variants array<string>"),
        spark.createDataFrame([("ежик", "ёжок")], "word string, form string"),
        spark.createDataFrame([], "word string, form string"),
    )
    assert sorted(tuple(r)[1:] for r in lex.problems().collect()) == [("Дом", "not lower case"), ("Дом", "not the word with a mark"), ("ежик", "not the word with ё for е"), ("замок", "no variant"), ("кот", "more than once"), ("кот", "not the word with a mark")]


def test_bundles(tmp_path):
    assert str(bundle.cache_base({"HF_HUB_CACHE": "/a", "HF_HOME": "/b", "HOME": "/c"})) == "/a"
    assert str(bundle.cache_base({"HF_HUB_CACHE": "", "HF_HOME": "/b", "HOME": "/c"})) == "/b/hub"
    assert str(bundle.cache_base({"HOME": "/c"})) == "/c/.cache/huggingface/hub" and bundle.cache_base({}) is None
    for at in ("models/org/name", "org/name", "models--org--name/snapshots/abc"):
        base = tmp_path / at.replace("/", "_")
        assert bundle.existing_bundle(base, "org/name") is None
        (base / at / "dictpack").mkdir(parents=True)
        (base / at / bundle.MARKER).write_bytes(b"x")
        assert bundle.existing_bundle(base, "org/name") == base / at
        (base / at / "onnx").mkdir()
        (base / at / "onnx/yo.onnx").write_bytes(b"x" * 130)
        assert bundle.incomplete_weights(base / at) == "onnx/yo.onnx"

        def fetch(repo, base=base, at=at):
            (base / at / "onnx").mkdir(parents=True)
            (base / at / "dictpack").mkdir()
            (base / at / bundle.MARKER).write_bytes(b"x")
            (base / at / "onnx/yo.onnx").write_bytes(b"x" * 200_000)
            return base / at

        assert bundle.verified_bundle(base, "org/name", fetch) == base / at and bundle.incomplete_weights(base / at) is None
        assert bundle.remove_bundle(base, "org/name") and not bundle.remove_bundle(base, "org/name")
        with pytest.raises(bundle.MissingResource):
            bundle.verified_bundle(base, "org/name")
    with pytest.raises(bundle.MissingResource):
        bundle.Layout.under(tmp_path).require("usage")


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    texts = ["К+оса - \"Это\" слово , и т . е . (да)", "сло́во…", "", "2+2 = 4 - 5"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    table.createOrReplaceTempView("some_texts")
    by_sql = spark.sql("SELECT stress_normalize(text) a, stress_has_marks(text) b, stress_plus_to_acute(text) c, stress_canonical_marks(text) d, stress_count_vowels(text) e, stress_words(text) f, stress_bert_words(text) g, stress_close_up(text) h FROM some_texts").collect()
    x = F.col("text")
    by_column = table.select(T.normalize(x), T.has_marks(x), T.plus_to_acute(x), T.canonical_marks(x), T.count_vowels(x), W.words(x), W.bert_words(x), T.close_up(x)).collect()
    assert [tuple(r) for r in by_sql] == [tuple(r) for r in by_column]
    assert spark.sql("SELECT stress_char_ids('Мой')").first()[0] == [2, 24, 26, 21, 3]
    assert sqlfuncs.expand(spark, "some_texts", "text", ["stress_sentences"]).columns == ["text", "stress_sentences"]
    from accentweave.plans.engine import Engine

    sqlfuncs.stress_view(spark, "some_texts", Engine(Lexicon.empty(spark)), "stressed_texts")
    assert spark.sql("SELECT count(*) FROM stressed_texts WHERE accentuated IS NOT NULL").first()[0] == 4
