"""The engine's operators bound to the test tables, with the SQL that each must agree with.

The tables hold Latin text; it is put into Cyrillic letter by letter, the same way in both engines. Dictionaries are
derived from the documents' own words by fixed rules: the first or last vowel is stressed, every word whose length
is a multiple of seven has both readings, and so on.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import charsets as C
from .functions import plain as P
from .functions import text as T
from .functions import words as W
from .functions.composed import with_form
from .functions.sentences import sentences
from .functions.tokenizers import WordPieceTokenizer
from .operators import lookups, probe
from .operators.gates import Gates, NativeAccentGate, NativeHomographGate, NativeUsageGate, NativeYoGate
from .operators.homographs import candidates, resolve
from .operators.scorers import words_from_token_scores
from .plans.engine import Engine
from .sources.lexicon import Lexicon, byte_order, lower_unique, overlay, read_json_map, sampled, validate
from .sources.pack import read_pack, write_pack

LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абцдефгхийклмнопярстуввхыз"
_ASCII, _LETTERS = re.compile("[\x00-\x7f]+"), bytes.maketrans((LATIN + LATIN.upper()).encode(), (CYRILLIC + CYRILLIC.upper()).encode("cp1251"))
# As ``words.TOKEN``; Python's ``\w`` is letters, numbers and ``_`` too.
_ANY_TOKEN, _RUSSIAN = re.compile(W.TOKEN.replace(f"[{C.WORD}]", r"\w").replace(C.WORD, r"\w").replace(C.SPACE, r"\t-\r \x85\xa0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000")), re.compile("[а-яА-ЯёЁ]+")
_V = f"[{C.VOWELS}]"
_NV = f"[^{C.VOWELS}]"


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of fewer file splits than there are cores, dealt out evenly; a larger one as it is."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def _docs(spark: SparkSession, sf_dir: str, column: str = "t") -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).where("text is not null")
    return docs.select("doc_id", F.translate("text", LATIN + LATIN.upper(), CYRILLIC + CYRILLIC.upper()).alias(column))


def _cyrillic(text: str) -> str:
    return _ASCII.sub(lambda m: m[0].encode().translate(_LETTERS).decode("cp1251"), text)


def _plain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` of all rows, as :func:`_docs` has it; put into Cyrillic a stretch at a time and not letter by letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t and _cyrillic(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.make_valid_utf8("text").alias("text"))
    # Dealt out in any case: a file of few row groups has more splits than tasks that get rows.
    docs = docs.repartition(max(4 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()))
    return docs.mapInArrow(run, docs.schema)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode_outer(W.words(F.col("t"))).alias("pos", "word")).where("word is not null")


_VOCABULARIES: dict[tuple[str, str], DataFrame] = {}


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that dictionaries are made of, kept in the session as a dictionary's table would be on disk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = _words(spark, sf_dir).persist()
    return _VOCABULARIES[key]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lower-case words of Cyrillic letters with a vowel; equal ones are one in each task before any is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()

        def kept() -> pa.RecordBatch:
            low = {w.lower() for w in seen if _RUSSIAN.fullmatch(w)}
            return pa.RecordBatch.from_arrays([pa.array([w for w in low if P.has_vowel(w)], pa.string())], names=["word"])

        for b in batches:
            for text in b.column(0):
                seen.update(_ANY_TOKEN.findall(text.as_py().replace(" - ", " ~ ")))
            if len(seen) > 1 << 20:
                yield kept()
                seen.clear()
        yield kept()

    return _plain_docs(spark, sf_dir).where("text is not null").select("text").mapInArrow(run, "word string").distinct()


def _first_vowel(word: Column) -> Column:
    return F.regexp_replace(word, f"^({_NV}*)({_V})", "$1+$2")


def _last_vowel(word: Column) -> Column:
    return F.regexp_replace(word, f"({_V})({_NV}*)$", "+$1$2")


def _accents(words: DataFrame) -> DataFrame:
    w = F.col("word")
    return words.where(F.length(w) % 3 != 0).select("word", F.when(F.length(w) % 2 == 0, _last_vowel(w)).otherwise(_first_vowel(w)).alias("stressed"))


def _omographs(words: DataFrame) -> DataFrame:
    return words.where((F.length("word") % 7 == 0) & (T.count_vowels(F.col("word")) > 1)).select("word", F.array(_first_vowel(F.col("word")), _last_vowel(F.col("word"))).alias("variants"))


def _yo_words(words: DataFrame) -> DataFrame:
    return words.where((F.length("word") % 5 == 0) & F.col("word").contains("е")).select("word", F.regexp_replace("word", "^([^е]*)е", "$1ё").alias("form"))


def data_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    words = _vocabulary(spark, sf_dir)
    homographs = words.where((F.length("word") % 3 == 0) & F.col("word").contains("е")).select("word", F.translate("word", "е", "ё").alias("form"))
    return Lexicon(_accents(words), _omographs(words), _yo_words(words), homographs)


def _text(value: Column) -> list[Column]:
    return [F.length(value).alias("n_chars"), F.md5(value).alias("digest")]


# Scalar functions -------------------------------------------------------------------------------------------


def normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *_text(T.normalize(F.col("t"))))


def normalize_keep_plus(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *_text(T.normalize_keep_plus(F.replace("t", F.lit("e "), F.lit("+")))))


def hyphen_swap(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *_text(T.hyphen_to_tilde(F.replace("t", F.lit(", "), F.lit(" - ")))))


def strip_space(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *_text(T.strip(F.concat(F.lit(" \t\xa0"), "t", F.lit("\n ")))))


def find_word(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.find(F.col("t"), F.lit("тхе"), 3).cast("long").alias("place"))


def count_vowels(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.count_vowels(F.col("t")).cast("long").alias("n_vowels"))


def has_punctuation(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy(T.has_punctuation(F.col("word")).alias("has_punct")).agg(F.count("*").alias("n"))


def delete_spaces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *_text(T.close_up(F.regexp_replace("t", r"([.,(-])", " $1 "))))


def strip_space_before_punc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *_text(T.close_up_plain(F.regexp_replace("t", r"([.,])", " \n$1"))))


def fix_capital(spark, sf_dir):
    words = _tokens(spark, sf_dir).select("word").distinct()
    return words.select("word", T.fix_capital(F.col("word"), F.translate(F.lower("word"), "е", "ё")).alias("fixed"))


def insert_plus(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("word", T.insert_plus(F.col("word"), F.length("word") % 3).alias("marked"))


def put_yo(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("word", T.put_yo(F.col("word"), F.array(F.lit(1), F.lit(3))).alias("form"))


def remap_plus(spark, sf_dir):
    words = _tokens(spark, sf_dir).select("word").distinct().where(F.col("word").rlike("^[а-яА-ЯёЁ]+$"))
    return words.select("word", T.remap_plus(F.col("word"), _first_vowel(F.lower("word"))).alias("marked"))


def manual_canonicalize(spark, sf_dir):
    marked = F.regexp_replace("t", f"({_V})н", f"$1{C.ACUTE}н")
    return _docs(spark, sf_dir).select("doc_id", *_text(T.canonical_marks(marked)), T.has_marks(marked).alias("marked"))


def notation_acute(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *_text(T.render(F.concat(F.regexp_replace("t", f"({_V})т", "+$1т"), F.lit("+")))))


def softmax_argmax(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    p = rows.select("vec_id", T.argmax(F.col("z")).cast("long").alias("best"), F.posexplode(T.softmax(F.col("z"))).alias("pos", "p"))
    return p.select("vec_id", "best", F.col("pos").cast("long").alias("pos"), F.round("p", 9).alias("p"))


def char_classes(spark, sf_dir):
    """What every character that occurs is."""
    chars = _docs(spark, sf_dir).select(F.explode(F.split(F.concat("t", F.lit("\xa0\u2003_Ёё٣Ⅳ²")), "")).alias("c")).where("c <> ''").distinct()
    c = F.col("c")
    return chars.select(F.hex(F.encode("c", "UTF-8")).alias("c"), T.is_space(c).alias("space"), T.is_digit(c).alias("digit"), T.is_word(c).alias("word"), T.is_upper(c).alias("upper"))


def composed(spark, sf_dir):
    """Text with decomposed letters, put together again."""
    apart = F.replace(F.replace("t", F.lit("й"), F.lit("и\u0306")), F.lit("е"), F.lit("е\u0308"))
    return with_form(_docs(spark, sf_dir).select("doc_id", apart.alias("apart")), "apart", "whole", "NFC").select("doc_id", *_text(F.col("whole")))


# Words and sentences ----------------------------------------------------------------------------------------


def word_split(spark, sf_dir):
    parts = _docs(spark, sf_dir).select("doc_id", W.words(F.col("t")).alias("w"), W.gaps(F.col("t")).alias("g"))
    return parts.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", "|")).alias("words"), F.md5(F.array_join("g", "|")).alias("gaps"))


def words_exploded(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def reassemble(spark, sf_dir):
    parts = _docs(spark, sf_dir).select("doc_id", W.words(F.col("t")).alias("w"), W.gaps(F.col("t")).alias("g"))
    return parts.select("doc_id", *_text(W.reassemble(F.col("w"), F.col("g"))), F.md5(W.reassemble(F.col("w"), F.col("g"), last_gap=False)).alias("without_last_gap"))


def bert_words(spark, sf_dir):
    parts = _docs(spark, sf_dir).select("doc_id", W.bert_words(F.col("t")).alias("b"), F.size(W.words(F.col("t"))).cast("long").alias("n_words"))
    return parts.select("doc_id", F.size("b").cast("long").alias("n_labels"), "n_words", F.md5(F.array_join("b", "|")).alias("digest"))


def char_tokens(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("word", F.array_join(F.transform(W.char_ids(F.col("word")), lambda i: i.cast("string")), " ").alias("ids"))


def sentence_split(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "t", sentences(F.col("t")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), (F.array_join("s", "") == F.col("t")).alias("lossless"), F.md5(F.array_join("s", "|")).alias("digest"))


def sentences_exploded(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode_outer(sentences(F.col("t"))).alias("sent", "sentence"))


# Dictionaries -----------------------------------------------------------------------------------------------


def lexicon_accents(spark, sf_dir):
    return _accents(_vocabulary(spark, sf_dir))


def lexicon_dedup(spark, sf_dir):
    words = _tokens(spark, sf_dir).groupBy("word").agg((F.min("doc_id") * 100000 + F.length("word")).alias("ord"))
    return lower_unique(words.select("word", F.concat("word", F.lit("!")).alias("value"), "ord"))


def lexicon_overlay(spark, sf_dir):
    words = _vocabulary(spark, sf_dir)
    return overlay(_accents(words), words.where(F.length("word") % 4 == 0).select("word", F.col("word").alias("stressed")))


def lexicon_validate(spark, sf_dir):
    words = _vocabulary(spark, sf_dir)
    source = words.select("word", _first_vowel(F.col("word")).alias("value"))
    return validate(source, _accents(words)).withColumn("match_rate", F.round("match_rate", 9))


def key_order(spark, sf_dir):
    """The place of each key by its UTF-8 bytes, by lengths so that no single sort of all keys is needed."""
    by = Window.partitionBy(F.length("word")).orderBy("word")
    return _vocabulary(spark, sf_dir).select("word", F.row_number().over(by).cast("long").alias("place"))


def global_key_order(spark, sf_dir):
    return byte_order(_vocabulary(spark, sf_dir))


def seeded_sample(spark, sf_dir):
    """A sample of the dictionary and two words that are always in it."""
    return sampled(_accents(_vocabulary(spark, sf_dir)), 200, 44238, ["тхе", "оф", "анд"]).select("word", "stressed")


def _scratch(spark: SparkSession) -> str:
    """A folder for a query's own files: a new one in the folder that ``spark.checkpoint.dir`` names, in local tests in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="accentweave-")


def _packed(table: DataFrame, dictionary: str) -> DataFrame:
    path = f"{_scratch(table.sparkSession)}/{dictionary}.rapack"
    write_pack(table, path, dictionary)
    return read_pack(table.sparkSession, path, dictionary)


def pack_accents(spark, sf_dir):
    """Written as a binary pack and read again."""
    return _packed(_accents(_vocabulary(spark, sf_dir)), "accents")


def pack_omographs(spark, sf_dir):
    return _packed(_omographs(_vocabulary(spark, sf_dir)), "omographs").select("word", F.array_join("variants", "|").alias("variants"))


def pack_yo_words(spark, sf_dir):
    return _packed(_yo_words(_vocabulary(spark, sf_dir)), "yo_words")


def json_accents(spark, sf_dir):
    """Written as one gzipped JSON object, as dictionaries are laid down, and read again."""
    path = f"{_scratch(spark)}/accents"
    entries = _accents(_vocabulary(spark, sf_dir)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "stressed")))))
    entries.write.option("compression", "gzip").text(path)
    return read_json_map(spark, path).select("word", F.col("value").alias("stressed"))


def wordpiece_tokens(spark, sf_dir):
    """The words in pieces: three letters at the beginning, then pairs that some word ends in, else single letters."""
    words = _vocabulary(spark, sf_dir)
    pieces = words.select(F.explode(F.array(F.substring("word", 1, 3), F.concat(F.lit("##"), F.substring("word", -2, 2)))).alias("p")).where(F.length(F.replace("p", F.lit("##"), F.lit(""))) + F.col("p").startswith("##").cast("int") == 3)
    letters = [lead + c for lead in ("", "##") for c in C.VOWELS + "бвгджзйклмнпрстфхцчшщъь" if c == c.lower()]
    known = sorted({*letters, *(r["p"] for r in pieces.distinct().collect())})  # of at most three letters
    tokenizer = WordPieceTokenizer({p: i for i, p in enumerate(known, 4)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(tokenizer.encode(w).tokens[1:-1]) for w in b.column(0).to_pylist()])], names=["word", "pieces"])

    return words.mapInArrow(cut, "word string, pieces string")


def score_probe(spark, sf_dir):
    """Vectors as logits, as they are and rounded, against the places of their largest components."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("case"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    unit = lambda name, logits, ms: rows.select(F.lit(name).alias("unit"), "case", logits.alias("logits"), ms.cast("double").alias("ms"))
    runs = unit("whole", F.col("logits"), F.col("case") % 7).unionByName(unit("rounded", F.transform("logits", lambda x: F.floor(x * 8) / 8), F.col("case") % 5))
    got = probe.summary(runs, rows.select("case", T.argmax(F.col("logits")).alias("best")), "whole")
    return got.select("unit", "cases", "hits", F.round("mean_ms", 9).alias("mean_ms"), F.round("max_abs_diff", 9).alias("max_abs_diff"))


def accent_lookup(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    found = lookups.lookup(tokens, _accents(_vocabulary(spark, sf_dir)), F.lower("word"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count("stressed").alias("n_hits"), F.sum(F.coalesce(F.nullif(F.instr("stressed", "+"), F.lit(0)) - 1, F.lit(0))).alias("places"))


def yo_restore(spark, sf_dir):
    tokens = _tokens(spark, sf_dir).select("word").distinct()
    found = lookups.lookup(tokens, _yo_words(_vocabulary(spark, sf_dir)), F.lower("word"))
    return found.select("word", lookups.restore_yo(F.col("word"), F.col("form")).alias("restored"))


def accent_route(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    found = lookups.lookup(tokens, _accents(_vocabulary(spark, sf_dir)), F.lower("word"))
    marked = F.when(F.col("word").contains("+"), "marked").when(lookups.needs_scorer(F.col("word"), F.col("stressed")), "scorer").when(F.col("stressed").isNull(), "bare").otherwise("dictionary")
    return found.groupBy(marked.alias("route")).agg(F.count("*").alias("n"), F.countDistinct("word").alias("n_words"))


def oov_words(spark, sf_dir):
    tokens = _tokens(spark, sf_dir).select(F.lower("word").alias("word"), "doc_id")
    return tokens.join(_accents(_vocabulary(spark, sf_dir)), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


def positional_labels(spark, sf_dir):
    """Labels by place, drifting where a run of signs is one word and several pre-tokens."""
    rows = _docs(spark, sf_dir).select("doc_id", NativeUsageGate().column(F.col("t")).alias("labels"), W.words(F.col("t")).alias("w"))
    each = rows.select("doc_id", "labels", F.posexplode_outer("w").alias("pos", "word")).where("word is not null").select("doc_id", lookups.label_at(F.col("labels"), F.col("pos")).alias("label"))
    return each.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def _short_sentences(spark, sf_dir) -> DataFrame:
    """Lines as sentences, their words looked up as homographs."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("t", "\n")).alias("sent", "line")).where("line <> ''")
    words = lines.select("doc_id", "sent", F.posexplode(W.words(F.col("line"))).alias("pos", "word"))
    found = lookups.lookup(words, _omographs(_vocabulary(spark, sf_dir)), F.lower("word"))
    return found.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "variants"))).alias("entries"))


def homograph_candidates(spark, sf_dir):
    found = candidates(_short_sentences(spark, sf_dir), ["doc_id", "sent"])
    return found.select("doc_id", "sent", "pos", "variant_no", "variant", F.md5("marked").alias("marked"))


def homograph_choice(spark, sf_dir):
    return resolve(_short_sentences(spark, sf_dir), NativeHomographGate(), ["doc_id", "sent"])


def subword_average(spark, sf_dir):
    """Words of pieces of three letters, with scores taken from the vectors by place."""
    words = _docs(spark, sf_dir).select("doc_id", F.posexplode(W.words(F.col("t"))).alias("k", "word"))
    cut = words.select("doc_id", "k", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / 3)), lambda i: F.substring("word", i * 3 + 1, F.lit(3)))).alias("i", "piece"))
    tokens = cut.select(
        "doc_id",
        (F.col("k") * 100 + F.col("i")).alias("pos"),
        F.when(F.col("i") > 0, F.concat(F.lit("##"), "piece")).otherwise(F.col("piece")).alias("token"),
        (F.col("k") * 1000 + F.col("i") * 3).alias("start"),
        (F.col("k") * 1000 + F.col("i") * 3 + F.length("piece")).alias("end"),
        F.lit(0).alias("special"),
        F.transform(F.array(*[F.lit(k) for k in (3, 5, 7)]), lambda m: ((F.col("k") * 31 + F.col("i") * 17 + F.length("piece")) % (m + 8)) / F.lit(16.0)).alias("scores"),
    )
    found = words_from_token_scores(tokens, C.USAGE_LABELS, ["doc_id"])
    return found.select("doc_id", F.col("word").cast("long").alias("word"), "label", F.col("label_index").cast("long").alias("label_index"), F.round("score", 9).alias("score"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.array_join("tokens", "|").alias("pieces"))


# The whole plan ---------------------------------------------------------------------------------------------


def accentuate_dictionary(spark, sf_dir):
    """Dictionary only: ё, then stress by lookup."""
    return Engine(data_lexicon(spark, sf_dir)).accentuate(_plain_docs(spark, sf_dir), notation="plus").select("doc_id", "accentuated")


def accentuate_full(spark, sf_dir):
    """All four stages with deterministic stand-ins for the scorers."""
    gates = Gates(NativeUsageGate(), NativeYoGate(), NativeHomographGate(), NativeAccentGate())
    return Engine(data_lexicon(spark, sf_dir), gates).accentuate(_plain_docs(spark, sf_dir)).select("doc_id", "accentuated")


def accentuate_trace(spark, sf_dir):
    """Every intermediate, per sentence."""
    gates = Gates(NativeUsageGate(), NativeYoGate(), NativeHomographGate(), NativeAccentGate())
    return Engine(data_lexicon(spark, sf_dir), gates).trace(_plain_docs(spark, sf_dir))


# SQL --------------------------------------------------------------------------------------------------------


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_D = f"(SELECT doc_id, translate(text, '{LATIN}{LATIN.upper()}', '{CYRILLIC}{CYRILLIC.upper()}') AS t FROM documents WHERE text IS NOT NULL)"


def _sql_words(t: str) -> str:
    return f"regexp_extract_all(replace({t}, ' - ', ' ~ '), {_q(W.TOKEN)})"


_TOK = f"(SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_sql_words('t')} AS w FROM {_D}))"
_NVOW = f"length(regexp_replace(word, {_q('[^' + C.VOWELS + ']')}, '', 'g'))"
_VOC = f"(SELECT DISTINCT word FROM (SELECT lower(word) AS word FROM {_TOK}) WHERE regexp_matches(word, '^[а-яё]+$') AND {_NVOW} > 0)"
_FIRST = f"regexp_replace(word, '^({_NV}*)({_V})', '\\1+\\2')"
_LAST = f"regexp_replace(word, '({_V})({_NV}*)$', '+\\1\\2')"
_ACC = f"(SELECT word, CASE WHEN length(word) % 2 = 0 THEN {_LAST} ELSE {_FIRST} END AS stressed FROM {_VOC} WHERE length(word) % 3 <> 0)"
_OMO = f"(SELECT word, [{_FIRST}, {_LAST}] AS variants FROM {_VOC} WHERE length(word) % 7 = 0 AND {_NVOW} > 1)"
_YO = f"(SELECT word, regexp_replace(word, '^([^е]*)е', '\\1ё') AS form FROM {_VOC} WHERE length(word) % 5 = 0 AND contains(word, 'е'))"


def _sql_text(value: str) -> str:
    return f"SELECT doc_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT doc_id, {value} AS x FROM {_D})"


def _sql_close_up(t: str) -> str:
    for c in C.CLOSE_UP:
        if c == "-":
            t = f"replace(replace({t}, ' -', '-'), '- ', '-')"
        t = f"replace({t}, {_q(' ' + c)}, {_q(c)})"
    return f"replace({t}, '~', '-')"


def _sql_fix(source: str, target: str) -> str:
    letter = f"CASE WHEN {source}[i] = upper({source}[i]) AND {source}[i] <> lower({source}[i]) THEN upper({target}[i]) ELSE lower({target}[i]) END"
    return f"CASE WHEN length({source}) <> length({target}) THEN {target} ELSE array_to_string([{letter} FOR i IN range(1, length({source}) + 1)], '') END"


_ROUTED = f"(SELECT t.word, a.stressed FROM {_TOK} t LEFT JOIN {_ACC} a ON lower(t.word) = a.word)"
_HAS_PUNCT = r"regexp_matches(word, '[!-/:-@\[-`{-~]')"
_BERT = rf"regexp_extract_all(regexp_replace(regexp_replace(t, '[\x{{0}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}\x{{7f}}-\x{{9f}}\x{{FFFD}}]', '', 'g'), '[\t\n\r\p{{Zs}}]', ' ', 'g'), {_q(f'[^ {C.BERT_PUNCTUATION}]+|[{C.BERT_PUNCTUATION}]')})"
_LINES = f"(SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS sent FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM {_D}))"
_CAND = f"""(WITH s AS (SELECT doc_id, sent, {_sql_words('line')} AS w FROM {_LINES} WHERE line <> ''),
 e AS (SELECT doc_id, sent, w, unnest(w) AS word, unnest(range(len(w))) AS pos FROM s),
 c AS (SELECT e.*, o.variants, {_sql_close_up("array_to_string([CASE WHEN i - 1 = pos THEN ' <w>' || w[i] || '</w> ' ELSE w[i] END FOR i IN range(1, len(w) + 1)], ' ')")} AS marked FROM e JOIN {_OMO} o ON lower(e.word) = o.word)
 SELECT doc_id, sent, pos, marked, unnest(variants) AS variant, unnest(range(len(variants))) AS variant_no FROM c)"""
_PIECES = f"""(WITH w AS (SELECT doc_id, {_sql_words('t')} AS l FROM {_D}),
 k AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS k FROM w)
 SELECT doc_id, k, i, substr(word, i * 3 + 1, 3) AS piece FROM k, unnest(range((length(word) - 1) // 3 + 1)) AS u(i))"""

ORACLES = {
    "normalize": _sql_text(f"regexp_replace(t, {_q('[^' + C.KEPT + ']')}, '', 'g')"),
    "normalize_keep_plus": _sql_text(
        f"replace(regexp_replace(regexp_replace(regexp_replace(replace(t, 'e ', '+'), '([{C.WORD}])\\+([{C.WORD}])', '\\1\x1f\\2', 'g'), '([{C.WORD}])\\+([{C.WORD}])', '\\1\x1f\\2', 'g'), {_q('[^' + chr(31) + C.KEPT + ']')}, '', 'g'), '\x1f', '+')"
    ),
    "hyphen_swap": _sql_text("replace(replace(t, ', ', ' - '), ' - ', ' ~ ')"),
    "strip_space": _sql_text(f"regexp_replace(' ' || chr(9) || chr(160) || t || chr(10) || ' ', {_q(f'^[{C.SPACE}]+|[{C.SPACE}]+$')}, '', 'g')"),
    "find_word": f"SELECT doc_id, CASE WHEN instr(substr(t, 4), 'тхе') = 0 THEN -1 ELSE instr(substr(t, 4), 'тхе') + 2 END::BIGINT AS place FROM {_D}",
    "count_vowels": f"SELECT doc_id, length(regexp_replace(t, {_q(_NV)}, '', 'g'))::BIGINT AS n_vowels FROM {_D}",
    "has_punctuation": f"SELECT {_HAS_PUNCT} AS has_punct, count(*) AS n FROM {_TOK} GROUP BY 1",
    "delete_spaces": _sql_text(_sql_close_up(r"regexp_replace(t, '([.,(-])', ' \1 ', 'g')")),
    "strip_space_before_punc": _sql_text(rf"regexp_replace(regexp_replace(t, '([.,])', ' ' || chr(10) || '\1', 'g'), '[{C.SPACE}]+([{C.CLOSE_UP_PLAIN}])', '\1', 'g')"),
    "fix_capital": f"SELECT word, {_sql_fix('word', 'form')} AS fixed FROM (SELECT DISTINCT word, replace(lower(word), 'е', 'ё') AS form FROM {_TOK})",
    "insert_plus": f"SELECT word, substr(word, 1, length(word) % 3) || '+' || substr(word, length(word) % 3 + 1) AS marked FROM {_VOC}",
    "put_yo": f"SELECT word, array_to_string([CASE WHEN i IN (2, 4) AND word[i] = 'е' THEN 'ё' ELSE word[i] END FOR i IN range(1, length(word) + 1)], '') AS form FROM {_VOC}",
    "remap_plus": f"SELECT word, CASE WHEN instr(m, '+') = 0 THEN word ELSE substr(word, 1, instr(m, '+') - 1) || '+' || substr(word, instr(m, '+')) END AS marked FROM (SELECT w AS word, {_FIRST} AS m FROM (SELECT DISTINCT word AS w, lower(word) AS word FROM {_TOK} WHERE regexp_matches(word, '^[а-яА-ЯёЁ]+$')))",
    "manual_canonicalize": f"SELECT doc_id, length(x) AS n_chars, md5(x) AS digest, marked FROM (SELECT doc_id, replace(regexp_replace(m, '({_V}){C.ACUTE}', '+\\1', 'g'), '{C.ACUTE}', '') AS x, regexp_matches(m, '{_V}{C.ACUTE}|\\+{_V}') AS marked FROM (SELECT doc_id, regexp_replace(t, '({_V})н', '\\1{C.ACUTE}н', 'g') AS m FROM {_D}))",
    "notation_acute": _sql_text(f"replace(regexp_replace(regexp_replace(t, '({_V})т', '+\\1т', 'g') || '+', '(?s)\\+(.)', '\\1{C.ACUTE}', 'g'), '+', '')"),
    "softmax_argmax": "SELECT vec_id, (list_position(z, m) - 1)::BIGINT AS best, unnest(range(len(z))) AS pos, round(unnest([exp(x - m) / s FOR x IN z]), 9) AS p FROM (SELECT *, list_sum([exp(x - m) FOR x IN z]) AS s FROM (SELECT vec_id, z, list_max(z) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings)))",
    "word_split": f"SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, '|')) AS words, md5(array_to_string(CASE WHEN len(w) = 0 THEN ['', ''] ELSE string_split_regex(replace(t, ' - ', ' ~ '), {_q(W.TOKEN)}) END, '|')) AS gaps FROM (SELECT doc_id, t, {_sql_words('t')} AS w FROM {_D})",
    "words_exploded": f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {_TOK} GROUP BY word",
    "reassemble": f"SELECT doc_id, length(x) AS n_chars, md5(x) AS digest, md5(y) AS without_last_gap FROM (SELECT doc_id, {_sql_close_up('b || g[len(w) + 1]')} AS x, {_sql_close_up('b')} AS y FROM (SELECT *, array_to_string([g[i] || w[i] FOR i IN range(1, len(w) + 1)], '') AS b FROM (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN ['', ''] ELSE string_split_regex(replace(t, ' - ', ' ~ '), {_q(W.TOKEN)}) END AS g FROM (SELECT doc_id, t, {_sql_words('t')} AS w FROM {_D}))))",
    "bert_words": f"SELECT doc_id, len(b)::BIGINT AS n_labels, len({_sql_words('t')})::BIGINT AS n_words, md5(array_to_string(b, '|')) AS digest FROM (SELECT doc_id, t, {_BERT} AS b FROM {_D})",
    "char_tokens": f"SELECT word, '2 ' || array_to_string([coalesce(list_position({C.CHAR_VOCABULARY[4:]!r}, word[i]) + 3, 1) FOR i IN range(1, length(word) + 1)], ' ') || ' 3' AS ids FROM {_VOC}".replace('"\'"', "''''"),
    "lexicon_accents": f"SELECT word, stressed FROM {_ACC}",
    "lexicon_dedup": f"SELECT lower(word) AS word, value FROM (SELECT word, word || '!' AS value, row_number() OVER (PARTITION BY lower(word) ORDER BY word <> lower(word), ord) AS k FROM (SELECT word, min(doc_id) * 100000 + length(word) AS ord FROM {_TOK} GROUP BY word)) WHERE k = 1",
    "lexicon_overlay": f"SELECT word, stressed FROM {_ACC} WHERE length(word) % 4 <> 0 UNION ALL SELECT word, word FROM {_VOC} WHERE length(word) % 4 = 0",
    "lexicon_validate": f"SELECT count(*) AS entries, count(*) FILTER (stressed IS NOT NULL AND stressed <> value) AS mismatches, count(*) FILTER (stressed IS NULL) AS missing, 0::BIGINT AS duplicates, round(1 - count(*) FILTER (stressed IS NULL OR stressed <> value) / count(*)::DOUBLE, 9) AS match_rate FROM (SELECT word, {_FIRST} AS value FROM {_VOC}) v LEFT JOIN {_ACC} a USING (word)",
    "key_order": f"SELECT word, row_number() OVER (PARTITION BY length(word) ORDER BY encode(word)) AS place FROM {_VOC}",
    "char_classes": f"SELECT upper(hex(encode(c))) AS c, regexp_matches(c, '^[{C.SPACE}]+$') AS space, regexp_matches(c, '^\\p{{Nd}}+$') AS digit, regexp_matches(c, '^[{C.WORD}]+$') AS word, regexp_matches(c, '^\\p{{Lu}}+$') AS upper FROM (SELECT DISTINCT unnest(string_split(t || '\xa0\u2003_Ёё٣Ⅳ²', '')) AS c FROM {_D}) WHERE c <> ''",
    "composed": _sql_text("nfc_normalize(replace(replace(t, 'й', 'и\u0306'), 'е', 'е\u0308'))"),
    "global_key_order": f"SELECT word, row_number() OVER (ORDER BY encode(word)) AS place FROM {_VOC}",
    "seeded_sample": f"SELECT word, stressed FROM {_ACC} WHERE word IN ('тхе', 'оф', 'анд') UNION SELECT word, stressed FROM (SELECT * FROM {_ACC} ORDER BY md5('44238 ' || word), word LIMIT 200)",
    "pack_accents": f"SELECT word, stressed FROM {_ACC}",
    "pack_omographs": f"SELECT word, array_to_string(variants, '|') AS variants FROM {_OMO}",
    "pack_yo_words": f"SELECT word, form FROM {_YO}",
    "json_accents": f"SELECT word, stressed FROM {_ACC}",
    "wordpiece_tokens": f"""WITH RECURSIVE v AS (SELECT word FROM {_VOC}), s AS (SELECT DISTINCT right(word, 2) AS p FROM v WHERE length(word) > 1),
 r AS (SELECT word, CASE WHEN length(word) > 2 THEN 3 ELSE 1 END AS k, CASE WHEN length(word) > 2 THEN left(word, 3) ELSE left(word, 1) END AS pieces FROM v
 UNION ALL SELECT r.word, r.k + CASE WHEN s.p IS NULL THEN 1 ELSE 2 END, r.pieces || ' ##' || coalesce(s.p, substr(r.word, r.k + 1, 1)) FROM r LEFT JOIN s ON s.p = substr(r.word, r.k + 1, 2) WHERE r.k < length(r.word))
 SELECT word, pieces FROM r WHERE k = length(word)""",
    "score_probe": "SELECT unit, count(*) AS cases, count(*) FILTER (list_position(l, list_max(l)) = list_position(z, list_max(z))) AS hits, round(avg(ms), 9) AS mean_ms, round(max(list_max([abs(l[i] - z[i]) FOR i IN range(1, len(z) + 1)])), 9) AS max_abs_diff FROM (SELECT unnest(['whole', 'rounded']) AS unit, unnest([z, [floor(x * 8) / 8 FOR x IN z]]) AS l, unnest([vec_id % 7, vec_id % 5]) AS ms, z FROM (SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings)) GROUP BY unit",
    "accent_lookup": f"SELECT doc_id, count(*) AS n_words, count(stressed) AS n_hits, sum(coalesce(nullif(instr(stressed, '+'), 0) - 1, 0))::BIGINT AS places FROM (SELECT t.doc_id, a.stressed FROM {_TOK} t LEFT JOIN {_ACC} a ON lower(t.word) = a.word) GROUP BY doc_id",
    "yo_restore": f"SELECT word, {_sql_fix('word', 'form')} AS restored FROM (SELECT t.word, coalesce(y.form, t.word) AS form FROM (SELECT DISTINCT word FROM {_TOK}) t LEFT JOIN {_YO} y ON lower(t.word) = y.word)",
    "accent_route": f"SELECT CASE WHEN contains(word, '+') THEN 'marked' WHEN coalesce(stressed, lower(word)) = lower(word) AND NOT {_HAS_PUNCT} AND {_NVOW} > 1 THEN 'scorer' WHEN stressed IS NULL THEN 'bare' ELSE 'dictionary' END AS route, count(*) AS n, count(DISTINCT word) AS n_words FROM {_ROUTED} GROUP BY 1",
    "oov_words": f"SELECT word, count(*) AS n FROM (SELECT lower(word) AS word FROM {_TOK}) WHERE word NOT IN (SELECT word FROM {_ACC}) GROUP BY word",
    "positional_labels": f"SELECT doc_id, label, count(*) AS n FROM (SELECT doc_id, CASE WHEN b[pos + 1] IS NULL THEN NULL WHEN regexp_matches(b[pos + 1], {_q(f'^[{C.BERT_PUNCTUATION}]$')}) THEN 'PUNCT' WHEN regexp_matches(b[pos + 1], '{_V}') THEN 'STRESS' ELSE 'NO_STRESS' END AS label FROM (SELECT doc_id, b, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_BERT} AS b, {_sql_words('t')} AS w FROM {_D}))) GROUP BY ALL",
    "homograph_candidates": f"SELECT doc_id, sent::INTEGER AS sent, pos::INTEGER AS pos, variant_no::INTEGER AS variant_no, variant, md5(marked) AS marked FROM {_CAND}",
    "homograph_choice": f"SELECT doc_id, sent::INTEGER AS sent, pos::INTEGER AS pos, arg_max(variant, (length(marked) * 7 + instr(variant, '+') * 13 + length(variant)) % 101 * 10 - variant_no) AS chosen FROM {_CAND} GROUP BY doc_id, sent, pos",
    "subword_average": f"SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS word, (['NO_STRESS', 'PUNCT', 'STRESS'])[list_position(p, list_max(p))] AS label, (list_position(p, list_max(p)) - 1)::BIGINT AS label_index, round(list_max(p), 9) AS score, k * 1000 AS start, k * 1000 + last AS stop, pieces FROM (SELECT doc_id, k, [avg((k * 31 + i * 17 + length(piece)) % 11 / 16.0), avg((k * 31 + i * 17 + length(piece)) % 13 / 16.0), avg((k * 31 + i * 17 + length(piece)) % 15 / 16.0)] AS p, max(i * 3 + length(piece)) AS last, string_agg(CASE WHEN i > 0 THEN '##' ELSE '' END || piece, '|' ORDER BY i) AS pieces FROM {_PIECES} GROUP BY doc_id, k)",
}

_PLAIN = [
    *(normalize, normalize_keep_plus, hyphen_swap, strip_space, find_word, count_vowels, has_punctuation, delete_spaces, strip_space_before_punc, fix_capital, insert_plus, put_yo, remap_plus),
    *(manual_canonicalize, notation_acute, softmax_argmax, word_split, words_exploded, reassemble, bert_words, char_tokens, sentence_split, sentences_exploded),
    *(lexicon_accents, lexicon_dedup, lexicon_overlay, lexicon_validate, key_order, accent_lookup, yo_restore, accent_route, oov_words, positional_labels, homograph_candidates, homograph_choice, subword_average),
    *(char_classes, composed, global_key_order, seeded_sample, pack_accents, pack_omographs, pack_yo_words, json_accents, wordpiece_tokens, score_probe),
    *(accentuate_dictionary, accentuate_full, accentuate_trace),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _PLAIN}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
