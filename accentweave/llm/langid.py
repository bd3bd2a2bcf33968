"""Language identification by averaged hashed subword embeddings.

Method. A text is folded to lower-case letters and spaces; every byte 2-, 3- and 4-gram of the whole text
is hashed to one of ``buckets`` embeddings. Their mean goes through a linear softmax. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on at most about
``per_language`` documents and ``max_bytes`` bytes of each language, whole texts of at most a 64th of that. A fifth of those are left out to calibrate, whole and
thinned to a few grams as short texts are: a temperature and a number of grams at which logits count half,
which make the probabilities honest, and for each language a rejection threshold under which at most
``false_rejects`` of its rightly named documents lie. As the mean and the softmax's input are linear,
scoring needs one table of bucket by language; its size does not depend on the corpus. A long text is scored in
pieces whose sums are added.

Edge cases. A null text, or one without a letter, is ``und`` with score 0 and is rejected. A null
``doc_id`` is scored and counts as not held out; it is never trained on. Rows without ``lang`` are
scored but not trained on. Repeated rows are scored each. With no labelled row at all every text is
``und``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_name, small_batches
from .textscan import CHUNK_BYTES, row_chunks, texts_of

UNDETERMINED = "und"
SIZES = (2, 3, 4)

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass(frozen=True)
class Model:
    """Logits per bucket, already divided by the temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray
    half: float
    bits: int


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case letters, all else spaces; Latin-1 capitals in UTF-8 are folded too."""
    out = _FOLD[data]
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 32
    return out


def gram_buckets(folded: np.ndarray, rows: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: the bucket at each byte, and where no gram of one row begins."""
    folded = folded.astype(np.uint32)
    value = folded.copy()
    for n in range(2, max(SIZES) + 1):
        value *= np.uint32(257)
        value[: max(0, len(folded) - n + 1)] += folded[n - 1 :]
        if n in SIZES:
            dead = folded == 0x20
            dead[:-1] &= folded[1:] == 0x20
            for k in range(1, n):
                ends = rows[1:] - k
                dead[ends[ends >= 0]] = True
            yield ((value + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - bits), dead


def has_letter(column: pa.Array) -> np.ndarray:
    """Which rows hold a letter of any script."""
    raw, at, valid = texts_of(column)
    out = np.zeros(len(valid), dtype=bool)
    for i, j in row_chunks(at):
        data, rows = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        if j == i + 1:
            out[i] = _ASCII_LETTER[data].any()
        else:
            ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
            out[i:j] = np.diff(ascii_letters[rows]) > 0
        for k in np.flatnonzero(~out[i:j] & (np.diff(rows) > 0)):
            out[i + k] = any(c.isalpha() for c in data[rows[k] : rows[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def sum_rows(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``rows``."""
    out = np.zeros((len(rows) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(rows) > 0)
    if len(full):
        out[full] = np.add.reduceat(values[: rows[-1]], rows[full], axis=0)
    return out


def features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row: the buckets it has and how often."""
    raw, at, _ = texts_of(column)
    for i in range(len(at) - 1):
        total = np.zeros(1 << bits, dtype=np.int64)
        data = fold(raw[at[i] : at[i + 1]])
        for buckets, dead in gram_buckets(data, np.array([0, len(data)]), bits):
            total += np.bincount(buckets[~dead], minlength=1 << bits)
        ids = np.flatnonzero(total)
        yield ids, total[ids]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labels: list[str], bags: list[tuple[np.ndarray, np.ndarray]], bits: int, dim: int = 16, epochs: int = 8, rate: float = 0.5, batch: int = 32, false_rejects: float = 0.001, seed: int = 7) -> Model:
    """Fits embeddings and softmax by SGD, then temperature and thresholds on every fifth document."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    order = rng.permutation(len(y))
    held, fit = order[::5], np.array([k for i, k in enumerate(order) if i % 5]) if len(y) >= 10 else order

    def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([bags[k][0] for k in rows])
        share = np.concatenate([bags[k][1] / max(1, bags[k][1].sum()) for k in rows]).astype(np.float32)
        return ids, share, np.concatenate([[0], np.cumsum([len(bags[k][0]) for k in rows])])

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in range(0, len(fit), batch):
            rows = fit[rng.permutation(len(fit))[:batch]] if epoch else fit[k : k + batch]
            ids, share, at = gathered(rows)
            mean = sum_rows(emb[ids] * share[:, None], at).astype(np.float32)
            wrong = _softmax(mean @ out + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong = (wrong / len(rows)).astype(np.float32)
            back = wrong @ out.T
            out -= step * (mean.T @ wrong)
            bias -= step * wrong.sum(axis=0)
            np.add.at(emb, ids, -step * len(rows) * 8 * share[:, None] * np.repeat(back, np.diff(at), axis=0))
    table = emb @ out
    use = held if len(held) else fit
    thin = [(bags[k][0], rng.multinomial(m, bags[k][1] / bags[k][1].sum())) for m in (3, 10, 30, 100) for k in use]
    logits = np.array([counts @ table[ids] / counts.sum() for ids, counts in [bags[k] for k in use] + thin]) + bias
    size = np.array([counts.sum() for _, counts in [bags[k] for k in use] + thin])
    truth = np.tile(y[use], 5)

    def loss(t: float, half: float) -> float:
        p = _softmax(logits * (size / (size + half) / t)[:, None])
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    best, half = min(((0.02 * 1.25**k, h) for k in range(30) for h in (0, 3, 10, 30, 100, 300)), key=lambda v: loss(*v))
    whole = slice(0, len(use))
    p, truth = _softmax(logits[whole] * (size / (size + half) / best)[whole, None]), truth[whole]
    thresholds = np.zeros(len(languages))
    for k in range(len(languages)):
        right = p[(p.argmax(axis=1) == k) & (truth == k), k]
        thresholds[k] = min(0.5, np.quantile(right, false_rejects)) if len(right) else 0.5
    return Model(languages, (table / best).astype(np.float32), (bias / best).astype(np.float64), thresholds, half, bits)


def predict(column: pa.Array, model: Model, piece: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the language's number or -1, its probability, and whether the model stands by it."""
    raw, at, valid = texts_of(column)
    n = len(valid)
    named, score, kept = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=bool)
    if not model.languages:
        return named, score, kept
    table = np.ascontiguousarray(model.table)
    for i, j in row_chunks(at, piece):
        data, rows = fold(raw[at[i] : at[j]]), at[i : j + 1] - at[i]
        total, count = np.zeros((j - i, len(model.languages))), np.zeros(j - i)
        # Only a row that is alone is longer than a piece; a gram belongs to the piece that it begins in.
        for begin in range(0, max(1, len(data)), piece):
            part = data[begin : begin + piece + max(SIZES) - 1]
            own = rows if len(data) <= piece else np.array([0, len(part)])
            for buckets, dead in gram_buckets(part, own, model.bits):
                dead[piece:] = True
                value = table[buckets]
                value[dead] = 0
                total += sum_rows(value, own)
                count += sum_rows(~dead, own)
        p = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) * (count / np.maximum(count + model.half, 1))[:, None])
        named[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
        kept[i:j] = score[i:j] >= model.thresholds[named[i:j]]
    letters = has_letter(column)
    named[~letters], score[~letters], kept[~letters] = -1, 0.0, False
    return named, score, kept


def sample(rows: DataFrame, label: str, per_label: int, seed: int) -> DataFrame:
    """About ``per_label`` of ``rows(doc_id, …)`` of each value of ``label``, chosen by a hash of ``doc_id``."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_label"))
    # One row a label; a model has a column for each of them.
    return rows.join(F.broadcast(counts), label).where(_chance(seed) < F.lit(float(per_label)) / F.col("n_label")).drop("n_label")


def _chance(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def bounded(rows: DataFrame, label: str, max_bytes: int, seed: int) -> DataFrame:
    """Of ``rows(doc_id, text, …)``, already a sample: one of each ``doc_id`` and text, at most ``max_bytes`` of text a label.

    Texts are taken whole; those of more than a 64th of ``max_bytes`` are left out. ``form`` is a hash of the text.
    """
    sized = rows.withColumn("form", F.xxhash64("text")).withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= max_bytes // 64)
    before = Window.partitionBy(label).orderBy(_chance(seed), "doc_id", "form").rowsBetween(Window.unboundedPreceding, 0)
    return sized.dropDuplicates(["doc_id", "form"]).withColumn("upto", F.sum("bytes").over(before)).where(F.col("upto") <= max_bytes).drop("bytes", "upto")


def fit(docs: DataFrame, trainable: Column, per_language: int = 400, max_bytes: int = 8 << 20, bits: int = 15, seed: int = 7) -> Model:
    """Trains on rows of ``docs(doc_id, text, lang)`` for which ``trainable`` holds."""
    labelled = docs.where(trainable).select("doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    rows = bounded(sample(labelled, "lang", per_language, seed).where("text is not null"), "lang", max_bytes, seed)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(batch.column(3), bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2).cast(pa.string()), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "form", "label", "ids", "counts"],
            )

    got = rows.select("doc_id", "form", "lang", "text").mapInArrow(bags, "doc_id long, form long, label string, ids array<int>, counts array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("form", "ascending"), ("label", "ascending")])
    use = [k for k, ids in enumerate(got["ids"]) if len(ids)]
    if not use:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), np.zeros(0), 0.0, bits)
    labels, ids, counts = (got[c].combine_chunks() for c in ("label", "ids", "counts"))
    del got
    flat, amount, at = ids.flatten().to_numpy(), counts.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    return train([labels[k].as_py() for k in use], [(flat[at[k] : at[k + 1]], amount[at[k] : at[k + 1]]) for k in use], bits, seed=seed)


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_kept")) -> DataFrame:
    """``docs`` with the language, its probability and whether the model stands by it, as ``names``, after its own columns.

    A column of ``docs`` that has one of these names is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in names]
    kinds = docs.select(*own).schema
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        kinds = kinds.add(name, kind)
    at = own.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            named, score, kept = predict(batch.column(at), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, languages.take(pa.array(np.where(named < 0, len(model.languages), named))), pa.array(score), pa.array(kept)], names=[*batch.schema.names, *names])

    return docs.select(*own).mapInArrow(label, kinds)


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose language the model rejects; trained on ``docs``' own ``lang``.

    Columns come back as they were, whatever their names. Without any labelled row there is no model, and all rows stay.
    """
    model = fit(docs, F.lit(True), **options)
    if not model.languages:
        return docs
    names = tuple(free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_kept"))
    return identify(docs, model, names).where(F.col(names[2])).select(*docs.columns)
