"""Toxicity scores from a convolutional text classifier in numpy.

Method. A word is the sum of hashed embeddings: of the word and of its first 4, 5 and 6 bytes. Filters of
several widths run over the words of the whole text; each filter's largest response goes into a logistic
layer. Embeddings, filters and layer start at random and are trained together by gradient descent on about
``per_label`` texts and at most ``max_bytes`` bytes of each label, whole texts of at most a 64th of that. While it
trains, the largest response is at first a soft one, in which all words of a text have a share by their responses, and
hardens from epoch to epoch; scores use the hard one. Every fifth of the texts is left out. On these and all other
trainable texts with a label, in the shares of labels that they have,
it is calibrated: for each language a threshold with the best F1, in the middle of the gap it leaves, and one slope.
Only counts of logits, in steps of 1/256, come back for that. The score is scaled so that it reaches 0.7 at its language's threshold.
The language is itself read off the text's words, by hashed word frequencies learnt from the same rows.

Scoring runs the filters once per distinct word of a chunk of text; the places of a long text are gone through in
pieces, so its memory is that of the text's word numbers and the chunk.

Edge cases. A null, empty or letterless text has no words and gets the score of an empty text. Null
labels, and those that are no number, are not learnt; a label is toxic if it is above 0, or true, and of several labels of
a document the largest counts. With labels of fewer than two
kinds every score is 0. Repeated rows are scored each; a null ``doc_id`` is scored and counts as not
held out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import bounded, fold, sample
from .storage import small_batches
from .textscan import BYTE_VALUE, mix, powers, row_chunks, span_hashes, texts_of, word_spans

WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
CUT = 0.7
# Logits are counted in so many steps a unit, up to so many units on both sides of 0.
STEPS, SPAN = 256, 64


@dataclass(frozen=True)
class Model:
    bits: int
    emb: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str]
    word_logs: np.ndarray
    thresholds: np.ndarray
    slope: float


def word_ids(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the distinct words' buckets, each word's number, and the rows' offsets."""
    raw, at, _ = texts_of(column)
    power = powers(max(PREFIXES))
    for i, j in row_chunks(at):
        data, rows = fold(raw[at[i] : at[j]]), at[i : j + 1] - at[i]
        starts, ends = word_spans(data, rows)
        words, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        padded = np.concatenate([data, np.full(max(PREFIXES), 0x20, np.uint8)])
        begin, length = starts[first], (ends - starts)[first]
        buckets, sums = [words], np.zeros(len(words), np.uint64)
        for k in range(max(PREFIXES)):
            sums = sums + np.where(k < length, BYTE_VALUE[padded[begin + k]] * power[k], np.uint64(0))
            if k + 1 in PREFIXES:
                buckets.append(mix(sums + np.uint64(k + 1)))
        yield i, (np.stack(buckets, axis=1) >> np.uint64(64 - bits)).astype(np.int64) if len(words) else np.zeros((0, len(PREFIXES) + 1), np.int64), number, np.searchsorted(starts, rows)


PIECE = 1 << 16  # words


def _responses(word_parts: list[np.ndarray], number: np.ndarray, rows: np.ndarray, bias: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All filters' responses at each padded word, and where rows begin and how long they are.

    ``word_parts[o]`` of a width are the filters' responses to a word at offset o; rows are padded by
    empty words, so that each has a window of every width. Windows that begin in the last ``skip`` words do not count.
    """
    pad, n = max(WIDTHS), len(rows) - 1
    lens = np.diff(rows) + pad
    begin = np.cumsum(lens) - lens
    place = np.arange(len(number)) + np.repeat(np.arange(n) * pad, np.diff(rows))
    total, at = int(lens.sum()), 0
    out = np.zeros((total + pad, len(bias)), dtype=np.float32)
    for width, parts in zip(WIDTHS, word_parts, strict=True):
        cols = slice(at, at + parts[0].shape[1])
        for o in range(width):
            out[pad - o + place, cols] += parts[o][number]
        for k in range(width - 1):
            out[pad + begin + lens - 1 - k, cols] = -np.inf
        at = cols.stop
    out = out[pad:] + bias
    if skip:
        out[len(number) - skip : len(number)] = -np.inf
    return out, begin, lens


def _tops(word_parts: list[np.ndarray], number: np.ndarray, rows: np.ndarray, bias: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Largest responses of each row's filters; a row of more than ``piece`` words is alone and gone through in pieces."""
    over = max(WIDTHS) - 1
    best = []
    for i in range(0, max(1, len(number)), piece) if len(rows) == 2 else [0]:
        own = number[i : i + piece + over] if len(rows) == 2 else number
        skip = over if i + piece + over < len(number) and len(rows) == 2 else 0
        out, begin, _ = _responses(word_parts, own, np.array([0, len(own)]) if len(rows) == 2 else rows, bias, skip)
        best.append(np.maximum.reduceat(out, begin, axis=0))
    return np.maximum.reduce(best)


def _logits(model: Model, buckets: np.ndarray, number: np.ndarray, rows: np.ndarray, piece: int = PIECE) -> np.ndarray:
    x = model.emb[buckets].sum(axis=1)
    parts = [[x @ f[o] for o in range(len(f))] for f in model.filters]
    return np.maximum(_tops(parts, number, rows, model.bias, piece), 0) @ model.out + model.out_bias


def _language(model: Model, buckets: np.ndarray, number: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(rows) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(rows) > 0)
    if len(full) == 1:
        sums[full[0]] = np.bincount(number, minlength=len(buckets)) @ model.word_logs[buckets[:, 0]]
    elif len(full):
        sums[full] = np.add.reduceat(model.word_logs[buckets[:, 0]][number].astype(np.float64), rows[full], axis=0)
    return sums.argmax(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Adam's running moments of some arrays, which it changes in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.mean, self.square = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def update(self, grads: list) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for array, mean, square, grad in zip(self.arrays, self.mean, self.square, grads, strict=True):
            mean[:] = 0.9 * mean + 0.1 * grad
            square[:] = 0.999 * square + 0.001 * grad * grad
            array -= rate * mean / (np.sqrt(square) + 1e-8)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str | None], bits: int, dim: int = 12, filters: int = 8, epochs: int = 5, least_steps: int = 60, spread: float = 0.005, rate: float = 0.02, pace: float = 30.0, batch: int = 32, seed: int = 11) -> tuple[Model, np.ndarray]:
    """A model that is not calibrated, and which texts it is fitted on: all but every fifth.

    ``texts``: each text's distinct words' buckets and its words' numbers among them. A small sample is gone
    through more than ``epochs`` times, for ``least_steps`` batches.
    Filters and layer go by Adam at ``rate``, embeddings by plain steps at ``pace``, so that words move by how often they
    matter. With no ``epochs`` the model is as random as it starts.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    fit = np.array([k for i, k in enumerate(order) if i % 5])
    emb = rng.normal(0, spread, (1 << bits, dim)).astype(np.float32)
    banks = [rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
    n = filters * len(WIDTHS)
    bias, out = np.zeros(n, np.float32), rng.normal(0, n**-0.5, n).astype(np.float32)
    base = np.array([np.log(labels[fit].mean() / (1 - labels[fit].mean()))], np.float32)
    adam = Adam([*banks, bias, out, base], rate)

    def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.cumsum([0, *[len(texts[k][0]) for k in rows]])
        number = np.concatenate([texts[k][1] + sizes[i] for i, k in enumerate(rows)])
        return np.concatenate([texts[k][0] for k in rows]), number, np.cumsum([0, *[len(texts[k][1]) for k in rows]])

    def batches() -> Iterator[np.ndarray]:
        """Up to ``batch`` texts, and only one if it has more than ``PIECE`` words."""
        rng.shuffle(fit)
        rows, words = [], 0
        for k in fit:
            if rows and (len(rows) == batch or words + len(texts[k][1]) > PIECE):
                yield np.array(rows)
                rows, words = [], 0
            rows.append(k)
            words += len(texts[k][1])
        yield np.array(rows)

    passes = max(epochs, -(-least_steps * batch // len(fit))) if epochs else 0
    for turn in range(passes):
        hard, adam.rate = np.float32(2.0 * 32.0 ** (turn / passes)), rate * (1 - 0.9 * turn / passes)
        for rows in batches():
            buckets, number, at = gathered(rows)
            x = emb[buckets].sum(axis=1)
            value, begin, lens = _responses([[x @ f[o] for o in range(len(f))] for f in banks], number, at, bias)
            top = np.maximum.reduceat(value, begin, axis=0)
            share = np.exp(hard * (value - np.repeat(top, lens, axis=0)))
            share /= np.repeat(np.add.reduceat(share, begin, axis=0), lens, axis=0)
            soft = np.add.reduceat(share * np.where(share > 0, value, 0), begin, axis=0)
            deep = np.maximum(soft, 0)
            wrong = ((_sigmoid(deep @ out + base) - labels[rows]) / len(rows)).astype(np.float32)
            back = wrong[:, None] * out * (soft > 0)
            # What each place's responses get of the gradient, and from there each distinct word.
            each = share * np.repeat(back, lens, axis=0)
            place = np.arange(len(number)) + np.repeat(np.arange(len(rows)) * max(WIDTHS), np.diff(at))
            into, grads = np.zeros((len(buckets), dim), dtype=np.float32), []
            sorted_by = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.diff(number[sorted_by], prepend=-1))
            for b, bank in enumerate(banks):
                grad = np.zeros_like(bank)
                own = each[:, b * filters : (b + 1) * filters]
                for o in range(len(bank)):
                    start = place - o
                    felt = np.where(((place - np.repeat(begin, np.diff(at))) >= o)[:, None], own[start], 0)
                    word = np.add.reduceat(felt[sorted_by], first, axis=0)  # every distinct word has a place
                    grad[o] = x.T @ word
                    into += word @ bank[o].T
                grads.append(grad)
            ids, which = np.unique(buckets, return_inverse=True)
            rows_grad = np.zeros((len(ids), dim), np.float32)
            np.add.at(rows_grad, which.ravel(), np.repeat(into, buckets.shape[1], axis=0))
            emb[ids] -= pace * (1 - 0.9 * turn / passes) * rows_grad
            adam.update([*grads, back.sum(axis=0), wrong @ deep, wrong.sum(keepdims=True)])
    names = sorted({v for v in langs if v is not None}) or ["und"]
    counts = np.full((1 << bits, len(names)), 0.1)
    for k in fit:
        if langs[k] is not None:
            np.add.at(counts[:, names.index(langs[k])], texts[k][0][texts[k][1], 0], 1)
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return Model(bits, emb, banks, bias, out, float(base[0]), names, logs, np.zeros(len(names)), 1.0), fit


def best_cut(clean: np.ndarray, toxic: np.ndarray, default: float = 0.0) -> float:
    """The logit from which on label 1 has the best F1, in the middle of the gap around it, from counts by step."""
    if not clean.sum() or not toxic.sum():
        return default
    used = np.flatnonzero(clean + toxic)[::-1]
    f1 = 2 * np.cumsum(toxic[used]) / (np.cumsum((clean + toxic)[used]) + toxic.sum())
    k = int(f1.argmax())
    low = used[k] / STEPS - SPAN
    return float(low + (used[k + 1] + 1) / STEPS - SPAN) / 2 if k + 1 < len(used) else float(low) - 1e-6


def calibrate(docs: DataFrame, marks: DataFrame, fitted: DataFrame, model: Model) -> Model:
    """Thresholds and slope from all rows of ``docs(doc_id, text)`` with ``marks(doc_id, mark)`` but those ``fitted(doc_id)``.

    Texts are scored where they are; only their logits meet the marks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        for batch in batches:
            step, lang = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for i, buckets, number, rows in word_ids(batch.column(1), raw.bits):
                own = slice(i, i + len(rows) - 1)
                step[own] = np.clip(np.floor((_logits(raw, buckets, number, rows) + SPAN) * STEPS), 0, 2 * SPAN * STEPS - 1)
                lang[own] = _language(raw, buckets, number, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang), pa.array(step)], names=["doc_id", "number", "step"])

    rows = docs.join(F.broadcast(fitted), "doc_id", "left_anti").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, number int, step int").join(marks, "doc_id")
    counts = found.groupBy("number", F.col("mark").alias("toxic"), "step").agg(F.count("*").alias("n")).toArrow()
    seen = np.zeros((len(model.languages), 2, 2 * SPAN * STEPS))
    seen[tuple(counts[c].to_numpy() for c in ("number", "toxic", "step"))] = counts["n"].to_numpy()
    shared.destroy()
    every = best_cut(*seen.sum(axis=0))
    thresholds = np.array([best_cut(*own, every) for own in seen])
    lang, toxic, step = np.nonzero(seen)
    if not len(step):
        return replace(model, thresholds=thresholds)
    weight, gap = seen[lang, toxic, step], (step + 0.5) / STEPS - SPAN - thresholds[lang]
    side = np.where(toxic == 1, gap, -gap)
    slope = min((0.05 * 1.2**k for k in range(40)), key=lambda s: -np.average(np.log(np.maximum(_sigmoid(s * side), 1e-12)), weights=weight) + 1e-3 * s)
    return replace(model, thresholds=thresholds, slope=slope)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, per_label: int = 2500, max_bytes: int = 16 << 20, bits: int = 16, seed: int = 11) -> Model | None:
    """Trains on ``docs(doc_id, text, lang)`` with ``labels(doc_id, label)``, on rows for which ``trainable`` holds.

    Weights are learnt from a sample of about ``per_label`` rows and at most ``max_bytes`` bytes of each label, thresholds
    from all other rows.
    """
    value = F.col("label").try_cast("double")
    marks = labels.where(value.isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((value > 0).cast("int")).alias("mark"))
    chosen = sample(marks.where(trainable), "mark", per_label, seed).select("doc_id", "mark")  # about twice per_label rows
    found = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = bounded(found, "mark", max_bytes, seed)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                _, buckets, number, _ = next(word_ids(batch.column(3).slice(k, 1), bits))
                found.append((buckets.ravel().astype(np.int32), number.astype(np.int32)))
            arrays = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2).cast(pa.string()), batch.column(4), *arrays], names=["doc_id", "mark", "lang", "form", "buckets", "number"])

    got = rows.select("doc_id", "mark", "lang", "text", "form").mapInArrow(bags, "doc_id long, mark int, lang string, form long, buckets array<int>, number array<int>").toArrow().sort_by([("doc_id", "ascending"), ("form", "ascending")])
    y = got["mark"].to_numpy().astype(np.float32)
    if len(y) < 10 or y.min() == y.max():
        return None
    ids, langs, parts = got["doc_id"].to_numpy(), got["lang"].to_pylist(), []
    for name in ("buckets", "number"):
        column = got[name].combine_chunks()
        got = got.drop_columns(name)
        flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        parts.append([flat[at[k] : at[k + 1]] for k in range(len(y))])
    texts = [(a.reshape(-1, len(PREFIXES) + 1), b) for a, b in zip(*parts, strict=True)]
    model, used = train(texts, y, langs, bits, seed=seed)
    fitted = docs.sparkSession.createDataFrame([(int(k),) for k in np.unique(ids[used])], "doc_id long")
    return calibrate(docs.where(trainable).select("doc_id", "text"), marks, fitted, model)


def scores(column: pa.Array, model: Model | None) -> np.ndarray:
    out = np.zeros(len(column))
    if model is None:
        return out
    for i, buckets, number, rows in word_ids(column, model.bits):
        z, lang = _logits(model, buckets, number, rows), _language(model, buckets, number, rows)
        out[i : i + len(rows) - 1] = _sigmoid(model.slope * (z - model.thresholds[lang]) + np.log(CUT / (1 - CUT)))
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``tox_score`` and ``toxic`` (1 from the language's threshold on) after its own columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("tox_score", "toxic")]
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = scores(batch.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= CUT).astype(np.int32))], names=[*batch.schema.names, "tox_score", "toxic"])

    return docs.select(*own).mapInArrow(run, docs.select(*own).schema.add("tox_score", "double").add("toxic", "integer"))
