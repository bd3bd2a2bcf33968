"""Benchmark decontamination by templates.

Method. Texts become templates: numbers, units after numbers and names are replaced by typed placeholders,
all other words are lower-cased. Windows of ``window`` template tokens of the benchmark items and of the
documents are joined by their hashes, so a question with other numbers and names still meets its item. For
each document and item the matching windows are laid on diagonals (place in the document less place in the
item). The item is found if windows near one diagonal cover at least ``coverage`` of its tokens and their
slots are consistent: each name or unit of the item stands for one of the document's, and the other way
round, for at least ``agreement`` of them. Numbers may differ freely.

A name is a capitalised word inside a sentence. The first word of a sentence may be one too, so every text
has two templates, with such words as words and as names; each meets its like. Words run together as one
name are one placeholder and stand for the last of them. A window needs ``literal`` words that are no placeholder. Items of fewer tokens
than a window are one window of their own length, and such lengths are looked for as well. Items of fewer than
``least`` template tokens, and those whose windows with enough words cover less than ``coverage`` of them in either
template, are also looked for word by word: their whole sequence of words, without placeholders, is one window.
Characters of scripts that do not space their words are tokens each.

Before they are joined, the documents' windows pass a bitmap of fixed size (``1 << BITMAP_BITS``) of the
items' window hashes; that is all that is broadcast by design, whatever the size of the benchmark. The join
itself is left to Spark, which broadcasts the items' windows only if they are small.

Equal texts are one from their windows on, so that copies are not judged each.

Edge cases. Null and empty texts and items match nothing; items of fewer than ``shortest`` words and numbers
take no part. Documents with equal texts have equal results; a null ``doc_id`` is judged like
any other. A null ``item_id`` takes no part; items with the same number are matched each by its own text.
Repeated rows are judged each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import gathered, small_batches, stash
from .textscan import IS_SPACE, LOWER, mix, powers, row_chunks, shingle_hashes, span_hashes, texts_of

BITMAP_BITS = 24

# Words for numbers, and units, in the languages of the test tables.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil"
).split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons "
    "second seconds s minute minutes min hour hours h day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh meter meters metre metres kilometer kilometers "
    "sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre prozent gramm "
    "secondes heure heures jour jours semaine semaines mois an ans année années pourcent mètre mètres "
    "segundos minutos hora horas día días semana semanas mes meses año años metro metros"
).split()

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True

NUMBER, UNIT, NAME = 1, 2, 3
EXACT = 2  # the variant after the two templates
_PLACEHOLDER = mix(np.arange(101, 105, dtype=np.uint64))


def _words(terms: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(terms).encode(), dtype=np.uint8)
    edges = np.concatenate([[-1], np.flatnonzero(IS_SPACE[data]), [len(data)]])
    return np.sort(span_hashes(data, edges[:-1] + 1, edges[1:]))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def lowered(data: np.ndarray) -> np.ndarray:
    out = LOWER[data]
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 32
    return out


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and bytes of the characters of Thai, Lao, Tibetan, Burmese, Khmer, Japanese and Chinese script."""
    lead = np.flatnonzero(data[:-2] >= 0xE0)
    a, b = data[lead], data[lead + 1]
    own = (a == 0xE0) & (b >= 0xB8) | (a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)) | (a == 0xE3) & (b >= 0x81) | (a >= 0xE4) & (a <= 0xE9) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB) | (a == 0xF0) & (b >= 0xA0)
    return lead[own], np.where(a[own] == 0xF0, 4, 3)


def _wide_marks(data: np.ndarray) -> np.ndarray:
    """The bytes of full-width punctuation, which parts words as ASCII punctuation does."""
    lead = np.flatnonzero((data[:-2] == 0xE3) | (data[:-2] == 0xEF))
    a, b, c = data[lead], data[lead + 1], data[lead + 2]
    mark = (a == 0xE3) & (b == 0x80) & (c != 0x85) & (c != 0x87) | (a == 0xEF) & ((b == 0xBC) & ((c <= 0x8F) | (c >= 0x9A) & (c <= 0xA0) | (c >= 0xBB)) | (b == 0xBD) & ((c == 0x80) | (c >= 0x9B) & (c <= 0xA5)))
    return (lead[mark][:, None] + np.arange(3)).ravel()


class Templates:
    """Templates, and words as they are, of runs of rows of a text column."""

    def __init__(self) -> None:
        self.numbers, self.units = _words(NUMBER_WORDS), _words(UNITS)

    def of(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
        """The first row, and for both variants and the words: values, slot values (0 for words), rows' offsets."""
        raw, at, _ = texts_of(column)
        for i, j in row_chunks(at):
            data, rows = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            starts, ends = self._spans(data, rows)
            first = np.searchsorted(starts, rows)
            hashes = span_hashes(lowered(data), starts, ends)
            n = len(starts)
            head = np.zeros(n + 1, dtype=bool)
            head[first] = True
            head = head[:n]
            number = (_DIGIT[data[starts]] if n else np.zeros(0, bool)) | _among(hashes, self.numbers)
            before = np.concatenate([[False], number[:-1]]) & ~head if n else number
            unit = _among(hashes, self.units) & before & ~number
            stops = np.concatenate([[0], np.cumsum(_STOP[data])])
            opening = head | (stops[starts] > stops[np.concatenate([[0], ends[:-1]])]) if n else head
            second = data[np.minimum(starts + 1, len(data) - 1)] if n else data
            capital = (_UPPER[data[starts]] | ((data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))) & (ends - starts > 1) & ~number & ~unit
            yield i, [self._variant(hashes, number, unit, capital & ~opening, head, first), self._variant(hashes, number, unit, capital, head, first), (hashes, np.zeros(n, np.uint64), first)]

    @staticmethod
    def _spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        solid = _WORD[data]
        if len(data) > 2:
            inner = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
            solid[inner[_DIGIT[data[inner - 1]] & _DIGIT[data[inner + 1]]]] = True
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[rows] = edge[0] = edge[-1] = True
        lead, size = _characters(data)
        edge[lead] = edge[lead + size] = True
        solid[_wide_marks(data)] = False
        prev = np.concatenate([[False], solid[:-1]])
        after = np.concatenate([solid[1:], [False]])
        return np.flatnonzero(solid & (~prev | edge[:-1])), np.flatnonzero(solid & (~after | edge[1:])) + 1

    @staticmethod
    def _variant(hashes: np.ndarray, number: np.ndarray, unit: np.ndarray, name: np.ndarray, head: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = number * NUMBER + unit * UNIT + name * NAME
        if not len(kind):
            return hashes, hashes, first
        more = name & np.concatenate([[False], name[:-1]]) & ~head
        keep = np.flatnonzero(~more)
        value = np.where(kind > 0, _PLACEHOLDER[kind], hashes)[keep]
        slot = mix(hashes[np.concatenate([keep[1:], [len(kind)]]) - 1])
        slot = np.where(kind[keep] > 0, slot >> np.uint64(2) << np.uint64(2) | kind[keep].astype(np.uint64), np.uint64(0))
        return value, slot, np.searchsorted(keep, first)


def _windows(value: np.ndarray, slot: np.ndarray, at: np.ndarray, size: int, literal: int, variant: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of ``size`` tokens that lie in one row: hash, first token and row."""
    if len(value) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.concatenate([[0], np.cumsum(slot == 0)])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero((row[: len(value) - size + 1] == row[size - 1 :]) & (words[size:] - words[:-size] >= min(literal, size)))
    return mix(shingle_hashes(value, size)[start] + np.uint64(variant + 1)), start, row[start]


def _sequences(words: np.ndarray, at: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, of all runs of so many words that lie in one row: hash and row, once for each row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    power = powers(len(words) + 1)
    back = np.full(len(power), pow(int(power[1]), -1, 1 << 64), dtype=np.uint64) if len(words) else power
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])
    for size in sizes:
        if size <= len(words):
            start = np.flatnonzero(row[: len(words) - size + 1] == row[size - 1 :])
            hashes = mix(mix((sums[size:] - sums[:-size])[start] * back[start]) + np.uint64(size * 4 + EXACT + 1))
            yield hashes, row[start]


def item_windows(items: DataFrame, window: int, literal: int, least: int, coverage: float, shortest: int) -> DataFrame:
    """``(hash, item, item_id, variant, size, tokens, place, item_slots)`` of ``items(item_id, text)``; ``item`` tells equal numbers apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for b in batches:
            rows = []
            for i, variants in templates.of(b.column(1)):
                words, _, ends = variants[EXACT]
                for r in range(len(ends) - 1):
                    ids = (b.column(0)[i + r].as_py(), b.column(2)[i + r].as_py())
                    reached = []
                    for v, (value, slot, at) in enumerate(variants[:EXACT]):
                        n = int(at[r + 1] - at[r])
                        size = min(window, n)
                        own = slice(at[r], at[r + 1])
                        hashes, start, _ = _windows(value[own], slot[own], np.array([0, n]), size, literal, v) if n >= least else (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)
                        rows += [(int(h), ids[1], ids[0], v, size, n, int(p), slot[own][p : p + size].view(np.int64).tolist()) for h, p in zip(hashes.view(np.int64), start, strict=True)]
                        reached.append(len(np.unique(start[:, None] + np.arange(size))) / max(n, 1))
                    n = int(ends[r + 1] - ends[r])
                    if n >= shortest and min(reached) < coverage:
                        ((hashes, _),) = _sequences(words[ends[r] : ends[r + 1]], np.array([0, n]), [n])
                        rows.append((int(hashes.view(np.int64)[0]), ids[1], ids[0], EXACT, n, n, 0, []))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["hash", "item", "item_id", "variant", "size", "tokens", "place", "item_slots"])

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("text").alias("item")).distinct()
    return rows.mapInArrow(scan, "hash long, item long, item_id long, variant int, size int, tokens int, place int, item_slots array<long>")


def document_windows(docs: DataFrame, shared, sizes: list[int], lengths: list[int], literal: int) -> DataFrame:
    """``(hash, form, at, doc_slots)``: the windows of ``docs(form, text)`` that pass the bitmap ``shared``.

    Templates have windows of ``sizes``; runs of words of ``lengths`` come once for each text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, bitmap = Templates(), shared.value

        def known(hashes: np.ndarray) -> np.ndarray:
            bit = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)

        for b in batches:
            for i, variants in templates.of(b.column(1)):
                for hashes, row in _sequences(variants[EXACT][0], variants[EXACT][2], lengths) if lengths else ():
                    hit = known(hashes)
                    if hit.any():
                        row, hashes = np.unique(np.stack([row[hit].astype(np.uint64), hashes[hit]]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), b.column(0).take(pa.array(row.astype(np.int64) + i)), pa.array(np.zeros(len(row), np.int32)), pa.array([[]] * len(row), pa.list_(pa.int64()))], names=["hash", "form", "at", "doc_slots"])
                for v, (value, slot, at) in enumerate(variants[:EXACT]):
                    for size in sizes:
                        hashes, start, row = _windows(value, slot, at, size, literal, v)
                        hit = known(hashes)
                        hashes, start, row = hashes[hit], start[hit], row[hit]
                        if len(hashes):
                            slots = np.lib.stride_tricks.sliding_window_view(slot, size)[start].view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), b.column(0).take(pa.array(row + i)), pa.array((start - at[row]).astype(np.int32)), pa.array(list(slots), pa.list_(pa.int64()))], names=["hash", "form", "at", "doc_slots"])

    return docs.mapInArrow(scan, "hash long, form long, at int, doc_slots array<long>")


def _runs(rows: list[dict], drift: int) -> Iterator[list[dict]]:
    """Windows of one variant whose diagonals are at most ``drift`` apart, then those of each diagonal alone."""
    own = sorted(rows, key=lambda r: r["at"] - r["place"])
    diagonals = [r["at"] - r["place"] for r in own]
    low = 0
    for high in range(len(own)):
        while diagonals[high] - diagonals[low] > drift:
            low += 1
        if high + 1 == len(own) or diagonals[high + 1] - diagonals[low] > drift:
            yield own[low : high + 1]
    if own and diagonals[0] != diagonals[-1]:
        edges = [0, *(k for k in range(1, len(own)) if diagonals[k] != diagonals[k - 1]), len(own)]
        yield from (own[i:j] for i, j in zip(edges, edges[1:]))


def _consistency(near: list[dict]) -> tuple[float, int]:
    """Slot consistency and changed slots of a run of windows."""
    there: dict[int, set[int]] = {}
    back: dict[int, set[int]] = {}
    changed = set()
    for r in near:
        for k, (a, b) in enumerate(zip(r["item_slots"], r["doc_slots"], strict=True)):
            if a and a != b:
                changed.add(r["place"] + k)
            if a & 3 in (UNIT, NAME):
                there.setdefault(a, set()).add(b)
                back.setdefault(b, set()).add(a)
    return min((sum(len(m) == 1 for m in side.values()) / len(side) for side in (there, back) if side), default=1.0), len(changed)


def judge(rows: list[dict], tokens: dict[int, int], drift: int, coverage: float, agreement: float) -> tuple[float, float, int] | None:
    """Coverage, slot consistency and changed slots of the run that covers an item best of those that pass both limits."""
    if any(r["variant"] == EXACT for r in rows):
        return 1.0, 1.0, 0
    best = None
    for variant in sorted({r["variant"] for r in rows}):
        for near in _runs([r for r in rows if r["variant"] == variant], drift):
            covered = len({p for r in near for p in range(r["place"], r["place"] + r["size"])}) / tokens[variant]
            if covered >= coverage and (best is None or covered >= best[0]):
                agreed, changed = _consistency(near)
                if agreed >= agreement and (best is None or (covered, -changed) > (best[0], -best[2])):
                    best = (covered, agreed, changed)
    return best


def leaks(docs: DataFrame, items: DataFrame, window: int = 6, literal: int = 3, least: int = 5, coverage: float = 0.5, agreement: float = 0.8, drift: int = 4, shortest: int = 3) -> DataFrame:
    """``(form, item_id, coverage, consistency, changed)`` for each item found in the texts ``docs(form, text)``.

    ``form`` is a key of the text; ``changed`` counts the slots that hold another value than the item's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known, _ = stash(gathered(item_windows(items, window, literal, least, coverage, shortest)), "item-windows")
    found_sizes = known.select(F.col("variant") == EXACT, "size").distinct().collect()  # at most ``window`` numbers, and lengths of items
    sizes, lengths = (sorted(size for exact, size in found_sizes if exact == kind) for kind in (False, True))
    bitmap = np.zeros(1 << BITMAP_BITS >> 3, dtype=np.uint8)
    bits = known.select(F.shiftrightunsigned("hash", 64 - BITMAP_BITS).alias("b")).distinct().toArrow()["b"].to_numpy()  # at most 1 << BITMAP_BITS
    np.bitwise_or.at(bitmap, bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8))
    shared = spark.sparkContext.broadcast(bitmap)
    # A text's windows come once for each of its copies; they are one row each before they meet the items.
    found = document_windows(docs.select("form", "text"), shared, sizes, lengths, literal).dropDuplicates(["form", "at", "hash"])
    met = found.join(known, "hash").groupBy("form", "item", "item_id").agg(
        F.collect_list(F.struct("variant", "size", "tokens", "place", "item_slots", "at", "doc_slots")).alias("rows"), F.countDistinct("place").alias("places"), F.max("size").alias("size"), F.min("tokens").alias("tokens")
    )
    met = met.where(F.col("places") * F.col("size") >= coverage * F.col("tokens")).select("form", "item_id", "rows")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                got = judge(row["rows"], {r["variant"]: r["tokens"] for r in row["rows"]}, drift, coverage, agreement)
                if got:
                    out.append((row["form"], row["item_id"], *got))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["form", "item_id", "coverage", "consistency", "changed"])

    hits = met.mapInArrow(check, "form long, item_id long, coverage double, consistency double, changed long")
    return hits.groupBy("form", "item_id").agg(F.max("coverage").alias("coverage"), F.max_by("consistency", "coverage").alias("consistency"), F.min_by("changed", F.struct(-F.col("coverage"), "changed")).alias("changed"))


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id, coverage, consistency, changed)``: which rows of ``docs(doc_id, text)`` hold which items."""
    formed = docs.select("doc_id", F.xxhash64("text").alias("form"), "text")
    hits, _ = stash(gathered(leaks(formed, items, **options)), "leaks")
    return formed.select("doc_id", "form").join(hits, "form").drop("form")


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    hits, _ = stash(gathered(leaks(docs.select(F.xxhash64("text").alias("form"), "text"), items, **options).select(F.col("form").alias("_form")).distinct()), "leaks")
    return docs.join(hits, F.xxhash64(docs["text"]) == hits["_form"], "left_anti")
