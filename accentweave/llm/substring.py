"""Substring dedup with suffix automata.

Method. A window is ``window`` consecutive words. The words of a document that are covered by a window
which also starts in a document with a smaller number are removed; only the input is judged. Repeated text
is found by suffix automata of reference shards, against which the other texts of the shard are streamed:
their matching statistics say where a match of at least a window's length ends.

Sending every document past every shard would cost the square of the corpus, so shards are not broadcast
but keyed. Each window has an anchor, its leftmost smallest ``gram``-word hash, and equal windows have equal
anchors; windows in a row with one anchor form a run, about one for every twenty words. The runs of an
anchor are one shard: only there can its windows match. Runs that are equal word for word are one text of
the shard, owned by the smallest document that has it; all other documents that have it lose it whole. A
shard's texts go through one automaton in the order of their owners: each is first streamed, which finds
what smaller documents hold, then added. An anchor with more than ``fan`` different texts is too much for one
automaton; its windows are spread by hashes instead, which finds the same: as blocks of ``BLOCK`` windows, and on their
own only where different blocks can hold equal ones.

Edge cases. Null, empty and short texts have no window and lose nothing; a null ``doc_id`` neither loses
words nor takes any. Rows with the same ``doc_id`` do not take words from each other. Repeats within one
document stay, unless a smaller document has them too. Words are compared by 64-bit hashes, ``window`` of
them in a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, stash
from .textscan import mix, shingle_hashes, texts_of, word_hashes, word_spans

WINDOW = 50
GRAM = 8
BLOCK = 8

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


class SuffixAutomaton:
    """All factors of the texts added so far; each state knows its longest factor's length."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, text: list) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in text:
            here = nexts[last].get(c)
            if here is not None and length[here] == length[last] + 1:
                last = here
                continue
            if here is None:
                fresh = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in nexts[p]:
                    nexts[p][c] = fresh
                    p = link[p]
                if p < 0:
                    last = fresh
                    continue
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[fresh] = q
                    last = fresh
                    continue
            else:
                fresh, p, q = -1, last, here
            copy = len(nexts)
            nexts.append(dict(nexts[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            while p >= 0 and nexts[p].get(c) == q:
                nexts[p][c] = copy
                p = link[p]
            if fresh >= 0:
                link[fresh] = copy
                last = fresh
            else:
                last = copy

    def matching_statistics(self, text: list) -> list[int]:
        """For each place the length of the longest factor that ends there and is in the automaton."""
        nexts, link, length = self.next, self.link, self.length
        state = got = 0
        out = []
        for c in text:
            while state and c not in nexts[state]:
                state = link[state]
                got = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                got += 1
            out.append(got)
        return out


def range_sums(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for each ``words[first:stop]``; equal words have equal numbers."""
    base = np.full(len(words), _STEP, dtype=np.uint64)
    base[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(base, dtype=np.uint64), dtype=np.uint64)])
    back = np.full(len(words), _BACK, dtype=np.uint64)
    back[0] = 1
    return (sums[stop] - sums[first]) * np.cumprod(back, dtype=np.uint64)[first]


def runs_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: the anchor's hash, the hash of its words, its first window and how many it has."""
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 4
    grams = shingle_hashes(words, gram)
    at = np.arange(len(words) - window + 1)
    anchor = at + np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    content = range_sums(words, first, first + count - 1 + window)
    return grams[anchor[first]].view(np.int64), mix(content + count.astype(np.uint64)).view(np.int64), first, count


def run_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``(doc_id, form, anchor, content, start, n)`` of ``docs(doc_id, text, form)``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for _, words, at in word_hashes(b.column(1), lower=False):
                got += [runs_of(words[at[r] : at[r + 1]], window, gram) for r in range(len(at) - 1)]
            times = np.array([len(g[0]) for g in got], dtype=np.int64)
            row = pa.array(np.repeat(np.arange(len(got)), times))
            parts = [np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()).take(row), b.column(2).take(row), pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))],
                names=["doc_id", "form", "anchor", "content", "start", "n"],
            )

    return docs.where("doc_id is not null").select("doc_id", "text", "form").mapInArrow(scan, "doc_id long, form long, anchor long, content long, start int, n int")


def _texts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(anchor, content, texts, owner, words)`` of ``wanted(anchor, content, texts, owner, form, start, n)``, read from the owners."""
    lists = wanted.groupBy("owner", "form").agg(F.collect_list(F.struct("anchor", "content", "texts", "start", "n")).alias("runs"))
    joined = docs.join(lists, (docs["doc_id"] == lists["owner"]) & (docs["form"] == lists["form"])).select("owner", "text", "runs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, lists = b.column(0).to_pylist(), b.column(2)
            for i, words, at in word_hashes(b.column(1), lower=False):
                out = []
                for r in range(len(at) - 1):
                    own = words[at[r] : at[r + 1]]
                    out += [(x["anchor"], x["content"], x["texts"], owners[i + r], own[x["start"] : x["start"] + x["n"] + window - 1].tobytes()) for x in lists[i + r].as_py()]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["anchor", "content", "texts", "owner", "words"])

    # Dealt by content as well as anchor, so that a crowded anchor's texts are many tasks' work.
    return joined.mapInArrow(read, "anchor long, content long, texts long, owner long, words binary").dropDuplicates(["anchor", "content"])


def _held_by_smaller(texts: DataFrame, window: int) -> DataFrame:
    """``(anchor, content, gone)``: which windows of each text a text of a smaller owner has; one automaton per anchor."""

    def shard(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["owner"].to_pylist(), table["anchor"].to_pylist(), table["content"].to_pylist(), table["words"].to_pylist(), strict=True))
        automaton, out, waiting = SuffixAutomaton(), [], []
        for k, (owner, anchor, content, raw) in enumerate(rows):
            if k and owner != rows[k - 1][0]:
                for text in waiting:
                    automaton.add(text)
                waiting = []
            text = np.frombuffer(raw, dtype=np.uint64).tolist()
            if len(automaton.next) > 1:
                found = [j - window + 1 for j, length in enumerate(automaton.matching_statistics(text)) if length >= window]
                if found:
                    out.append((anchor, content, found))
            waiting.append(text)
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"anchor": pa.array(columns[0], pa.int64()), "content": pa.array(columns[1], pa.int64()), "gone": pa.array(columns[2], pa.list_(pa.int32()))})

    return texts.groupBy("anchor").applyInArrow(shard, "anchor long, content long, gone array<int>")


def blocks_of(words: np.ndarray, anchor: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each block of a run's text: its first window, how many it has, the hash of its core and that of its words.

    Windows are told by how far into them the anchor is; those of ``BLOCK`` such places, as far as the run has them, are
    a block. Its core is what all windows of these places have in common, also those that the run does not have.
    """
    n = len(words) - window + 1
    at = int(np.flatnonzero(shingle_hashes(words, gram).view(np.int64) == anchor)[0])
    width = min(BLOCK, window)
    block = (at - np.arange(n)) // width
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    low = at - block[first] * width
    core = mix(range_sums(words, low, low - width + 1 + window) + mix(block[first].astype(np.uint64)))
    place = ((at - first) * window + count).astype(np.uint64)
    return first, count, core, mix(range_sums(words, first, first + count - 1 + window) ^ mix(place) ^ core)


def _held_by_hash(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The same for anchors with very many texts, by blocks of windows.

    Blocks that are equal word for word are one, and lost whole by all but the smallest owner. Windows can only be
    equal in blocks of one core, so only where different blocks share a core do their windows meet by their own hashes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, spans = [], [], []
            for r, (anchor, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                words = np.frombuffer(raw, dtype=np.uint64)
                parts.append(blocks_of(words, anchor, window, gram))
                rows += [r] * len(parts[-1][0])
                spans += [raw[8 * f : 8 * (f + c - 1 + window)] for f, c in zip(parts[-1][0].tolist(), parts[-1][1].tolist(), strict=True)]
            first, count, core, body = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64),) * 4
            row = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(row) for k in range(3)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(body.view(np.int64)), pa.array(spans, pa.binary())],
                names=["anchor", "content", "owner", "start", "n", "core", "body", "words"],
            )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [np.zeros(0, np.uint64)]
            for raw in b.column(2).to_pylist():
                words = np.frombuffer(raw, dtype=np.uint64)
                first = np.arange(len(words) - window + 1)
                hashes.append(mix(range_sums(words, first, first + window)))
            n = [len(h) for h in hashes[1:]]
            row = pa.array(np.repeat(np.arange(len(n)), n))
            places = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in n)])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(2)), pa.array(places), pa.array(np.concatenate(hashes).view(np.int64))], names=["body", "least", "at", "hash"])

    # What is joined is written before, so that rows of a large group can be split where they are joined.
    blocks, _ = stash(texts.mapInArrow(cut, "anchor long, content long, owner long, start int, n int, core long, body long, words binary"), "crowded-blocks")
    bodies, _ = stash(blocks.groupBy("core", "body").agg(F.min("owner").alias("least"), F.min_by("words", "owner").alias("words")), "crowded-bodies")
    cores, _ = stash(bodies.groupBy("core").agg(F.count("*").alias("bodies")).where("bodies > 1").select("core"), "crowded-cores", narrow=True)
    open_ones = bodies.join(cores, "core", "left_semi").select("body", "least", "words")
    rows, _ = stash(open_ones.mapInArrow(spread, "body long, least long, at int, hash long"), "crowded-windows")
    lowest, _ = stash(rows.groupBy("hash").agg(F.min("least").alias("low")), "crowded-owners", narrow=True)
    parts = rows.join(lowest, "hash").where("low < least").groupBy("body").agg(F.collect_list("at").alias("gone"))
    known, _ = stash(bodies.select("body", "least").join(parts, "body", "left"), "crowded-known", narrow=True)
    all_of, some = F.sequence("start", F.col("start") + F.col("n") - 1), F.transform("gone", lambda g: (g + F.col("start")).cast("int"))
    lost = blocks.drop("core", "words").join(known, "body").select("anchor", "content", F.when(F.col("least") < F.col("owner"), all_of).otherwise(some).alias("gone"))
    return lost.where("gone is not null").groupBy("anchor", "content").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, fan: int = 512) -> DataFrame:
    """``(doc_id, form, spans)``: windows to remove, as ``(first window, number of windows)``, of ``docs(doc_id, text, form)``."""
    runs, _ = stash(run_table(docs, window, gram), "runs")
    contents = runs.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "form", "start", "n")).alias("own"), F.max("doc_id").alias("last"))
    contents, _ = stash(contents, "run-contents")
    anchors = contents.groupBy("anchor").agg(F.min("own.doc_id").alias("low"), F.max("last").alias("high"), F.count("*").alias("texts")).where("low < high").select("anchor", "texts")
    shared, _ = stash(contents.join(anchors, "anchor").select("anchor", "content", "texts", "last", F.col("own.doc_id").alias("owner"), F.col("own.form").alias("form"), F.col("own.start").alias("start"), F.col("own.n").alias("n")), "shared-contents")
    wanted = shared.where("texts > 1")
    texts, _ = stash(_texts(docs, wanted, window), "run-texts")
    columns = ["anchor", "content", "owner", "words"]
    held = _held_by_smaller(texts.where(F.col("texts") <= fan).select(*columns), window).unionByName(_held_by_hash(texts.where(F.col("texts") > fan).select(*columns), window, gram))
    held, _ = stash(held, "held")
    copies = shared.where("last > owner").select("anchor", "content", "owner")
    lost = runs.join(copies, ["anchor", "content"]).where("doc_id > owner").select("doc_id", "form", F.array(F.struct("start", "n")).alias("spans"))
    own = shared.join(held, ["anchor", "content"]).select(F.col("owner").alias("doc_id"), "anchor", "content", "gone")
    own = runs.join(own, ["doc_id", "anchor", "content"]).select("doc_id", "form", F.transform("gone", lambda g: F.struct((F.col("start") + g).cast("int").alias("start"), F.lit(1).alias("n"))).alias("spans"))
    return lost.unionByName(own).groupBy("doc_id", "form").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, fan: int = 512) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, a row for each row of ``docs(doc_id, text)``; ``kept`` is joined by spaces."""
    spark = docs.sparkSession
    small_batches(spark)
    formed = docs.select("doc_id", "text", F.xxhash64("text").alias("form"))
    spans, _ = stash(repeated_spans(formed, window, gram, fan), "spans")
    joined = formed.alias("d").join(spans.alias("s"), (F.col("d.doc_id") == F.col("s.doc_id")) & (F.col("d.form") == F.col("s.form")), "left").select("d.doc_id", "d.text", "s.spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at, _ = texts_of(b.column(1))
            total, gone, kept = [], [], []
            for r in range(b.num_rows):
                data = raw[at[r] : at[r + 1]]
                starts, ends = word_spans(data, np.array([0, len(data)]))
                keep = np.ones(len(starts), dtype=bool)
                if b.column(2)[r].is_valid:
                    mark = np.zeros(len(starts) + 1, dtype=np.int64)
                    spans = b.column(2)[r].values
                    first, n = spans.field("start").to_numpy(), spans.field("n").to_numpy()
                    np.add.at(mark, first, 1)
                    np.add.at(mark, first + n + window - 1, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                whole = data.tobytes()
                kept.append(b" ".join(whole[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)))
                total.append(len(starts))
                gone.append(int(len(starts) - keep.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
