"""Nearest neighbours by largest inner product, with a hash-prefix forest.

Method. Vectors get one more component that makes all norms equal (queries get 0 there), so that the
largest inner product is the smallest angle. Each of ``trees`` trees writes a vector as a string of 64
bits, the sides it is on of random hyperplanes; a tree is the sorted array of those strings. A query
descends each tree to the vectors with the longest common prefix and then ascends all trees together,
one bit at a time, until the prefixes hold ``share`` of all vectors (counted with repeats, at least
``least``). The vectors reached are ranked by their exact inner products in double precision.

The trees are dealt out by prefix. How many vectors each prefix holds is counted for all of them, up to
``DEPTH`` bits: a table of fixed size that tells each query at which bit to stop. Where its prefixes of that length still
hold more, it descends further, down to all 64 bits: the blocks, which sort their strings, say how many of these have
each longer prefix of the query's, and the sums over all trees say where to stop. A query's candidates in a block are one
slice of its strings. Blocks have a bounded number
of vectors and of queries; a crowded prefix becomes several blocks.

So the work follows the larger of ``least`` and ``share`` of the vectors. ``share`` says how hard the data is, not how large: vectors spread evenly over 64 dimensions, as those of
the test tables are, need most of the table for a recall of 0.9; clustered ones need far less.

Edge cases. Vectors that are null, zero, hold a null or a value that is not finite, have no id, or are not
as long as most take no part. Rows with the same id are one vector, the smallest. Ties go to the smaller
id. With fewer than ``k`` other vectors all of them are returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stash

BITS = 64
DEPTH = 12


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)``: the vectors that take part, but for their length."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _codes(x: np.ndarray, last: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Each vector's string in each tree, as an unsigned number whose first bit is the highest."""
    planes = np.random.default_rng(seed).normal(size=(trees, x.shape[1] + 1, BITS))
    weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    full = np.concatenate([x, last[:, None]], axis=1)
    return np.stack([((full @ p) > 0).astype(np.uint64) @ weight for p in planes], axis=1)


def _stop_levels(codes: np.ndarray, counts: list[np.ndarray], budget: float) -> np.ndarray:
    """The most bits at which the prefixes of all trees together hold the budget."""
    level = np.zeros(len(codes), dtype=np.int64)
    for bits in range(1, DEPTH + 1):
        held = sum(counts[bits][t, (codes[:, t] >> np.uint64(BITS - bits)).astype(np.int64)] for t in range(codes.shape[1]))
        level[held >= budget] = bits
    return level


def longer_prefixes(code: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each string of ``own``: how many of the sorted ``code`` share its first DEPTH + 1, …, BITS bits."""
    out = np.zeros((len(own), BITS - DEPTH), dtype=np.int64)
    for k, bits in enumerate(range(DEPTH + 1, BITS + 1)):
        low = own >> np.uint64(BITS - bits) << np.uint64(BITS - bits)
        out[:, k] = np.searchsorted(code, low + np.uint64((1 << (BITS - bits)) - 1), side="right") - np.searchsorted(code, low, side="left")
    return out


def _best(scores: np.ndarray, ids: np.ndarray, exact, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one query: the k best by exact score, then id. Near ties of the quick scores are all looked at."""
    if len(ids) > k:
        floor = np.partition(scores, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(scores >= floor - 1e-9 * max(1.0, abs(floor)))
    else:
        near = np.arange(len(ids))
    value = exact(near)
    order = np.lexsort((ids[near], -value))[:k]
    return ids[near][order], value[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 16, share: float = 0.8, least: int = 2000, block: int = 4096, seed: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each ``queries(vec_id)`` its k nearest among the other vectors."""
    spark = vectors.sparkSession
    keys = ["tree", "prefix", "block", "side"]
    sound, _ = stash(sound_vectors(vectors), "vectors")
    sizes = sound.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top")).orderBy(F.desc("n"), F.desc("dim")).take(1)
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, top = sizes[0]["dim"], sizes[0]["n"], sizes[0]["top"]
    budget = max(float(least), share * n)
    depth = int(np.clip(np.floor(np.log2(max(1.0, trees * n / budget))), 0, DEPTH))
    part = sound.where(F.size("embedding") == dim)

    def index_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                codes = _codes(x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1))), trees, seed)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(list(codes.view(np.int64)), pa.list_(pa.int64()))], names=["vec_id", "embedding", "codes"])

    kind = part.schema["embedding"].dataType.simpleString()
    index, _ = stash(part.mapInArrow(index_codes, f"vec_id long, embedding {kind}, codes array<long>"), "vector-codes")
    prefix = F.shiftrightunsigned("code", BITS - DEPTH)
    tallies = index.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", prefix.alias("prefix")).agg(F.count("*").alias("n")).toArrow()  # trees * 2**DEPTH rows at most
    counts = [np.zeros((trees, 1 << DEPTH))]
    counts[0][tallies["tree"].to_numpy(), tallies["prefix"].to_numpy()] = tallies["n"].to_numpy()
    for _ in range(DEPTH):
        counts.append(counts[-1].reshape(trees, -1, 2).sum(axis=2))
    counts.reverse()
    blocks = np.maximum(1, np.ceil(counts[depth] / block)).astype(np.int64)

    def prefixes(codes: np.ndarray, t: int) -> np.ndarray:
        return (codes[:, t] >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(codes), np.int64)

    def spread(ids: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def repeat(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, each as often as said, and the how-manieth each is."""
        return np.repeat(np.arange(len(times)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

    def strings(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, trees).view(np.uint64)

    def visits(codes: np.ndarray, level: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The dealt prefixes that each query's own prefix covers."""
        wide = np.maximum(0, depth - level)
        row, step = repeat(1 << wide)
        return row, (prefixes(codes, t) >> wide << wide)[row] + step

    def visit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 1 << depth), dtype=np.int64)
        for b in batches:
            codes, level = strings(b.column(2)), b.column(3).to_numpy()
            for t in range(trees):
                total[t] += np.bincount(visits(codes, level, t)[1], minlength=1 << depth)
        t, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(at), pa.array(total[t, at])], names=["tree", "prefix", "n"])

    def with_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                codes = _codes(x, np.zeros(len(x)), trees, seed)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(codes.view(np.int64)), pa.list_(pa.int64())), pa.array(_stop_levels(codes, counts, budget))], names=["vec_id", "embedding", "codes", "level"])

    asked = index.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "embedding")
    asked, _ = stash(asked.mapInArrow(with_levels, f"vec_id long, embedding {kind}, codes array<long>, level long"), "asked")
    loads = asked.mapInArrow(visit_counts, "tree int, prefix long, n long").groupBy("tree", "prefix").agg(F.sum("n").alias("n")).toArrow()
    query_blocks = np.ones((trees, 1 << depth), dtype=np.int64)
    query_blocks[loads["tree"].to_numpy(), loads["prefix"].to_numpy()] = np.ceil(loads["n"].to_numpy() / block)

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = strings(b.column(2))
            for t in range(trees):
                own = prefixes(codes, t)
                row, side = repeat(query_blocks[t, own])
                at, ids = own[row], b.column(0).take(pa.array(row))
                columns = [np.full(len(row), t, np.int32), at, spread(ids.to_numpy()) % blocks[t, at], side, codes[row, t].view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids, b.column(1).take(pa.array(row))], names=[*keys, "code", "vec_id", "embedding"])

    def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, level = strings(b.column(2)), b.column(3).to_numpy()
            for t in range(trees):
                asker, at = visits(codes, level, t)
                deep, piece = repeat(blocks[t, at])
                row, at = asker[deep], at[deep]
                ids = b.column(0).take(pa.array(row))
                columns = [np.full(len(row), t, np.int32), at, piece, spread(ids.to_numpy()) % query_blocks[t, at], codes[row, t].view(np.int64), level[row]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids, b.column(1).take(pa.array(row))], names=[*keys, "code", "level", "query_id", "embedding"])

    def count_longer(left: pa.Table, right: pa.Table) -> pa.Table:
        held = longer_prefixes(np.sort(left["code"].to_numpy().view(np.uint64)), right["code"].to_numpy().view(np.uint64))
        return pa.table({"query_id": right["query_id"], "held": pa.array(list(held), pa.list_(pa.int64()))})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            code = left["code"].to_numpy().view(np.uint64)
            order = np.argsort(code, kind="stable")
            code, ids, x = code[order], left["vec_id"].to_numpy()[order], _matrix(left["embedding"])[order]
            asked, level, q = right["query_id"].to_numpy(), right["level"].to_numpy(), _matrix(right["embedding"])
            own = right["code"].to_numpy().view(np.uint64)
            for at in range(0, len(q), 256):
                quick = q[at : at + 256] @ x.T
                for r in range(len(quick)):
                    i = at + r
                    if level[i] > depth:
                        low = own[i] >> np.uint64(BITS - level[i]) << np.uint64(BITS - level[i])
                        a = int(np.searchsorted(code, low, side="left"))
                        z = int(np.searchsorted(code, low + np.uint64((1 << (BITS - int(level[i]))) - 1), side="right"))
                    else:
                        a, z = 0, len(code)
                    mine = ids[a:z] != asked[i]
                    rows = np.arange(a, z)[mine]
                    if len(rows):
                        got, value = _best(quick[r, rows], ids[rows], lambda near, rows=rows, i=i: (x[rows[near]] * q[i]).sum(axis=1), k)
                        found.append((int(asked[i]), got, value))
        if not found:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    dealt = "tree int, prefix long, block long, side long, code long"
    left = index.select("vec_id", "embedding", "codes").mapInArrow(index_rows, f"{dealt}, vec_id long, embedding {kind}")
    askers = f"{dealt}, level long, query_id long, embedding {kind}"
    deep = asked.where(F.col("level") == DEPTH)
    if deep.limit(1).count():
        pieces = deep.mapInArrow(query_rows, askers).select(*keys, "code", "query_id")
        held = left.select(*keys, "code").groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(count_longer, "query_id long, held array<long>")
        sums = held.select("query_id", F.posexplode("held").alias("bit", "n")).groupBy("query_id", "bit").agg(F.sum("n").alias("n"))
        reached = sums.where(F.col("n") >= budget).groupBy("query_id").agg(F.max("bit").alias("bit"))
        asked, _ = stash(asked.join(reached, asked["vec_id"] == reached["query_id"], "left").select("vec_id", "embedding", "codes", F.coalesce(F.col("bit") + (DEPTH + 1), F.col("level")).cast("long").alias("level")), "asked-deep")
    right = asked.mapInArrow(query_rows, askers)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
