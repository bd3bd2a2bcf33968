"""N-gram Jaccard self-join by prefix trees.

Method. A text's set is its distinct shingles of ``k`` words, each a number whose first byte is the class of
its frequency in the corpus and whose rest is a hash: ascending order of the numbers is one order for all
sets, rare shingles first. Two sets of similarity ``t`` share at least ``m`` of the first
``n - ceil(t n) + m`` shingles of each, their prefixes, so a link can only lie between texts that meet under
that many prefix shingles; ``m`` is ``MEET``, or 1 if one of them is small. Of a given pair the overlap ``o`` it
needs is known, and only meetings among the first ``n - o + m`` shingles of both count.

Texts with equal sets are one class, found first. Then:

1. Under each prefix shingle the class that meets most others in all is a star's centre; each class is paired
   with the centre it meets most often. Verified pairs are joined to components.
2. Under each prefix shingle only pairs of classes of different components are left. Each set has a sketch, whose
   bits say whether an odd number of its shingles falls on them; sketches differ in no more bits than sets in
   members, so pairs whose sketches differ in more than a link allows cannot link. All others are verified.

No link between two components is missed, and groups of near copies, which are one component after the
first step, are never expanded into all their pairs. Pairs are verified per centre by a prefix tree: the
partners' sets, in the common order, share the tree's branches; one traversal carries the overlap with the
centre down each branch and gives up a branch once its remaining length cannot reach the overlap needed.
A centre with many partners is dealt to several trees. Meetings under shingles whose counter is far above the mean
are first counted in ``SALTS`` parts each, so that no shingle's rows are one task's work.

Frequencies are counted over all shingles of all texts in a table of fixed size (``1 << SKETCH_BITS``
counters), which is all that is broadcast; shingles that fall on one counter are counted together, which
can only change the order, not the result.

Edge cases. A text of fewer than ``k`` words has its whole word sequence as its one shingle; one without
words, or null, has the empty set and is linked with nothing. A row with a null ``doc_id`` takes no part and has no
row in the result, or with ``null_ids`` one with its ``n_shingles`` and a null ``component_id``. Rows with the
same ``doc_id`` are documents of their own with that number. Shingles are compared by 56-bit hashes within
a frequency class and sets by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import free_name, gathered, small_batches, stash
from .textscan import mix, shingle_hashes, word_hashes

SKETCH_BITS = 18
MEET = 4
SMALL = 10
SALTS = 64
SKETCH = ("s0", "s1", "s2", "s3")
_LOW = np.uint64((1 << 56) - 1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each row: its sorted distinct shingle hashes, 56 bits."""
    for _, words, at in word_hashes(column, lower=True):
        for r in range(len(at) - 1):
            yield np.unique(shingle_hashes(words[at[r] : at[r + 1]], k) & _LOW)


def digest(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set."""
    sums = np.array([[mix(shingles).sum(), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(), np.uint64(len(shingles))]], dtype=np.uint64)
    return int(mix((mix(sums) * np.array([1, 3, 5], dtype=np.uint64)).sum(axis=1)).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for each value of the lowest byte: whether an odd number of shingles has it."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(56 - SKETCH_BITS)).astype(np.int64)


def ordered(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the common order: numbers with the frequency class above the hash."""
    return np.sort(classes[buckets(shingles)] << np.uint64(56) | shingles)


def needed(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + (MEET if n >= SMALL else 1)


def _enough(n: Column, m: Column) -> Column:
    """How many prefix shingles sets of n and m must share to link."""
    return F.when(F.least(n, m) >= SMALL, F.lit(MEET)).otherwise(F.lit(1))


class PrefixTree:
    """Sets in the common order as paths from a root; equal beginnings are one branch.

    Kept as the sorted list of paths with the length that each shares with the one before, which a
    depth-first traversal reads from left to right.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.paths = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.paths, self.paths[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def similar(self, probe: np.ndarray, percent: int) -> list[int]:
        """Which sets link with the probe.

        ``got[d]`` is the overlap of the branch's first d shingles with the probe and ``left[d]`` what the
        probe has beyond them; a branch holds at depth d if ``got[d] + min(rest of path, left[d])`` can still
        reach the overlap needed.
        """
        found, n = [], len(probe)
        got, left = np.zeros(1, np.int64), np.full(1, n)
        same, cut = 0, None  # how much of the path is that of ``got``; where that one was given up
        for i, path, shared in zip(self.order, self.paths, self.shared, strict=True):
            m, same = len(path), min(same, shared)
            need = needed(n, m, percent)
            if cut is not None and cut <= same and got[cut] + min(m - cut, left[cut]) < need:
                continue
            at = np.searchsorted(probe, path[same:])
            hit = (at < n) & (probe[np.minimum(at, n - 1)] == path[same:])
            got = np.concatenate([got[: same + 1], got[same] + np.cumsum(hit)])
            left = np.concatenate([left[: same + 1], n - at - hit])
            low = np.flatnonzero(got + np.minimum(m - np.arange(m + 1), left) < need)
            same, cut = m, int(low[0]) if len(low) else None
            if cut is None:
                found.append(i)
        return found


def _class_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.rint(12 * np.log2(1 + count))).astype(np.uint64)


def _classes(counts: DataFrame) -> tuple[np.ndarray, int]:
    """The frequency class of each counter, by twelfths of powers of two, and the first class that counts as crowded."""
    table = counts.toArrow()  # at most 1 << SKETCH_BITS rows
    total = np.zeros(1 << SKETCH_BITS)
    total[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return _class_of(total), int(_class_of(np.maximum(1 << 14, 8 * total.mean())))


def set_keys(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, node, *SKETCH)`` of each document, without a node where it takes no part, and ``(bucket, n)``: all shingles counted by counter."""

    names = ["doc_id", "n", "node", *SKETCH, "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            sizes, nodes = [len(s) for s in sets], [digest(s) if len(s) and there else None for s, there in zip(sets, b.column(0).is_valid().to_pylist(), strict=True)]
            if sets:
                total += np.bincount(buckets(np.concatenate(sets)), minlength=1 << SKETCH_BITS)
            bits = np.concatenate([np.zeros(0, np.int64), *(sketch(x) for x in sets)]).reshape(-1, len(SKETCH))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *(pa.array(bits[:, i].copy()) for i in range(len(SKETCH))), pa.nulls(len(sizes), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in names[:-1]), pa.array([total.astype(np.uint32).tobytes()], pa.binary())], names=names)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            for row in b.column(0):
                total += np.frombuffer(row.as_py(), dtype=np.uint32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    keys, _ = stash(docs.select("doc_id", "text").mapInArrow(scan, ", ".join(f"{c} long" for c in names[:-1]) + ", counts binary"), "set-keys")
    counts = keys.where("counts is not null").select("counts").mapInArrow(slices, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return keys.where("counts is null").drop("counts"), counts


def prefixes(docs: DataFrame, shared, k: int, percent: int) -> DataFrame:
    """``(token, node, n, pos)``: the prefix shingles of each distinct set; a task emits equal sets once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, done = shared.value, set()
        for b in batches:
            tokens, nodes, sizes = [np.zeros(0, np.uint64)], [], []
            for s in shingle_sets(b.column(0), k):
                if len(s) and (node := digest(s)) not in done:
                    done.add(node)
                    tokens.append(ordered(s, classes)[: prefix_length(len(s), percent)])
                    nodes.append(node)
                    sizes.append(len(s))
            each = [len(t) for t in tokens[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(e, dtype=np.int32) for e in each)]))], names=["token", "node", "n", "pos"])

    return docs.where("doc_id is not null").select("text").mapInArrow(scan, "token long, node long, n int, pos int")


def _sets_of(docs: DataFrame, owners: DataFrame, shared, k: int) -> DataFrame:
    """``(node, shingles)`` of ``owners(node, rep)``, read from the document that stands for each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ordered(s, shared.value) for s in shingle_sets(b.column(0), k)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(np.sort(s & _LOW)) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    read = docs.join(owners.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text").mapInArrow(scan, "node long, shingles binary")
    return read.join(owners.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, shared, k: int, percent: int, fan: int = 512) -> DataFrame:
    """Those of ``pairs(a, b)`` that link. Pairs of one ``a`` make trees of about ``fan`` sets each."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("trees"))
    dealt = pairs.join(load, "a").withColumn("tree", F.pmod(F.xxhash64("b"), F.col("trees")).cast("int"))
    dealt, _ = stash(gathered(dealt), "pairs")
    wanted = dealt.select(F.col("a").alias("node")).unionByName(dealt.select(F.col("b").alias("node"))).distinct()
    sets, _ = stash(_sets_of(docs, owners.join(wanted, "node", "left_semi"), shared, k), "sets")
    left = dealt.select("a", "tree").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("centre")), "a").select("a", "tree", "centre")
    right = dealt.select(F.col("a").alias("of"), F.col("tree").alias("part"), F.col("b").alias("node")).join(sets, "node").select("of", "part", F.col("node").alias("b"), "shingles")

    def probe(key: tuple, one: pa.Table, many: pa.Table) -> pa.Table:
        hits: list[int] = []
        if one.num_rows and many.num_rows:
            tree = PrefixTree([np.frombuffer(s.as_py(), dtype=np.uint64) for s in many["shingles"]])
            hits = tree.similar(np.frombuffer(one["centre"][0].as_py(), dtype=np.uint64), percent)
        return pa.table({"a": pa.array([key[0].as_py()] * len(hits), pa.int64()), "b": many["b"].take(pa.array(hits, pa.int64())) if hits else pa.array([], pa.int64())})

    return left.groupBy("a", "tree").cogroup(right.groupBy("of", "part")).applyInArrow(probe, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, null_ids: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``docs(doc_id, text)`` that has a ``doc_id``.

    Two documents link when 100 * intersection >= percent * union of their sets; ``component_id`` is the
    smallest ``doc_id`` that links lead to. With ``null_ids`` rows without a ``doc_id`` are there as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text") if null_ids else docs.select("doc_id", "text").where("doc_id is not null")
    keys, counts = set_keys(docs, k)
    classes, crowded = _classes(counts)
    shared = spark.sparkContext.broadcast(classes)
    owners = keys.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    # The parts of a crowded shingle are told apart by their salt; all others have the salt -1.
    salt = F.when(F.shiftrightunsigned("token", 56) >= crowded, F.pmod(F.hash("node"), F.lit(SALTS))).otherwise(-1)
    part = Window.partitionBy("token", "salt")
    rows = prefixes(docs, shared, k, percent).withColumn("salt", salt).withColumn("low", F.min("node").over(part)).withColumn("high", F.max("node").over(part)).where("low <> high or salt >= 0")
    crowd, _ = stash(rows.select("token", "salt", "node", "n", "pos").distinct().withColumn("crowd", F.count("*").over(part)).drop("salt"), "crowd")

    def early(x: str, y: str) -> Column:
        """Whether a meeting of ``x`` and ``y`` counts towards those that a link between them must have."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        spare = _enough(n, m) - F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.col(f"{x}.pos") < n + spare) & (F.col(f"{y}.pos") < m + spare)

    reach = crowd.groupBy("node").agg(F.sum("crowd").alias("reach"))
    ranked = crowd.drop("crowd").join(reach, "node")
    centres = ranked.groupBy("token").agg(F.max(F.struct("reach", "node", "n", "pos")).alias("y"))
    pairs = ranked.select("token", F.struct("node", "n", "pos").alias("x")).join(centres, "token").where("x.node <> y.node").where(early("x", "y"))
    votes = pairs.groupBy("x.node", F.col("y.node").alias("centre"), "x.n", F.col("y.n").alias("m")).agg(F.count("*").alias("met"))
    chosen = votes.where(F.col("met") >= _enough(F.col("n"), F.col("m"))).groupBy("node").agg(F.max_by("centre", F.struct("met", "centre")).alias("centre"))
    first = verified(chosen.select(F.col("centre").alias("a"), F.col("node").alias("b")), docs, owners, shared, k, percent)
    reached = components(first)

    placed = crowd.drop("crowd").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    sketches = keys.where("node is not null").groupBy("node").agg(*(F.max(c).alias(c) for c in SKETCH))
    open_rows = placed.join(mixed, "token").join(sketches, "node")
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCH), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    near = differ <= both - 2 * F.ceil(F.lit(percent) * both / F.lit(100 + percent))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & early("x", "y") & near
    met = open_rows.alias("x").join(open_rows.alias("y"), apart).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count("*").alias("met"))
    rest = met.where(F.col("met") >= _enough(F.col("n"), F.col("m"))).select("a", "b")
    second = verified(rest, docs, owners, shared, k, percent)

    # The links of both steps together; those of the first stand as ``reached`` has them.
    grouped = components(reached.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(second))
    shared.destroy()
    named = keys.join(grouped, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    # Written, so that a large component's rows can be split where they are joined.
    smallest, _ = stash(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest", narrow=True)
    return named.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest ``doc_id``.

    Of rows with equal ``doc_id`` and text one stays; rows with a null ``doc_id`` are all kept.
    """
    first, _ = stash(near_duplicates(docs, **options).where("doc_id = component_id").select("doc_id").distinct(), "first-of-group", narrow=True)
    form = free_name(docs, "form")
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").withColumn(form, F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", form]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
