"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, gathered, stash

LINKS_A_TASK = 1 << 20
_SCHEMA = "a long, b long"


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hang every node of the links ``a, b`` on the smallest node it is connected to by them."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = number[: len(a)], number[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's links: 16 bytes each, and about five times that while it works."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = contract(*(np.concatenate(column) for column in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every node is hung on smaller nodes, links stay connected."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
    return small.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """``(node, root)``: for each node of ``links(a, b)`` the smallest node it is connected to.

    Tasks of about ``links_a_task`` links contract what they hold. Where there is but one such task, that is all.
    Otherwise large-star and small-star steps, whose links never outnumber the first ones, alternate with
    contractions until a step changes nothing; each step's links are written to the shared folder. The number of
    steps grows with the logarithm of the number of nodes. Only counts and sums of links come to the driver.
    """
    given, path = stash(gathered(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()), "links")
    tasks = max(1, -(-given.count() // links_a_task))
    dealt = given.coalesce(1) if tasks == 1 else given.repartition(tasks, "a", "b")
    now, new = stash(dealt.mapInArrow(_contracted, _SCHEMA), "links")
    discard(links.sparkSession, path)
    path, seen = new, None
    while tasks > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, old = mark, path
        now, path = stash(_stars(now).repartition(tasks, "a", "b").mapInArrow(_contracted, _SCHEMA).distinct(), "links")
        discard(links.sparkSession, old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
