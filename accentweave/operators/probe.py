"""Probes of scorers: do several ways of running one agree with what is expected, how far are they apart, how long do they take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import argmax


def _apart(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def summary(runs: DataFrame, expected: DataFrame, baseline: str) -> DataFrame:
    """``(unit, cases, hits, mean_ms, max_abs_diff)`` of ``runs(unit, case, logits, ms)``, one row for each unit.

    ``expected(case, best)`` has the 0-based place that should score highest; ``hits`` counts the cases where it does.
    ``max_abs_diff`` is the farthest that a logit lies from that of the unit ``baseline`` for the same case. A case that
    the baseline or ``expected`` lacks counts as a case and adds nothing else.
    """
    base = runs.where(F.col("unit") == baseline).select("case", F.col("logits").alias("base"))
    rows = runs.join(base, "case", "left").join(expected, "case", "left")
    hit = argmax(F.col("logits")) == F.col("best")
    return rows.groupBy("unit").agg(F.count("*").alias("cases"), F.count_if(hit).alias("hits"), F.avg("ms").alias("mean_ms"), F.max(_apart(F.col("logits"), F.col("base"))).alias("max_abs_diff"))
