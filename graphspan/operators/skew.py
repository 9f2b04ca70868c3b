"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def may_crowd(rows: DataFrame, key: str, total: int, most: int) -> bool:
    """Whether a key may have `most` of the `total` rows: no key has more than the slot of its hash,
    and slots, 64 for each key that could be so large, are counted where the rows lie."""
    slots = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(64 * (total // most + 1)))).agg(F.count("*").alias("n"))
    return not slots.filter(F.col("n") >= most).isEmpty()


def split_hot(left: DataFrame, stats: DataFrame, key: str, count: str, total: int, floor: int = 64) -> tuple[DataFrame, DataFrame]:
    """left joined with stats on key: (rows of hot keys, the rest), to be united by the caller.

    stats has one row per key with its count among `total` rows. Keys with at least
    max(floor, total / 10,000) rows are hot; so they are 10,000 at most, are broadcast, and their
    rows stay where they are. Other keys are joined by a shuffle in which no key is large.
    """
    at = max(floor, math.ceil(total / 10_000))
    hot = stats.filter(F.col(count) >= at)
    cold = stats.filter(F.col(count) < at)
    return left.join(F.broadcast(hot), key), left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
