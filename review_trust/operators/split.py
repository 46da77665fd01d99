"""Temporal train/test split and the users it can evaluate."""

from __future__ import annotations

import math
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_trust.config import TEST_RATIO
from review_trust.functions.times import epoch_micros, instant
from review_trust.schema import ITEM, USER
from review_trust.sources.artifacts import Scratch

# Buckets counted per narrowing step of the order statistic.
FANOUT = 65_536
# The sketch errs by at most one in ACCURACY ranks; the bracket leaves twice that to either side.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY


def nearest_rank(n: int, q: float) -> int:
    """0-based index of the nearest-rank quantile ``q`` of ``n`` values, halves rounded up."""
    return math.floor((n - 1) * q + 0.5)


def order_statistic(df: DataFrame, value: Column, q: float) -> int | None:
    """Exact nearest-rank quantile of an integer column, nulls left out.

    Two passes at any size. The first counts the values and brackets the wanted one with a mergeable quantile sketch,
    ``MARGIN`` of the ranks to either side. The second counts the values below the bracket and stores those within it,
    each once with its number: a few in ten thousand. What is left to do reads that table only.
    """
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    around = [max(0.0, q - MARGIN), min(1.0, q + MARGIN)]
    sketch = F.percentile_approx("v", around, ACCURACY)
    n, least, most, bracket = values.agg(F.count("v"), F.min("v"), F.max("v"), sketch).first()
    if not n:
        return None
    rank = nearest_rank(n, q)
    for low, high in (bracket, (least, most)):  # the second one if the sketch has missed, which it promises not to
        seen = Observation()
        counted = values.observe(seen, F.count_if(F.col("v") < low).alias("below"), F.count_if(F.col("v") <= high).alias("upto"))
        inside = Scratch(counted.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n")), "bracket")
        found = seen.get
        if found["below"] <= rank < found["upto"]:
            break
        inside.remove()
    result = _weighted(inside.table, rank - found["below"], low, high)
    inside.remove()
    return result


def _weighted(counts: DataFrame, rank: int, low: int, high: int) -> int:
    """The value of ``rank`` among ``counts`` (v, n) between low and high, by counting ever narrower ranges."""
    small = counts.count() <= FANOUT  # from the file footers
    while low < high:
        width = 1 if small else (high - low) // FANOUT + 1
        bucket = F.call_function("div", F.col("v") - F.lit(low), F.lit(width)).alias("bucket")
        within = counts.filter(F.col("v").between(low, high))
        rows = within.groupBy(bucket).agg(F.sum("n").alias("n")).collect()  # at most FANOUT rows
        rows.sort(key=lambda row: row["bucket"])
        for row, end in zip(rows, accumulate(row["n"] for row in rows)):
            if rank < end:
                rank -= end - row["n"]
                low, high = low + row["bucket"] * width, min(high, low + (row["bucket"] + 1) * width - 1)
                break
    return low


class Split(NamedTuple):
    """Reviews up to the cutoff, reviews after it, and the cutoff in epoch microseconds."""

    train: DataFrame
    test: DataFrame
    cutoff: int | None


def temporal_split(reviews: DataFrame, test_ratio: float = TEST_RATIO) -> Split:
    """Split at the (1 - test_ratio) quantile of time; a review without a time falls in neither part."""
    if isinstance(reviews.schema["timestamp"].dataType, T.IntegralType):
        # The column itself is compared, so that the bounds reach the file reader.
        time, unit = F.col("timestamp"), 1000
    else:
        time, unit = epoch_micros(reviews), 1
    cutoff = order_statistic(reviews, time, 1.0 - test_ratio)
    limit = F.lit(cutoff).cast("long")
    if isinstance(reviews.schema["timestamp"].dataType, T.DatetimeType):
        time, limit = F.col("timestamp"), instant(reviews, cutoff)
    return Split(reviews.filter(time <= limit), reviews.filter(time > limit), None if cutoff is None else cutoff * unit)


def ground_truth(test: DataFrame) -> DataFrame:
    """The set of items each user reviewed in the test period."""
    return test.select(USER, ITEM).distinct()


def eval_users(train: DataFrame, test: DataFrame, profiles: DataFrame) -> DataFrame:
    """Users present in test and train who have a profile.

    Each side is reduced to distinct users before the joins, so they match one
    row per user and a very active user weighs no more than any other.
    """
    users = test.select(USER).distinct()
    return users.join(train.select(USER).distinct(), USER, "left_semi").join(profiles.select(USER), USER, "left_semi")
