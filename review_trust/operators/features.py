"""Behavioural features per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_trust.functions.times import epoch_micros, utc_day, whole_days
from review_trust.schema import FEATURES, ITEM, USER
from review_trust.sources.artifacts import cut_by_key

# Fixed value: ratings that count as extreme.
EXTREME_RATINGS = (1.0, 5.0)


def _filled(column: str) -> Column:
    """Null and NaN become zero."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def rating_histogram(reviews: DataFrame) -> DataFrame:
    """Reviews per user and rating; a missing rating is a bucket of its own."""
    return reviews.groupBy(USER, "rating").agg(F.count("*").alias("n"))


def _entropy() -> Column:
    """Shannon entropy in bits of the buckets of size ``n`` in a group; exactly zero for one bucket."""
    total = F.sum("n")
    bits = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return F.when(F.count("*") > 1, bits).otherwise(F.lit(0.0))


def rating_entropy(reviews: DataFrame) -> DataFrame:
    return rating_histogram(reviews).groupBy(USER).agg(_entropy().alias("rating_entropy"))


def burstiness(reviews: DataFrame) -> DataFrame:
    """The most reviews a user wrote on one UTC calendar day."""
    day = utc_day(epoch_micros(reviews)).alias("day")
    daily = reviews.select(USER, day).groupBy(USER, "day").agg(F.count("*").alias("n"))
    return daily.groupBy(USER).agg(F.max("n").alias("burstiness"))


def distinct_items(reviews: DataFrame) -> DataFrame:
    pairs = reviews.groupBy(USER, ITEM).agg(F.count("*").alias("n"))
    return pairs.groupBy(USER).agg(F.count("*").alias("n_items"))


def measure_text(reviews: DataFrame) -> DataFrame:
    """``text`` replaced by its length as ``text_length``; a missing text has none."""
    return reviews.withColumn("text_length", F.length(F.coalesce("text", F.lit("")))).drop("text")


def by_user(reviews: DataFrame) -> DataFrame:
    """What ``user_features`` reads, stored in buckets by user: the rows move once instead of once per aggregate."""
    if "text_length" not in reviews.columns:
        reviews = measure_text(reviews)
    columns = (USER, ITEM, "timestamp", "rating", "verified_purchase", "helpful_vote", "text_length")
    return cut_by_key(reviews.select(*columns), "measured", USER)


def _totals(reviews: DataFrame) -> DataFrame:
    """All features that add up over (user, rating) buckets.

    The buckets are combined before the shuffle, so a user with very many
    reviews reaches the second aggregation as a handful of rows.
    """
    verified = F.sum(F.col("verified_purchase").cast("double"))
    if "text_length" not in reviews.columns:
        reviews = measure_text(reviews)
    buckets = (
        reviews.withColumn("micros", epoch_micros(reviews))
        .groupBy(USER, "rating")
        .agg(
            F.count("*").alias("n"),
            verified.alias("verified"),
            F.sum("helpful_vote").alias("helpful"),
            F.count("helpful_vote").alias("n_helpful"),
            F.min("micros").alias("first"),
            F.max("micros").alias("last"),
            F.sum("text_length").alias("chars"),
        )
    )
    total = F.sum("n")
    rated = F.sum(F.when(F.col("rating").isNotNull(), F.col("n")))
    mean = F.sum(F.col("rating") * F.col("n")) / rated
    squares = F.sum(F.col("rating") * F.col("rating") * F.col("n"))
    n_ratings = F.count("rating")
    variance = (squares - mean * mean * rated) / F.nullif(rated - 1, F.lit(0))
    extreme = F.sum(F.when(F.col("rating").isin(*EXTREME_RATINGS), F.col("n")).otherwise(0))
    return buckets.groupBy(USER).agg(
        total.alias("review_count"),
        mean.alias("avg_rating"),
        F.when(n_ratings > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("rating_std"),
        (extreme / total).alias("pct_extreme"),
        (F.sum("verified") / total).alias("pct_verified"),
        (F.sum("helpful") / F.nullif(F.sum("n_helpful"), F.lit(0))).alias("avg_helpful"),
        whole_days(F.min("first"), F.max("last")).alias("activity_span_days"),
        (F.sum("chars") / total).alias("avg_text_length"),
        _entropy().alias("rating_entropy"),
    )


def user_features(reviews: DataFrame) -> DataFrame:
    """The eleven features, one row per user.

    A column ``text_length`` may stand for the text itself.

    Three aggregates by user, each combined map-side, end hash-partitioned by
    user, so the joins between them add no shuffle. Over reviews stored
    ``by_user`` the aggregates shuffle nothing either.
    """
    joined = (
        _totals(reviews)
        .join(burstiness(reviews), USER, "left")
        .join(distinct_items(reviews), USER, "left")
        .withColumn("unique_items_ratio", F.col("n_items") / F.col("review_count"))
    )
    counts = {"review_count", "activity_span_days", "burstiness"}
    columns = [
        (F.coalesce(c, F.lit(0)).cast(T.LongType()) if c in counts else _filled(c)).alias(c) for c in FEATURES
    ]
    return joined.select(USER, *columns)
