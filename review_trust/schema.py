"""Column names and types of the review data model."""

from __future__ import annotations

from pyspark.sql import types as T

USER = "user_id"
ITEM = "parent_asin"

# Values of the ``variant`` column of a ranking.
BASELINE, TRUST = "baseline", "trust"

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("asin", T.StringType()),
        T.StructField(ITEM, T.StringType()),
        T.StructField(USER, T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("helpful_vote", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)

# The eleven behavioural features, in output order.
FEATURES = (
    "review_count",
    "avg_rating",
    "rating_std",
    "pct_extreme",
    "pct_verified",
    "avg_helpful",
    "activity_span_days",
    "avg_text_length",
    "unique_items_ratio",
    "burstiness",
    "rating_entropy",
)
