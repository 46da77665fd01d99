"""The least trusted users and a review of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_trust.config import REPORT_ROWS
from review_trust.schema import ITEM, USER


def suspicious_users(trust: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    """The ``n`` users with the lowest trust score, ties by id."""
    return trust.select(USER, "trust_score").orderBy("trust_score", USER).limit(n)


def suspicious_reviews(reviews: DataFrame, trust: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    """The earliest review of each of the ``n`` least trusted users, least trusted first.

    Rows carry no order of their own; equal times are settled by the remaining columns.
    """
    worst = F.broadcast(suspicious_users(trust, n))  # n rows
    order = ["timestamp", ITEM]
    rest = [c for c in reviews.columns if c not in (*order, USER)]
    first = reviews.join(worst, USER).groupBy(USER, "trust_score").agg(F.min(F.struct(*order, *rest)).alias("r"))
    return first.select(USER, "trust_score", "r.*").orderBy("trust_score", USER)
