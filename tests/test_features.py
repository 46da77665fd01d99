import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from review_trust.operators.features import user_features
from review_trust.schema import FEATURES

SCHEMA = (
    "user_id string, parent_asin string, timestamp bigint, rating double, verified_purchase boolean, "
    "helpful_vote bigint, text string"
)
T0 = 1_600_000_000_000
HOUR = 3_600_000
DAY = 24 * HOUR


def features(spark, rows):
    table = user_features(spark.createDataFrame(rows, SCHEMA))
    assert table.columns == ["user_id", *FEATURES]
    return {r.user_id: r for r in table.collect()}


def test_two_users(spark):
    rows = [
        ("U1", "A1", T0, 5.0, True, 2, "abc"),
        ("U1", "A2", T0 + 1000, 5.0, True, 1, "abcde"),
        ("U1", "A3", T0 + 2000, 5.0, False, 0, None),
        ("U2", "A1", T0, 1.0, True, 10, "x"),
        ("U2", "A2", T0 + 2 * DAY, 5.0, True, 0, "y"),
    ]
    got = features(spark, rows)
    u1, u2 = got["U1"], got["U2"]
    assert (u1.review_count, u1.avg_rating, u1.burstiness, u1.rating_entropy, u1.pct_extreme) == (3, 5.0, 3, 0.0, 1.0)
    assert u1.pct_verified == pytest.approx(2 / 3)
    assert (u1.avg_helpful, u1.activity_span_days, u1.unique_items_ratio, u1.rating_std) == (1.0, 0, 1.0, 0.0)
    assert u1.avg_text_length == pytest.approx(8 / 3)
    assert (u2.review_count, u2.avg_rating, u2.burstiness, u2.rating_entropy, u2.activity_span_days) == (2, 3.0, 1, 1.0, 2)
    assert (u2.pct_extreme, u2.pct_verified, u2.avg_helpful) == (1.0, 1.0, 5.0)
    assert u2.rating_std == pytest.approx(math.sqrt(8))


def test_single_review_and_missing_values(spark):
    got = features(
        spark,
        [
            ("one", "A", T0, 3.0, True, None, "\U0001f600\U0001f600"),
            ("none", "A", None, None, None, None, None),
            ("none", "A", None, None, None, None, None),
            ("nan", "A", T0, float("nan"), True, 1, ""),
        ],
    )
    assert (got["one"].rating_std, got["one"].avg_helpful, got["one"].avg_text_length) == (0.0, 0.0, 2.0)
    none = got["none"]
    assert (none.avg_rating, none.rating_std, none.pct_verified, none.activity_span_days) == (0.0, 0.0, 0.0, 0)
    assert (none.burstiness, none.rating_entropy, none.unique_items_ratio) == (2, 0.0, 0.5)
    assert (got["nan"].avg_rating, got["nan"].rating_entropy) == (0.0, 0.0)


def test_span_counts_whole_days_not_dates(spark):
    midnight = T0 // DAY * DAY
    got = features(spark, [("u", "A", midnight - HOUR, 1.0, True, 0, ""), ("u", "B", midnight + 46 * HOUR, 2.0, True, 0, "")])
    assert (got["u"].activity_span_days, got["u"].burstiness) == (1, 1)


def test_days_before_1970(spark):
    got = features(spark, [("u", "A", -1, 1.0, True, 0, ""), ("u", "B", 1, 2.0, True, 0, "")])
    assert got["u"].burstiness == 1


def test_timestamp_column(spark):
    rows = [("u", "A", T0, 1.0, True, 0, ""), ("u", "B", T0 + 3 * DAY, 2.0, True, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_millis("timestamp"))
    row = user_features(df).first()
    assert (row.activity_span_days, row.burstiness) == (3, 1)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_without_a_zone_are_utc(spark, zone):
    """Including a day on which New York skips an hour."""
    hours = [(10, 0), (10, 10), (10, 23), (11, 1)]
    rows = [("u", f"i{n}", T0, 1.0, True, 0, "") for n in range(len(hours))]
    df = spark.createDataFrame(rows, SCHEMA)
    naive = F.element_at(
        F.array(*[F.lit(f"2024-03-{d} {h:02}:30:00") for d, h in hours]), F.substring("parent_asin", 2, 1).cast("int") + 1
    )
    micros = F.unix_micros(F.concat(naive, F.lit("Z")).cast("timestamp"))
    kinds = {
        "ntz": naive.cast("timestamp_ntz"),
        "date": naive.cast("date"),
        "long": (micros / 1000).cast("long"),
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {k: user_features(df.withColumn("timestamp", c)).first() for k, c in kinds.items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {k: r.burstiness for k, r in got.items()} == {"ntz": 3, "date": 3, "long": 3}
    # 25 hours from the first to the last review.
    assert {k: r.activity_span_days for k, r in got.items()} == {"ntz": 1, "date": 1, "long": 1}


def test_matches_a_direct_computation(spark):
    rng = random.Random(7)
    rows = []
    for n in range(2000):
        user = "hot" if n % 3 == 0 else f"u{rng.randrange(40)}"
        rows.append(
            (
                user,
                f"i{rng.randrange(30)}",
                T0 + rng.randrange(60 * DAY),
                rng.choice([1.0, 2.0, 3.0, 4.5, 5.0, None]),
                rng.choice([True, False]),
                rng.choice([0, 1, 7, None]),
                rng.choice(["", "abc", None, "é" * 9]),
            )
        )
    got = features(spark, rows)
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for user, g in frame.groupby("user_id"):
        p = g["rating"].value_counts(dropna=False) / len(g)
        expected = {
            "review_count": len(g),
            "avg_rating": g["rating"].mean(),
            "rating_std": g["rating"].std(),
            "pct_extreme": g["rating"].isin([1.0, 5.0]).mean(),
            "pct_verified": g["verified_purchase"].mean(),
            "avg_helpful": g["helpful_vote"].mean(),
            "activity_span_days": (g["timestamp"].max() - g["timestamp"].min()) // DAY,
            "avg_text_length": g["text"].fillna("").str.len().mean(),
            "unique_items_ratio": g["parent_asin"].nunique() / len(g),
            "burstiness": (g["timestamp"] // DAY).value_counts().max(),
            "rating_entropy": -(p * p.map(math.log2)).sum(),
        }
        for name, value in expected.items():
            assert got[user][name] == pytest.approx(value), (user, name)
