from review_trust.operators.suspicious import suspicious_reviews, suspicious_users
from review_trust.plans.report import suspicious_report


def test_earliest_review_of_the_least_trusted_users(spark):
    reviews = spark.createDataFrame(
        [("a", "i2", 5, 1.0, "t", "late"), ("a", "i1", 2, 5.0, "t", "first"), ("b", "i1", 9, 3.0, None, "b"), ("c", "i1", 1, 3.0, "t", "c")],
        "user_id string, parent_asin string, timestamp bigint, rating double, title string, review_text string",
    )
    trust = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.9), ("d", 0.0)], "user_id string, trust_score double")
    assert [r.user_id for r in suspicious_users(trust, 3).collect()] == ["b", "d", "a"]
    rows = suspicious_reviews(reviews, trust, 3).collect()
    assert [(r.user_id, r.trust_score, r.review_text) for r in rows] == [("b", 0.0, "b"), ("a", 0.5, "first")]
    text = suspicious_report(rows)
    assert "### Trust score `0.500000`, user `a`, item `i1`" in text and "> first" in text
    assert text.index("user `b`") < text.index("user `a`")
