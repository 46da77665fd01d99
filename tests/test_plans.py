"""Plans that have to hold at any size."""

import pytest
from pyspark.sql import functions as F

from review_trust.functions.text import clean_text
from review_trust.operators import features, metrics, profiles, suspicious
from review_trust.plans.queries import QUERIES
from review_trust.schema import REVIEW_SCHEMA
from review_trust.sources.reviews import read_json


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def reviews(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "reviews")
    spark.createDataFrame([], REVIEW_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_json_reader_is_pruned_to_the_selected_columns(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"user_id": "u", "parent_asin": "i", "images": [{"a": 1}], "rating": 5.0}\n')
    df = read_json(spark, str(tmp_path / "r.jsonl"))
    assert df.first().images == ['{"a": 1}']  # elements kept as raw JSON
    text = plan(df.select("user_id", "parent_asin"))
    assert "ReadSchema: struct<parent_asin:string,user_id:string>" in text


def test_feature_joins_add_no_shuffle(reviews, no_broadcast):
    """Three aggregates with two exchanges each, all ending on user_id; the joins reuse that."""
    text = plan(features.user_features(reviews))
    assert text.count("SortMergeJoin") == 2
    assert text.count("Exchange hashpartitioning(user_id#") == 6
    assert "images" not in text and "title" not in text


def test_features_of_reviews_stored_by_user_shuffle_nothing(reviews, no_broadcast):
    text = plan(features.user_features(features.by_user(reviews)))
    assert text.count("SortMergeJoin") == 2 and "Exchange" not in text


def test_feature_queries_store_reviews_by_user(spark, no_broadcast):
    assert "Exchange" not in plan(QUERIES["user_features"](spark, "/root/testdata/sf0.001"))


def test_text_cleaning_runs_in_the_jvm_without_a_shuffle(reviews):
    text = plan(clean_text(reviews))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("regexp_replace") == 6  # each of three patterns once per column


def test_profiles_combine_before_the_shuffle(reviews):
    vectors = reviews.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    for dim in (None, 2):
        text = plan(profiles.user_profiles(vectors, dim))
        assert "partial_" in text and text.count("Exchange") == 1


def test_rank_shift_shuffles_twice(spark, no_broadcast):
    ranked = spark.createDataFrame([("u", 1, "i")], "user_id string, rank int, parent_asin string")
    text = plan(metrics.rank_shift(ranked, ranked))
    assert text.count("Exchange") == 2 and "Join" not in text


def test_feature_query_reads_its_sources_once(spark):
    text = plan(QUERIES["user_features"](spark, "/root/testdata/sf0.001"))
    assert text.count("FileScan") == 3 and "RoundRobin" not in text
    assert not any(name in text for name in ("lineitem", "orders", "documents"))  # joined once, when stored


def test_no_plan_holds_a_cross_join(spark, reviews):
    trust = spark.createDataFrame([("u", 0.5)], "user_id string, trust_score double")
    ranked = spark.createDataFrame([("trust", "u", 1, "i")], "variant string, user_id string, rank int, parent_asin string")
    truth = reviews.select("user_id", "parent_asin")
    for df in (suspicious.suspicious_reviews(reviews, trust), metrics.compare(ranked, truth), metrics.rank_shift(ranked, ranked)):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
