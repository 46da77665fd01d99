"""The six steps from raw reviews to the evaluation report.

Each step reads the stored tables of earlier steps and stores its own. A step
whose table is already finished is skipped, provided it was built with the same
parameters from the same tables and files; only the evaluation always runs.
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from review_trust.config import Config
from review_trust.functions.text import clean_text
from review_trust.operators import embedding, features, kcore, metrics, profiles, ranking, split, suspicious, trust
from review_trust.plans import report
from review_trust.schema import BASELINE, ITEM, TRUST, USER
from review_trust.sources.artifacts import exists, materialize, summary_of
from review_trust.sources.reviews import BAD, LINE, read_lines

logger = logging.getLogger(__name__)

RAW = "reviews_raw"
REVIEWS, CLEAN, FEATURES, SCORES = "reviews", "reviews_clean", "features", "features_trust"
EMBEDDINGS, USER_PROFILES, ITEM_PROFILES = "review_embeddings", "user_profiles", "item_profiles"
RANKINGS, METRICS, SHIFTS = "rankings", "metrics", "rank_shifts"
ALL_RANKINGS = "rankings_all_users"

# Tables that are built once, in order.
TABLES = (RAW, REVIEWS, CLEAN, FEATURES, EMBEDDINGS, USER_PROFILES, ITEM_PROFILES, SCORES)

ROWS = {"rows": "count(1)"}


def stored(spark: SparkSession, cfg: Config, name: str) -> DataFrame:
    """The finished table of an earlier step."""
    path = cfg.path(name)
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run the step that builds it first")
    return spark.read.parquet(path)


def ingest(spark: SparkSession, cfg: Config) -> DataFrame:
    """Raw JSON reviews reduced to their k-core.

    The lines are parsed once, into a table in which malformed ones lie apart; a run with too many of them fails.
    """

    def few_malformed(found: Mapping[str, object]) -> None:
        if found["malformed"] > cfg.max_malformed * found["rows"]:
            raise ValueError(f"{found['malformed']} of {found['rows']} lines are malformed, see {cfg.path(RAW)}")

    def build() -> DataFrame:
        raw = good_lines(spark, cfg)
        return kcore.core_reviews(raw, kcore.k_core(raw, cfg.min_interactions))

    materialize(
        spark,
        cfg.path(RAW),
        lambda: read_lines(spark, cfg.raw_path),
        ROWS
        | {
            "malformed": f"count_if({BAD})",
            "without_id": f"count_if(NOT {BAD} AND ({USER} IS NULL OR {ITEM} IS NULL))",
        },
        partition_by=(BAD,),
        inputs=[cfg.raw_path],
        check=few_malformed,
    )
    parameters = {"min_interactions": cfg.min_interactions}
    return materialize(spark, cfg.path(REVIEWS), build, ROWS, parameters=parameters, upstream=[cfg.path(RAW)])


def _malformed() -> Column:
    return F.col(BAD).cast("boolean")  # the folder's name is read back as a string


def good_lines(spark: SparkSession, cfg: Config) -> DataFrame:
    """The raw reviews without malformed lines."""
    return stored(spark, cfg, RAW).filter(~_malformed()).drop(BAD, LINE)


def quarantine(spark: SparkSession, cfg: Config) -> DataFrame:
    """The malformed lines."""
    return stored(spark, cfg, RAW).filter(_malformed()).select(LINE)


def step_summaries(spark: SparkSession, cfg: Config) -> DataFrame:
    """What was observed when each table was written: step, metric, value."""
    found = [(name, summary_of(spark, cfg.path(name))) for name in TABLES]
    rows = [(name, metric, None if v is None else float(v)) for name, seen in found for metric, v in seen.items()]
    return spark.createDataFrame(rows, "step string, metric string, value double")


def preprocess(spark: SparkSession, cfg: Config) -> DataFrame:
    upstream = [cfg.path(REVIEWS)]
    return materialize(spark, cfg.path(CLEAN), lambda: clean_text(stored(spark, cfg, REVIEWS)), ROWS, upstream=upstream)


def build_features(spark: SparkSession, cfg: Config) -> DataFrame:
    """User features of the uncleaned reviews."""
    return materialize(
        spark,
        cfg.path(FEATURES),
        lambda: features.user_features(features.by_user(stored(spark, cfg, REVIEWS))),
        {"users": "count(1)"},
        upstream=[cfg.path(REVIEWS)],
    )


def embed(spark: SparkSession, cfg: Config, encoder: embedding.EncoderFactory | None = None) -> DataFrame:
    """Review vectors, stored once, and from them the user and item profiles."""

    def build() -> DataFrame:
        reviews = stored(spark, cfg, CLEAN)
        if encoder is None:  # reads the parts of ``review_text``: many reviews may share a text, few a title too
            parts = reviews.select(USER, ITEM, "title", "text")
            return embedding.joined_embedding(parts, "title", "text", cfg.encoder_dim).drop("title")
        reviews = reviews.select(USER, ITEM, "review_text")
        vectors = embedding.embed(reviews, encoder=encoder, batch_size=cfg.encoder_batch)
        return vectors.drop("review_text")

    name = "hashed words" if encoder is None else f"{encoder.__module__}.{encoder.__qualname__}"
    parameters = {"encoder": name} | ({"dim": cfg.encoder_dim} if encoder is None else {})
    vectors = materialize(spark, cfg.path(EMBEDDINGS), build, ROWS, parameters=parameters, upstream=[cfg.path(CLEAN)])
    dim = profiles.vector_length(vectors)
    for name, means in ((USER_PROFILES, profiles.user_profiles), (ITEM_PROFILES, profiles.item_profiles)):
        materialize(
            spark, cfg.path(name), functools.partial(means, vectors, dim), ROWS, upstream=[cfg.path(EMBEDDINGS)]
        )
    return vectors


def anomaly(spark: SparkSession, cfg: Config) -> DataFrame:
    """The features with a trust score, in a table of their own."""
    return materialize(
        spark,
        cfg.path(SCORES),
        lambda: trust.trust_scores(stored(spark, cfg, FEATURES), cfg.n_trees, cfg.sample_size, cfg.seed),
        {"min_trust": "min(trust_score)", "max_trust": "max(trust_score)"},
        parameters={"n_trees": cfg.n_trees, "sample_size": cfg.sample_size, "seed": cfg.seed},
        upstream=[cfg.path(FEATURES)],
    )


def rank_all(spark: SparkSession, cfg: Config, top_k: int = 20) -> DataFrame:
    """Rankings for every user, with item trust taken from all reviews."""
    factors = ranking.item_trust(stored(spark, cfg, REVIEWS), stored(spark, cfg, SCORES))
    users, items = stored(spark, cfg, USER_PROFILES), stored(spark, cfg, ITEM_PROFILES)
    ranked = ranking.rank_items(users, items, factors, top_k)
    ranked.write.mode("overwrite").partitionBy("variant").parquet(cfg.path(ALL_RANKINGS))
    return stored(spark, cfg, ALL_RANKINGS)


def evaluate(spark: SparkSession, cfg: Config) -> str:
    """Rank for the evaluable users, compare both variants, store everything and return the report."""
    reviews = stored(spark, cfg, CLEAN).select(USER, ITEM, "timestamp")
    users, items = stored(spark, cfg, USER_PROFILES), stored(spark, cfg, ITEM_PROFILES)
    train, test, _ = split.temporal_split(reviews, cfg.test_ratio)
    evaluable = split.eval_users(train, test, users)
    factors = ranking.item_trust(train, stored(spark, cfg, SCORES))

    ranked = ranking.rank_items(users.join(evaluable, USER, "left_semi"), items, factors, max(cfg.top_k))
    ranked.write.mode("overwrite").partitionBy("variant").parquet(cfg.path(RANKINGS))
    ranked = spark.read.parquet(cfg.path(RANKINGS))
    baseline, trusted = (ranked.filter(F.col("variant") == v) for v in (BASELINE, TRUST))

    metrics.compare(ranked, split.ground_truth(test), cfg.top_k).write.mode("overwrite").parquet(cfg.path(METRICS))
    metrics.rank_shift(baseline, trusted).write.mode("overwrite").parquet(cfg.path(SHIFTS))
    shifts = spark.read.parquet(cfg.path(SHIFTS))

    text = report.evaluation_report(
        n_train=train.count(),
        n_test=test.count(),
        n_users=evaluable.count(),
        comparison=spark.read.parquet(cfg.path(METRICS)).collect(),
        mean_shift=metrics.overall_shift(shifts).first()["mean_shift"],
        demoted=metrics.most_demoted(shifts).collect(),
    )
    report.save_report(spark, text, cfg.path("evaluation_report"))
    return text


def suspicious_report(spark: SparkSession, cfg: Config) -> str:
    """A review of each of the least trusted users, stored and returned as Markdown."""
    rows = suspicious.suspicious_reviews(stored(spark, cfg, CLEAN), stored(spark, cfg, SCORES)).collect()
    text = report.suspicious_report(rows)
    report.save_report(spark, text, cfg.path("suspicious_reviews"))
    return text


STEPS: dict[str, Callable[..., object]] = {
    "ingest": ingest,
    "preprocess": preprocess,
    "features": build_features,
    "embed": embed,
    "anomaly": anomaly,
    "evaluate": evaluate,
}


def run(
    spark: SparkSession,
    cfg: Config,
    steps: Iterable[str] | None = None,
    encoder: embedding.EncoderFactory | None = None,
) -> None:
    """Run the named steps, or all of them, in pipeline order; ``encoder`` replaces the default one."""
    wanted = set(STEPS if steps is None else steps)
    unknown = wanted - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    for name, step in STEPS.items():
        if name in wanted:
            logger.info("step %s", name)
            step(spark, cfg, encoder) if name == "embed" else step(spark, cfg)
