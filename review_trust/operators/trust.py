"""User trust: an isolation forest over the behavioural features, scaled to [0, 1]."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from review_trust.config import FOREST_SAMPLE, FOREST_TREES, SEED
from review_trust.schema import USER
from review_trust.sources.artifacts import cut

EULER_GAMMA = 0.5772156649015329

# Tables of at most so many users are dealt to all cores first.
SPREAD_USERS = 1_000_000
# Decimals of a feature that the forest looks at.
FEATURE_DIGITS = 9


def feature_columns(features: DataFrame) -> list[str]:
    """Every column but the key and an earlier trust score."""
    return [c for c in features.columns if c not in (USER, "trust_score")]


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation per column; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
    ).first()

    def scaled(c: str) -> Column:
        if not stats[f"{c}_std"]:
            return F.lit(0.0)
        return (F.col(c) - F.lit(stats[f"{c}_mean"])) / F.lit(stats[f"{c}_std"])

    return df.withColumns({c: scaled(c) for c in columns})


def min_max_scale(df: DataFrame, column: str, output: str) -> DataFrame:
    """Map ``column`` onto [0, 1]; a constant column becomes 1."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or low == high:
        return df.withColumn(output, F.lit(1.0))
    return df.withColumn(output, (F.col(column) - F.lit(low)) / F.lit(high - low))


def mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        path = 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, path, np.where(n == 2, 1.0, 0.0))


def _digest(seed: int, *parts: Column | str) -> Column:
    """32 hex digits that depend on the seed and the parts only, in place of a random stream."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def _sampled(points: DataFrame, n_trees: int, sample: int, share: float, seed: int) -> DataFrame:
    """The ``sample`` users with the smallest digest of (tree, user) for every tree: tree, x.

    Only users whose digest lies in the lowest ``share`` are passed on, so about ``n_trees * sample`` times a small
    factor rows are shuffled, not ``n_trees * n``, and the choice does not depend on partitioning.
    """
    limit = f"{min(2**64 - 1, int(share * 2**64)):016x}"
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    drawn = F.transform(
        trees,
        lambda t: F.struct(t.alias("tree"), F.substring(_digest(seed, t.cast("string"), USER), 1, 16).alias("draw")),
    )
    drawn = points.select(USER, "x", F.explode(F.filter(drawn, lambda d: d["draw"] <= limit)).alias("d"))
    order = Window.partitionBy("tree").orderBy("draw", USER)
    ranked = drawn.select("d.*", USER, "x").withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= sample).select("tree", "x")


def _grown(rows: DataFrame, dim: int, limit: int, seed: int) -> DataFrame:
    """The isolation trees of sampled ``rows`` (tree, x): tree, node, splits and the leaf's size, per row.

    All trees grow by a level at once. The nodes of a tree are numbered from 1, the children of ``n`` are ``2 n`` and
    ``2 n + 1``. The digest of seed, tree and node decides on the feature, among those that vary in the node, and on the
    threshold, evenly in the feature's range. The rows are shuffled once, by tree; a level is a window over each node.
    """
    rows = rows.withColumns({"node": F.lit(1), "leaf": F.lit(False), "splits": F.array().cast(_SPLITS)})
    node = Window.partitionBy("tree", "node")
    for _ in range(limit):
        element = [F.get("x", F.lit(i)) for i in range(dim)]
        rows = rows.withColumns(
            {
                "low": F.array(*[F.min(e).over(node) for e in element]),
                "high": F.array(*[F.max(e).over(node) for e in element]),
            }
        )
        varying = F.filter(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ~F.col("leaf") & (F.get("high", i) > F.get("low", i))
        )
        digest = _digest(seed, F.col("tree").cast("string"), F.col("node").cast("string"))
        rows = rows.withColumns({"varying": varying, "digest": digest})
        pick = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.size("varying")
        rows = rows.withColumn("feature", F.get("varying", F.shiftright(pick, 32).cast("int")))
        part = F.conv(F.substring("digest", 9, 13), 16, 10).cast("double") / float(1 << 52)
        low, high = F.get("low", F.col("feature")), F.get("high", F.col("feature"))
        at = low + part * (high - low)
        # Rounding in a very narrow range; both sides must get rows.
        rows = rows.withColumn("threshold", F.when(at >= high, low).otherwise(at))
        right = (F.get("x", F.col("feature")) > F.col("threshold")).cast("int")
        split = F.struct("node", "feature", "threshold")
        inner = F.col("feature").isNotNull()
        rows = rows.select(
            "tree",
            "x",
            F.when(inner, 2 * F.col("node") + right).otherwise(F.col("node")).alias("node"),
            (~inner).alias("leaf"),
            F.when(inner, F.concat("splits", F.array(split))).otherwise(F.col("splits")).alias("splits"),
        )
    return rows.select("tree", "node", "splits", F.count("*").over(node).alias("size"))


_SPLITS = "array<struct<node:int,feature:int,threshold:double>>"


def _fit(points: DataFrame, n_trees: int, sample: int, share: float, seed: int) -> pd.DataFrame:
    """All trees as one table: tree, node, feature (-1 in a leaf), threshold, size (0 in an inner node), by tree and node."""
    dim = points.select(F.max(F.size("x"))).first()[0]
    limit = math.ceil(math.log2(max(sample, 2)))
    grown = cut(_grown(_sampled(points, n_trees, sample, share, seed), dim, limit, seed), "trees")
    leaf = grown.groupBy("tree", "node").agg(F.max("size").alias("size"))
    leaf = leaf.select("tree", "node", F.lit(-1).alias("feature"), F.lit(0.0).alias("threshold"), "size")
    inner = grown.select("tree", F.inline("splits")).distinct().withColumn("size", F.lit(0).cast("long"))
    # At most n_trees * (2 * sample - 1) rows, whatever the number of users.
    return leaf.unionByName(inner).toPandas().sort_values(["tree", "node"], ignore_index=True)


def features_vector(features: DataFrame) -> Column:
    """The features as an array, rounded so that the trees do not hang on the order in which features were summed."""
    return F.array(*[F.round(F.col(c).cast("double"), FEATURE_DIGITS) for c in feature_columns(features)])


def isolation_forest(
    features: DataFrame, n_trees: int = FOREST_TREES, sample_size: int = FOREST_SAMPLE, seed: int = SEED
) -> DataFrame:
    """Add ``anomaly_score``: the higher (closer to 0), the more normal the user.

    The score is ``-2 ** (-mean path length / expected path length)``. A
    contamination offset would move every score by the same amount and is left
    out. Splits are uniform in each feature's range, so scaling the features
    first would not change the scores' distribution. All that is random follows
    from digests of the seed, so SQL grows the same trees.
    """
    n = features.count()
    if n <= SPREAD_USERS:  # a small table lies in few files, and every user is drawn for and walks down every tree
        features = features.repartition(features.sparkSession.sparkContext.defaultParallelism)
    x = features_vector(features)
    points = features.select(USER, x.alias("x"))
    sample = min(sample_size, n)
    # Three times the wanted share: too few rows for a tree is then all but impossible.
    share = min(1.0, 3.0 * sample / n) if n > 2 * sample else 1.0
    while n:
        nodes = _fit(points, n_trees, sample, share, seed)
        drawn = nodes.groupby("tree")["size"].sum()
        if share >= 1.0 or (len(drawn) == n_trees and drawn.min() == sample):
            break
        share = min(1.0, 2.0 * share)
    if not n:
        return features.withColumn("anomaly_score", F.lit(None).cast("double"))

    # One flat node table; children become absolute positions, leaves point to themselves.
    place = {key: i for i, key in enumerate(zip(nodes["tree"].tolist(), nodes["node"].tolist()))}
    start = np.array([place[t, 1] for t in sorted(nodes["tree"].unique())])
    own = np.arange(len(nodes))
    leaf = (nodes["feature"] < 0).to_numpy()
    left, right = (
        np.array([i if end else place[t, 2 * m + side] for i, t, m, end in zip(own, nodes["tree"], nodes["node"], leaf)])
        for side in (0, 1)
    )
    feature = np.where(leaf, 0, nodes["feature"].to_numpy())
    threshold = np.where(leaf, 0.0, nodes["threshold"].to_numpy())
    depth = np.floor(np.log2(nodes["node"].to_numpy())).astype(int)
    path = depth + mean_path(nodes["size"].to_numpy())
    forest = features.sparkSession.sparkContext.broadcast(
        (start, feature, threshold, left, right, path, int(depth.max()))
    )
    expected = float(mean_path(np.array([sample]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        roots, feature, threshold, left, right, path, depth = forest.value
        for batch in batches:
            rows = np.vstack(batch) if len(batch) else np.empty((0, 1))
            total = np.zeros(len(rows))
            index = np.arange(len(rows))
            for root in roots:
                at = np.full(len(rows), root)
                for _ in range(depth):
                    at = np.where(rows[index, feature[at]] <= threshold[at], left[at], right[at])
                total += path[at]
            yield pd.Series(-np.exp2(-total / len(roots) / expected))

    return features.withColumn("anomaly_score", score(x))


def trust_scores(
    features: DataFrame, n_trees: int = FOREST_TREES, sample_size: int = FOREST_SAMPLE, seed: int = SEED
) -> DataFrame:
    """Add ``trust_score``: 0 for the most anomalous user, 1 for the most normal one.

    ``features`` is read three times, so hand in a stored table. The forest
    runs over it once; its scores are stored before they are scaled.
    """
    scored = cut(isolation_forest(features.drop("trust_score"), n_trees, sample_size, seed), "scores")
    return min_max_scale(scored, "anomaly_score", "trust_score").drop("anomaly_score")
