import hashlib

import numpy as np
import pytest

from review_trust.operators import trust


def crowd(spark, partitions=3, n=90, apart=4):
    """A cloud of shoppers around the origin, one feature of which is constant, and some far from it in every feature."""
    rng = np.random.default_rng(7)
    near, far = rng.normal(size=(n, 3)), rng.normal(size=(apart, 3)) + 40.0
    rows = [(f"cloud-{i}", *map(float, v), 2) for i, v in enumerate(near)]
    rows += [(f"apart-{i}", *map(float, v), 2) for i, v in enumerate(far)]
    return spark.createDataFrame(rows, "user_id string, x double, y double, z double, same int").repartition(partitions)


@pytest.mark.parametrize("n", [90, 2_500])
def test_users_apart_get_low_trust(spark, n):
    got = {r.user_id: r.trust_score for r in trust.trust_scores(crowd(spark, n=n), n_trees=50).collect()}
    assert len(got) == n + 4 and min(got.values()) == 0.0 and max(got.values()) == 1.0
    means = [np.mean([v for k, v in got.items() if k.startswith(kind)]) for kind in ("apart", "cloud")]
    assert means[0] + 0.3 < means[1]


def test_scores_do_not_depend_on_partitioning_or_an_earlier_score(spark):
    def scores(df, **options):
        return trust.trust_scores(df, n_trees=20, **options).orderBy("user_id").toPandas()

    one = scores(crowd(spark, 2))
    assert one.equals(scores(crowd(spark, 7)))
    assert np.array_equal(one["trust_score"], scores(spark.createDataFrame(one))["trust_score"])
    assert not one.equals(scores(crowd(spark), seed=1))


def test_constant_features_are_fully_trusted(spark):
    df = spark.createDataFrame([(f"u{i}", 1.0, 2) for i in range(10)], "user_id string, a double, b int")
    assert {r.trust_score for r in trust.trust_scores(df).collect()} == {1.0}
    assert trust.trust_scores(df.limit(1)).first().trust_score == 1.0
    assert trust.trust_scores(df.filter("a > 1")).count() == 0


def fitted(spark, df, n_trees, sample, share):
    points = df.select("user_id", trust.features_vector(df).alias("x"))
    return points, trust._fit(points, n_trees, sample, share, 42)


def test_every_tree_gets_a_full_sample(spark):
    _, nodes = fitted(spark, crowd(spark, n=2_500), 20, 64, 3 * 64 / 2_504)
    assert set(nodes["tree"]) == set(range(20))
    leaf = nodes[nodes["feature"] < 0]
    assert set(leaf.groupby("tree")["size"].sum()) == {64} and (leaf["size"] > 0).all()
    assert nodes["node"].max() < 1 << 7
    inner = nodes[nodes["feature"] >= 0]
    assert set(inner["feature"]) == {0, 1, 2}  # never the constant one
    keys = set(zip(nodes["tree"], nodes["node"]))
    assert {(t, 2 * n + side) for t, n in zip(inner["tree"], inner["node"]) for side in (0, 1)} | {
        (t, 1) for t in range(20)
    } == keys


def test_trees_equal_a_plain_replay(spark):
    """Features and thresholds follow from the digest of seed, tree and node."""
    points, nodes = fitted(spark, crowd(spark), 5, 40, 1.0)
    found = {(r.tree, r.node): r for r in nodes.itertuples()}
    rows = {r.user_id: list(r.x) for r in points.collect()}
    for tree in range(5):
        draws = sorted((hashlib.md5(f"42:{tree}:{u}".encode()).hexdigest()[:16], u) for u in rows)
        todo = [(1, [rows[u] for _, u in draws[:40]])]
        while todo:
            node, part = todo.pop()
            varying = [f for f in range(4) if len({x[f] for x in part}) > 1]
            row = found.pop((tree, node))
            if node >= 1 << 6 or not varying:
                assert row.feature == -1 and row.size == len(part)
                continue
            digest = hashlib.md5(f"42:{tree}:{node}".encode()).hexdigest()
            feature = varying[int(digest[:8], 16) * len(varying) >> 32]
            low, high = (f(x[feature] for x in part) for f in (min, max))
            at = low + int(digest[8:21], 16) / 2**52 * (high - low)
            assert (row.feature, row.threshold) == (feature, low if at >= high else at)
            for side in (0, 1):
                todo.append((2 * node + side, [x for x in part if (x[feature] > row.threshold) == side]))
    assert not found


def test_path_lengths_match_a_walk_down_each_tree(spark):
    df = crowd(spark).select("user_id", "x", "z")
    got = {r.user_id: r.anomaly_score for r in trust.isolation_forest(df, n_trees=10).collect()}
    points, nodes = fitted(spark, df, 10, 94, 1.0)
    table = {(r.tree, r.node): r for r in nodes.itertuples()}
    for row in points.limit(20).collect():
        total = 0.0
        for tree in range(10):
            at = table[tree, 1]
            while at.feature >= 0:
                at = table[tree, 2 * at.node + (row.x[at.feature] > at.threshold)]
            total += at.node.bit_length() - 1 + trust.mean_path(np.array([at.size]))[0]
        expected = -(2.0 ** (-(total / 10) / trust.mean_path(np.array([94]))[0]))
        assert got[row.user_id] == pytest.approx(expected)


def test_narrow_ranges_still_split(spark):
    low = 1e-9  # the smallest step there is after rounding
    rows = [(f"u{i}", low * (i % 2)) for i in range(16)]
    _, nodes = fitted(spark, spark.createDataFrame(rows, "user_id string, a double"), 3, 16, 1.0)
    assert sorted(nodes["size"]) == [0] * 3 + [8] * 6


def test_mean_path():
    assert list(trust.mean_path(np.array([0, 1, 2]))) == [0.0, 0.0, 1.0]
    assert trust.mean_path(np.array([256]))[0] == pytest.approx(10.2448, abs=1e-3)


def test_scalers(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 3.0, 3.0)], "user_id string, x double, c double")
    scaled = {r.user_id: (r.x, r.c) for r in trust.standard_scale(df, ["x", "c"]).collect()}
    assert scaled == {"a": (-1.0, 0.0), "b": (1.0, 0.0)}
    assert {r.user_id: r.s for r in trust.min_max_scale(df, "x", "s").collect()} == {"a": 0.0, "b": 1.0}
    assert {r.s for r in trust.min_max_scale(df, "c", "s").collect()} == {1.0}
