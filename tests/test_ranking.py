import numpy as np
import pyarrow as pa
import pytest

from review_trust.operators import ranking, skew
from review_trust.operators.ranking import item_trust, rank_items
from review_trust.schema import BASELINE, TRUST

FACTORS = "parent_asin string, item_trust_factor double"


def profiles(spark, key, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], f"{key} string, profile array<double>")


def lists(ranked, variant):
    rows = ranked.filter(f"variant = '{variant}'").orderBy("user_id", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r.user_id, []).append((r.parent_asin, r.score))
        assert r["rank"] == len(out[r.user_id])
    return out


def brute_force(users, items, factors, k, variant):
    def unit(v):
        n = np.linalg.norm(v)
        return np.asarray(v, float) / n if n else np.zeros(len(v))

    out = {}
    for u, uv in users.items():
        scores = []
        for i, iv in items.items():
            s = max(float(unit(uv) @ unit(iv)), 0.0) * (factors.get(i, 1.0) if variant == TRUST else 1.0)
            scores.append((-round(s, 9) + 0.0, i))
        out[u] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for user in got:
        assert [i for i, _ in got[user]] == [i for i, _ in expected[user]], user
        assert [s for _, s in got[user]] == pytest.approx([s for _, s in expected[user]], abs=2e-9)


def test_item_trust_and_fused_ranking(spark):
    reviews = spark.createDataFrame([("u1", "i1"), ("u1", "i2"), ("u2", "i2"), ("u2", "i3")], "user_id string, parent_asin string")
    trust = spark.createDataFrame([("u1", 1.0), ("u2", 0.0)], "user_id string, trust_score double")
    factors = item_trust(reviews, trust)
    assert {r[0]: r[1] for r in factors.collect()} == {"i1": 1.0, "i2": 0.5, "i3": 0.0}
    users = profiles(spark, "user_id", {"u1": [1, 0], "u2": [0, 1]})
    items = profiles(spark, "parent_asin", {"i1": [1, 0], "i2": [0.7, 0.7], "i3": [1, 1]})
    ranked = rank_items(users, items, factors, top_k=3).cache()
    assert "i1" in [i for i, _ in lists(ranked, BASELINE)["u1"]]
    trusted = lists(ranked, TRUST)
    assert trusted["u1"][0][0] == "i1" and trusted["u2"][0][0] == "i2"


@pytest.mark.parametrize("limit", [10**6, 0])
def test_item_trust_weighs_reviews_and_defaults_to_one(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_IDS", limit)
    monkeypatch.setattr(skew, "TARGET_ROWS", 5)
    rows = [("hot", f"i{n % 7}") for n in range(100)] + [("v", "i0")] * 3 + [("unknown", "i1")]
    reviews = spark.createDataFrame(rows, "user_id string, parent_asin string")
    trust = spark.createDataFrame([("hot", 0.25), ("v", 0.5)], "user_id string, trust_score double")
    got = {r[0]: r[1] for r in item_trust(reviews, trust).collect()}
    assert got["i0"] == pytest.approx((15 * 0.25 + 3 * 0.5) / 18)
    assert got["i1"] == pytest.approx((15 * 0.25 + 1.0) / 16)
    assert got["i5"] == 0.25


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_ties_zero_vectors_and_short_catalogues(spark, limit):
    users = {"u1": [1, 0], "u2": [0, 0], "u3": [-1, -1]}
    items = {"b": [2, 0], "a": [1, 0], "c": [0, 1], "z": [0, 0]}
    factors = spark.createDataFrame([("b", 0.5)], FACTORS)
    args = profiles(spark, "user_id", users), profiles(spark, "parent_asin", items), factors
    for k in (2, 10):
        ranked = rank_items(*args, top_k=k, broadcast_bytes=limit).cache()
        for variant in (BASELINE, TRUST):
            same(lists(ranked, variant), brute_force(users, items, {"b": 0.5}, k, variant))
    assert [i for i, _ in lists(ranked, BASELINE)["u1"]] == ["a", "b", "c", "z"]
    assert [i for i, _ in lists(ranked, BASELINE)["u2"]] == ["a", "b", "c", "z"]


def test_empty_catalogue(spark):
    ranked = rank_items(
        profiles(spark, "user_id", {"u": [1, 0]}), profiles(spark, "parent_asin", {"a": [1, 0]}).limit(0), spark.createDataFrame([], FACTORS)
    )
    assert ranked.columns == ["variant", "user_id", "rank", "parent_asin", "score"] and ranked.count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("spread", [0.02, 10.0])
def test_matches_brute_force(spark, monkeypatch, limit, spread):
    """Tight clusters and none; a third of the items share one vector, so ties cross the batches."""
    monkeypatch.setattr(ranking, "TILE_ITEMS", 17)
    monkeypatch.setattr(ranking, "CHUNK_SCORES", 500)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    users = {f"u{n}": centres[n % 12] + spread * rng.normal(size=6) for n in range(40)}
    items = {f"i{n}": centres[n % 12] + spread * rng.normal(size=6) for n in range(200)}
    items |= {f"same{n}": centres[0] for n in range(100)}
    users["none"] = items["zero"] = np.zeros(6)
    weights = {i: round(float(rng.uniform()), 3) for i in items if i != "i3"}
    factors = spark.createDataFrame(list(weights.items()), FACTORS)
    ranked = rank_items(
        profiles(spark, "user_id", users),
        profiles(spark, "parent_asin", items),
        factors,
        top_k=7,
        broadcast_bytes=limit,
        block_bytes=80 * (6 * 8 + ranking.ID_BYTES),
    ).cache()
    for variant in (BASELINE, TRUST):
        same(lists(ranked, variant), brute_force(users, items, weights, 7, variant))


def test_users_stay_in_place(spark, monkeypatch):
    """No exchange moves a user, and every block is broadcast once."""
    monkeypatch.setattr(ranking, "TILE_ITEMS", 5)
    plans, sent = [], []
    real, tiles = ranking.Scratch, ranking._tiles

    def scratch(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(ranking, "Scratch", scratch)
    monkeypatch.setattr(ranking, "_tiles", lambda block: sent.append(block.num_rows) or tiles(block))
    rng = np.random.default_rng(6)
    items = {f"i{n}": rng.normal(size=4) for n in range(50)}
    users = {f"u{n}": rng.normal(size=4) for n in range(40)}
    args = profiles(spark, "user_id", users), profiles(spark, "parent_asin", items), spark.createDataFrame([], FACTORS)
    ranked = rank_items(*args, top_k=5, broadcast_bytes=0, block_bytes=16 * (4 * 8 + ranking.ID_BYTES))
    assert sum(sent) == 50 and max(sent) <= 32 and [name for name, _ in plans] == ["best-items"] * (len(sent) - 1)
    for plan in [p for _, p in plans] + [ranked._jdf.queryExecution().executedPlan().toString()]:
        assert "Exchange" not in plan and "Join" not in plan
    for variant in (BASELINE, TRUST):
        same(lists(ranked, variant), brute_force(users, items, {}, 5, variant))


def test_tiles_out_of_reach_are_skipped(monkeypatch):
    """Users near one center never see the items around the others."""
    rng = np.random.default_rng(8)
    centers = np.eye(6)
    vectors = ranking.unit_rows(np.repeat(centers, 50, axis=0) + 0.01 * rng.normal(size=(300, 6)))
    block = pa.table(
        {
            "order": np.arange(300),
            "tile": np.repeat(np.arange(6), 50).astype(np.int32),
            "parent_asin": [f"i{n:03}" for n in range(300)],
            "profile": pa.array(vectors.tolist()),
            "item_trust_factor": np.full(300, 1.0),
        }
    )
    seen = []
    add = ranking._Best.add
    monkeypatch.setattr(ranking._Best, "add", lambda self, u, s, t: seen.append((len(u), s.shape)) or add(self, u, s, t))
    users = ranking.unit_rows(np.repeat(centers[:2], 30, axis=0) + 0.01 * rng.normal(size=(60, 6)))
    best = {v: ranking._Best(60, 10) for v in (BASELINE, TRUST)}
    ranking._score_tiles(users, ranking._tiles(block), best)
    assert sum(n for n, _ in seen) <= 2 * 60 * 2  # the own tile, and the other one of the batch where it comes first
    want = np.argsort(-np.round(users @ vectors.T, 9), axis=1, kind="stable")[:, :10]
    assert (best[BASELINE].order == want).all()


def test_single_precision_only_picks_pairs(monkeypatch):
    """Cosines that differ less than single precision tells apart are ranked by their double-precision scores, and few pairs need them."""
    rng = np.random.default_rng(9)
    near = np.array([[1.0, 3e-9 * n] for n in range(40)]) * rng.uniform(1, 5, size=(40, 1))
    vectors = np.vstack((ranking.unit_rows(near)[::-1], ranking.unit_rows(rng.normal(size=(4000, 2)))))
    block = pa.table(
        {
            "order": np.arange(len(vectors)),
            "tile": (np.arange(len(vectors)) // 500).astype(np.int32),
            "parent_asin": [f"i{n:04}" for n in range(len(vectors))],
            "profile": pa.array(vectors.tolist()),
            "item_trust_factor": np.full(len(vectors), 1.0),
        }
    )
    pairs = []
    cosines = ranking._cosines
    monkeypatch.setattr(ranking, "_cosines", lambda u, i: pairs.append(len(u)) or cosines(u, i))
    users = ranking.unit_rows(np.array([[1.0, 1.0], [1.0, 0.0], [0.3, -1.0]]))
    best = {v: ranking._Best(3, 10) for v in (BASELINE, TRUST)}
    ranking._score_tiles(users, ranking._tiles(block), best)
    scores = np.round(np.maximum(users @ vectors.T, 0.0), 9)
    want = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    assert (best[BASELINE].order == want).all()
    assert np.array_equal(best[TRUST].scores, np.take_along_axis(scores, want, axis=1))
    assert sum(pairs) < 0.1 * 2 * scores.size
