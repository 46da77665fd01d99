import glob
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from review_trust.operators import ranking
from review_trust.plans import queries
from review_trust.schema import BASELINE, ITEM, TRUST, USER
from review_trust.sources import tables
from review_trust.sources.artifacts import materialize, scratch_dir

LINES = 40


def stored(spark):
    """Names of the scratch tables of this session that are there now."""
    top = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    return sorted(os.listdir(top)) if os.path.isdir(top) else []


def kinds(names):
    return sorted(name.rsplit("-", 1)[0] for name in names)


def vectors(spark, key, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], f"{key} string, profile array<double>")


def test_rounds_leave_only_the_last_state(spark):
    """Items, cells, blocks, users and the states of earlier rounds go as soon as nothing reads them."""
    rng = np.random.default_rng(3)
    before = set(stored(spark))
    users = vectors(spark, USER, [(f"u{n}", rng.normal(size=4)) for n in range(20)])
    items = vectors(spark, ITEM, [(f"i{n}", rng.normal(size=4)) for n in range(60)])
    factors = spark.createDataFrame([], f"{ITEM} string, item_trust_factor double")
    block_bytes = 16 * (4 * 8 + ranking.ID_BYTES)
    ranked = ranking.rank_items(users, items, factors, 5, broadcast_bytes=0, block_bytes=block_bytes)
    assert kinds(set(stored(spark)) - before) == ["best-items"]
    assert ranked.count() == 2 * 20 * 5


def shuffles(spark):
    return spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def test_shuffles_go_with_their_query(spark, tmp_path):
    spark.sparkContext._jvm.System.gc()
    before = shuffles(spark)
    kept = []
    for n in range(5):
        kept.append(spark.range(1000).groupBy("id").count())
        kept[-1].write.parquet(f"{tmp_path}/{n}")
    assert shuffles(spark) <= before + 1


def test_shared_texts_are_stored_once_a_file(spark, tmp_path):
    """More distinct text than the writer's default dictionary holds, each in many rows."""
    rng = np.random.default_rng(4)
    texts = [rng.bytes(4000).hex() for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in range(8000)], "n int").coalesce(1)
    text = "element_at(array({}), cast(n / 40 as int) + 1)".format(", ".join(f"'{x}'" for x in texts))
    read = materialize(spark, f"{tmp_path}/t", lambda: df.selectExpr("n", f"{text} AS text"))
    assert [r.text for r in read.orderBy("n").collect()] == [texts[n // 40] for n in range(8000)]
    (file,) = glob.glob(f"{tmp_path}/t/*.parquet")
    assert os.path.getsize(file) < 2 * sum(map(len, texts))
    assert pq.ParquetFile(file).metadata.row_group(0).column(1).compression == "ZSTD"


def test_raw_lines_go_once_they_are_ingested(spark, monkeypatch):
    rows = [(f"u{n % 5}", f"i{n % 7}", 1_600_000_000_000 + n, 4.0, True, n, "title", f"text {n % 3}") for n in range(LINES)]
    columns = f"{USER} string, {ITEM} string, timestamp long, rating double, verified_purchase boolean, helpful_vote long"
    wide = spark.createDataFrame(rows, f"{columns}, title string, text string")
    monkeypatch.setattr(tables, "reviews", lambda *a, **b: wide)
    monkeypatch.setattr(queries, "CORE", 2)
    seen = []
    run = queries.pipeline.run

    def spied(spark, cfg, steps=None):
        raw = cfg.raw_path.removeprefix("file:")
        seen.append((list(steps), os.path.isdir(raw)))
        run(spark, cfg, steps)

    monkeypatch.setattr(queries.pipeline, "run", spied)
    cfg = queries._whole_run(spark, "unused", ("ingest", "features"))
    assert seen == [(["ingest"], True), (["features"], False)]
    assert queries.pipeline.stored(spark, cfg, queries.pipeline.REVIEWS).count() == LINES


def random_block(rng, n, dim, trust):
    order = rng.permutation(n)
    return pa.table(
        {
            "order": order,
            "tile": (np.arange(n) // 97).astype(np.int32),
            "parent_asin": [f"i{x:05}" for x in order],
            "profile": pa.array(np.repeat(rng.normal(size=(n // 2, dim)), 2, axis=0).tolist()),
            "item_trust_factor": trust,
        }
    )


@pytest.mark.parametrize("k", [1, 7, 200])
@pytest.mark.parametrize("low, high", [(0.2, 1.0), (-1.0, 0.5), (-1.0, -0.5), (0.0, 3.0)])
def test_one_pass_for_both_variants(monkeypatch, k, low, high):
    """Factors of any sign, equal vectors, and rows that fill up many times: all as if every pair were sorted.

    Both variants are picked from one product, so a pair is scored in double precision once, not once for each.
    """
    rng = np.random.default_rng(k)
    monkeypatch.setattr(ranking, "CHUNK_SCORES", 640)
    n, dim = 400, 5
    block = random_block(rng, n, dim, rng.uniform(low, high, n))
    users = ranking.unit_rows(rng.normal(size=(30, dim)))
    pairs = []
    cosines = ranking._cosines
    monkeypatch.setattr(ranking, "_cosines", lambda u, i: pairs.append(len(u)) or cosines(u, i))
    best = {v: ranking._Best(30, k) for v in (BASELINE, TRUST)}
    ranking._score_tiles(users, ranking._tiles(block), best)
    assert sum(pairs) <= 30 * n
    cosine = np.maximum(users @ ranking.unit_rows(ranking.matrix(block.column("profile"))).T, 0.0)
    order = block.column("order").to_numpy()
    for variant, factor in ((BASELINE, np.ones(n)), (TRUST, block.column("item_trust_factor").to_numpy())):
        scores = np.round(cosine * factor, 9) + 0.0
        want = np.array([np.lexsort((order, -row))[:k] for row in scores])
        assert np.allclose(best[variant].scores, np.take_along_axis(scores, want, axis=1), atol=2e-9)
        assert (best[variant].order == order[want]).mean() > 0.99  # a last digit may round either way
