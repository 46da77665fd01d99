import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_data import corpus, docs, lower, prose
from pyspark.sql import functions as F

from review_trust.llm import components as hubs
from review_trust.llm import jaccard
from review_trust.llm.components import components
from review_trust.sources.artifacts import cut


def sets_of(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        out.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    return out


def brute(rows):
    """(size, component) of every row; rows without an id have no component."""
    sets, parent = sets_of(rows), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), d if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def run(spark, rows):
    got = jaccard.similar_documents(docs(spark, rows)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def near_copies(seed, length, n):
    """Chains of copies of copies, each with some words changed."""
    rng = random.Random(seed)
    rows, texts = [], [prose(rng, length, 5_000).split()]
    for i in range(n):
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(max(2, length // 60))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(words)
        rows.append((i * 7 % 1009, " ".join(words)))
    return rows


def test_equals_brute_force(spark):
    assert run(spark, corpus()) == brute(corpus())


def test_light_and_heavy_sets_meet(spark):
    rows = []
    for k, length in enumerate((6, 9, 12, 15, 18, 21, 24, 30, 150)):
        rows += [(10_000 * k + d, t) for d, t in near_copies(k, length, 40)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [1, 8, 14, 21])
def test_any_boundary_gives_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, mean: limit)
    rows = []
    for k, length in enumerate((9, 12, 16, 17, 20, 24)):
        rows += [(10_000 * k + d, t) for d, t in near_copies(k + 50, length, 25)]
    assert run(spark, rows) == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2_000)
    rows = near_copies(3, 120, 150) + [(5_000 + i, rows_text) for i, (_, rows_text) in enumerate(near_copies(4, 90, 60))]
    assert run(spark, rows) == brute(rows)


def test_groups_of_several_kinds_in_blocks(spark, monkeypatch):
    """Crowds linked to their smallest set, outsiders that only others link, and a shared passage that links nothing."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rng = random.Random(5)
    chain = [prose(rng, 100, 9_000)]
    for _ in range(25):  # every text is near the one before, few are near the first
        w = chain[-1].split()
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        chain.append(" ".join(w))
    rows = list(enumerate(chain)) + [(1_000 + i, t) for i, t in enumerate(chain[3:9])]
    rows += [(2_000 + d, t) for d, t in near_copies(8, 100, 60)]
    rows += [(3_000 + i, f"{prose(rng, 20, 9_000)} {chain[0]}") for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_blocks_leave_out_pairs_within_the_core(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1_000)
    rows = [(0, 1, i, 10, i >= 150) for i in range(2_000)] + [(1, 1, i, 10, True) for i in range(50)]
    members = spark.createDataFrame(rows, "pivot bigint, class bigint, node bigint, n bigint, core boolean")
    got = jaccard.in_blocks(members, F.col("n")).collect()
    together = {}
    for r in got:
        assert r.pivot == 0 and r.block in (r.x, r.y)
        together.setdefault((r.x, r.y), []).append(r)
    pairs = set()
    for (x, y), group in together.items():
        left, right = ([r for r in group if r.block == b] for b in (x, y))
        assert not any(r.core for r in left)
        pairs |= {tuple(sorted((a.node, b.node))) for a in left for b in right}
    assert {(i, j) for i in range(150) for j in range(i, 2_000)} <= pairs
    # Two outer blocks: every core member twice, whatever the size of the core.
    assert len([r for r in got if r.core]) == 2 * 1_850


def test_frequent_passage(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE_HITS", 2)
    rng = random.Random(9)
    passage = prose(rng, 60, 3_000)
    rows = [(i, f"{prose(rng, rng.randrange(5, 60), 3_000)} {passage}") for i in range(120)]
    assert run(spark, rows) == brute(rows)


def brute_components(rows, size, percent):
    """Components of (doc_id, text) rows, all with an id and words."""
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    label = {d: d for d, _ in rows}
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((label[rows[i][0]], label[rows[j][0]]))
                label = {d: x if c == y else c for d, c in label.items()}
    return label


@pytest.mark.parametrize("size, percent", [(5, 80), (3, 70)])
def test_other_shingles_and_similarities(spark, size, percent):
    rows = []
    for k, length in enumerate((6, 9, 12, 15, 18, 22, 24, 28, 60, 150)):
        rows += [(10_000 * k + d, t) for d, t in near_copies(k + 20, length, 25)]
    got = jaccard.similar_documents(docs(spark, rows), shingle_words=size, percent=percent).collect()
    want = brute_components(rows, size, percent)
    assert {r.doc_id: r.component_id for r in got} == want != brute_components(rows, 4, 85)


def test_repeated_ids_tie_their_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, ""), (6, c), (9, d), (9, d), (10, ""), (2, None), (7, " ")]
    assert run(spark, rows) == brute(rows)
    assert {(i, c) for i, _, c in run(spark, rows)} == {(3, 3), (5, 3), (7, 3), (8, 6), (6, 6), (9, 9), (10, 10), (2, 2)}


def test_needed_and_prefix():
    for a in range(1, 60):
        for b in range(a, 60):
            linked = [o for o in range(a + 1) if 100 * o >= 85 * (a + b - o)]
            assert (b in jaccard.partners(a)) == bool(linked)
            if linked:
                assert jaccard.needed(a, b) == linked[0]
                assert jaccard.prefix_length(a) >= a - linked[0] + 1


def test_overlaps():
    rng = np.random.default_rng(1)
    arrays = [np.unique(rng.integers(0, 50, rng.integers(0, 30))) for _ in range(20)]
    for i, common in enumerate(jaccard._overlaps(arrays)):
        assert common.tolist() == [len(np.intersect1d(arrays[i], a)) for a in arrays]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges += [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 8)]
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got.get(x, x) == c for x, c in want.items())


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """Rounds over few edges shuffle for their aggregates only and store few files; many edges give the same."""
    tables = []
    monkeypatch.setattr(hubs, "cut", lambda df, name: tables.append(cut(df, name)) or tables[-1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 40), (40, 60)], "u bigint, v bigint")
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    context = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup("few edges", "components")
        few = components(edges)
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few edges") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
        context.setJobGroup("many edges", "components")
        assert 0 < tasks / len(tables) < 4.5 * 60
        assert all(len(t.inputFiles()) <= context.defaultParallelism for t in tables[1:])
        monkeypatch.setattr(hubs, "FEW_EDGES", 0)
        many = components(edges)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context._jsc.clearJobGroup()
    want = [(i, 0) for i in range(1, 13)] + [(50, 40), (60, 40)]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want


def test_many_links_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(hubs, "FEW_EDGES", 0)
    monkeypatch.setattr(jaccard, "FEW_EDGES", 0)
    assert run(spark, corpus()) == brute(corpus())


def test_empty_table_and_filter(spark):
    assert jaccard.similar_documents(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e"), (2, "A B C D E"), (3, None), (4, ""), (None, "a b c d e"), (5, "x"), (6, "x")]
    kept = jaccard.keep_smallest(docs(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    assert "score" in kept.columns
