import hashlib
import random

from llm_data import corpus, docs, prose, word_list

from review_trust.llm import winnow


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = word_list(text)
        n = min(10, len(w))
        if item is not None and n:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = set()
    for doc_id, text in rows:
        w, hit, found = word_list(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                for_items = windows.get(tuple(w[i : i + n]))
                if for_items:
                    hit |= set(range(i, i + n))
                    found |= for_items
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.add((doc_id, text, len(w), len(hit), len(found), names, bool(hit)))
    return sorted((r[:1] + r[2:] for r in out), key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, h string") if rows else spark.createDataFrame(
        [], "item_id bigint, text string, h string"
    )


def planted(seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    bench = [(i, prose(rng, rng.choice((10, 11, 25, 60)), 5_000)) for i in range(30)]
    bench += [(100, prose(rng, 4)), (101, "w1 W2"), (102, ""), (103, None), (None, prose(rng, 20)), (5, bench[6][1])]
    bench += [(104, "same " * 30), (105, "w5"), (3, bench[3][1])]
    for i in range(25):
        w = word_list(bench[i][1])
        start = rng.randrange(max(1, len(w) - 12))
        span = " ".join(w[start : start + rng.choice((8, 9, 10, 11, 30))])
        rows.append((5_000 + i, f"{prose(rng, rng.randrange(12))} {span.upper()}, {prose(rng, rng.randrange(12))}"))
    rows.append((6_000, "same " * 45))
    rows.append((6_001, bench[0][1] + " " + bench[1][1]))
    return rows, bench


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows, bench = planted(seed)
        table = items(spark, [(*b, "x") for b in bench])
        got = [tuple(r) for r in winnow.digests(docs(spark, rows), table).collect()]
        assert sorted(got, key=str) == brute(rows, bench)


def test_ties_are_found(spark):
    rows = [(1, "a b " * 40), (2, "b a " * 6), (3, "a a a a a a a a a a")]
    bench = [(1, "a b " * 5 + "c"), (2, "a " * 11)]
    got = [tuple(r) for r in winnow.digests(docs(spark, rows), items(spark, [(*b, "x") for b in bench])).collect()]
    assert sorted(got, key=str) == brute(rows, bench)


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    rows, bench = planted(3)
    table = items(spark, [(*b, "x") for b in bench])
    monkeypatch.setattr(winnow, "broadcast_if_small", lambda df, limit=0: df)
    got = [tuple(r) for r in winnow.digests(docs(spark, rows), table).collect()]
    assert sorted(got, key=str) == brute(rows, bench)


def test_empty_tables(spark):
    rows, bench = planted(1)
    table = items(spark, [(*b, "x") for b in bench])
    assert winnow.digests(docs(spark, []), table).count() == 0
    clean = winnow.digests(docs(spark, rows[:10]), items(spark, [])).collect()
    assert len(clean) == 10 and not any(r.contaminated for r in clean)


def test_filter_drops_exactly_the_contaminated(spark):
    rows, bench = planted(4)
    bench = [b for b in bench if b[1] is None or len(word_list(b[1])) >= 10]
    kept = winnow.decontaminate(docs(spark, rows), items(spark, [(*b, "x") for b in bench]))
    dirty = {r[0] for r in brute(rows, bench) if r[-1]}
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(d) for d, _ in rows if d not in dirty)
