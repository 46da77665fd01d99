import hashlib
import random
from collections import defaultdict

from llm_data import corpus, docs, lower

from review_trust.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    def key(line):
        return lower(line.strip(BLANKS))

    holders = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    repeated = {k: max([rows[i][0] for i in v if rows[i][0] is not None], default=None) for k, v in holders.items()}
    repeated = {k: m for k, m in repeated.items() if len(k) >= 40 and len(holders[k]) >= 5 and m is not None}
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if key(x) not in repeated or doc_id == repeated[key(x)]]
        out.append((doc_id, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def repeated_lines(seed, n):
    rng = random.Random(seed)
    pool = [f"{'Line' * 9} number {i} é" for i in range(12)] + ["é" * 39, "é" * 40, "x" * 39, "Y" * 40, "", "short"]
    rows = []
    for i in range(n):
        picked = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str, str.lower])(rng.choice(pool)) for _ in range(rng.randrange(8))]
        rows.append((rng.randrange(1000), "\n".join(picked) + rng.choice(["", "\n", "\r"])))
    return rows


def test_equals_brute_force(spark):
    for rows in (repeated_lines(1, 120), repeated_lines(2, 40) + [(None, "x" * 40), (None, None), (5, "")], corpus()):
        got = [tuple(r) for r in lines.digests(docs(spark, rows)).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_hot_line_and_many_batches(spark):
    rows = [(i, f"{'common line ' * 5}\nown line of document {i} that is long enough") for i in range(300)]
    kept = lines.dedup_lines(docs(spark, rows).select("doc_id", "text"), batches=7)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[299] == rows[299][1]
    assert all(texts[i] == rows[i][1].split("\n")[1] for i in range(299))


def test_empty_table_and_columns(spark):
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    kept = lines.dedup_lines(docs(spark, [(1, "a")]))
    assert kept.columns[:2] == ["doc_id", "text"] and kept.first().n_lines == 1 and kept.first().score == 0.5


def test_runs_are_dropped(spark):
    lines.dedup_lines(docs(spark, repeated_lines(3, 30))).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_documents_count_once_however_many_rows_they_have(spark):
    line = "a line that is certainly long enough to count"
    got = lines.digests(docs(spark, [(9, line)] * 4 + [(3, line)])).collect()
    assert all(r.n_dropped == 0 for r in got)
    got = lines.digests(docs(spark, [(i, line) for i in (9, 9, 9, 3, 4, 5, 6)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(3, 1), (4, 1), (5, 1), (6, 1), (9, 0), (9, 0), (9, 0)]
