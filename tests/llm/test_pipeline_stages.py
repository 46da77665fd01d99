import hashlib

import corpus_pipeline
import pytest
from llm_data import corpus, docs, word_list
from pyspark.sql import functions as F

from review_trust.llm import jaccard

SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """The columns of documents, and some more whose names the operators use."""
    table = docs(spark, rows).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    return table.withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_awkward_rows_keep_their_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    source = documents(spark, corpus())
    kept = stage(spark, source, SF)
    assert kept.columns == source.columns
    assert 0 < kept.count() <= source.count()
    empty = stage(spark, documents(spark, []), SF)
    assert empty.columns == source.columns and empty.count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_pass_through(spark, name):
    names = ("_id", "_doc", "_drop", "_lines", "_row", "row", "own_doc_id", "meta.url", "N_Lines", "n_dropped", "a`b", "h")
    source = documents(spark, corpus()).drop("h", "n_lines")
    source = source.select(*[F.lit(n).alias(n) for n in names], *source.columns)
    kept = dict(corpus_pipeline.STAGES)[name](spark, source, SF)
    assert kept.columns == source.columns and kept.schema.simpleString() == source.schema.simpleString()
    rows = kept.collect()
    assert rows and all(tuple(r[: len(names)]) == names for r in rows)


def test_last_stage(spark):
    rows = corpus()
    got = corpus_pipeline.byte_bpe(spark, documents(spark, rows), SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() == len(rows)
    assert corpus_pipeline.byte_bpe(spark, documents(spark, []), SF).count() == 0


def test_line_stage_takes_lines_out_and_counts_anew(spark):
    line = "this line is long enough to be a repeated one"
    rows = [(i, f"{line}\nown {i}") for i in range(6)]
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), SF).collect()}
    assert [got[i].text for i in range(6)] == [f"own {i}" for i in range(5)] + [rows[5][1]]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_duplicates_and_leaks_go_and_clean_documents_stay(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect())
    words = [[hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(100)] for i in range(6)]
    clean = [f"clean text number {i} {' '.join(w)}" for i, w in enumerate(words)]
    near = clean[0].split()
    near[20] = "other"
    leak = f"{clean[2][:300]} {item} {clean[3][:200]}"
    rows = [*enumerate(clean), (10, clean[1]), (11, " ".join(near)), (12, leak)]
    assert len(word_list(item)) >= 10
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 12]
    kept = corpus_pipeline.decontamination(spark, documents(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 10, 11]


def test_near_copies_between_the_two_settings_go(spark):
    def similarity(a, b, size):
        a, b = ({tuple(t[i : i + size]) for i in range(len(t) - size + 1)} for t in (a, b))
        return len(a & b) / len(a | b)

    rows = []
    for i, (length, changed) in enumerate(((50, 1), (58, 2), (75, 3), (400, 35))):
        words = [hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(length)]
        copy = [*words[:20], *[f"new{j}" for j in range(changed)], *words[20 + changed :]]
        assert similarity(words, copy, 5) >= 0.8 and similarity(words, copy, 4) < 0.85
        rows += [(i, " ".join(words)), (100 + i, " ".join(copy))]
    words = [hashlib.md5(f"far {j}".encode()).hexdigest() for j in range(40)]
    rows += [(50, " ".join(words)), (150, " ".join([*words[:20], "new", *words[21:]]))]
    assert similarity(words, rows[-1][1].split(), 5) < 0.8
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 50, 150]
    kept = jaccard.keep_smallest(documents(spark, rows), shingle_words=4, percent=85)
    assert kept.count() == len(rows)


def test_run_is_the_stages_one_after_the_other(spark):
    rows = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
    assert {r.doc_id: r.n_tokens for r in table.collect()} == rows
