import math
import re
import zlib

import pytest
import regex
from llm_data import SMALL, docs
from pyspark.sql import functions as F

from review_trust.llm import quality

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_held_out_accuracy(spark):
    scored = quality.score_documents(read(spark, "documents"), read(spark, "labels")).toPandas()
    truth = read(spark, "labels").toPandas().set_index("doc_id").quality
    assert len(scored) == 1000 and scored.score.between(0, 1).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]).all()
    test = scored[scored.held_out & scored.doc_id.isin(truth.index)]
    assert (test.predicted == truth[test.doc_id].to_numpy()).mean() > 0.97
    good = test[truth[test.doc_id].to_numpy() == 1]
    assert good.predicted.mean() > 0.98


def plain_statistics(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    n = len(text)

    def share(pattern):
        return len(regex.findall(pattern, text)) / n if n else 0.0

    return {
        "log_chars": math.log1p(n),
        "word_chars": n / len(words) if words else 0.0,
        "distinct_words": len(set(words)) / len(words) if words else 0.0,
        "line_words": len(words) / (text.count("\n") + 1),
        "upper": share("[A-Z]"),
        "digits": share("[0-9]"),
        "stops": share("[.,;:]"),
        "symbols": share(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:'-]"),
    }


def test_scores_equal_a_plain_replay_of_the_rules(spark, monkeypatch):
    """Every whole text, and awkward ones, scored by the fitted rules one by one."""
    models, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    rows = [(-i - 1, t) for i, t in enumerate([*SMALL, "x" * 100_000, "!? " * 5_000])]
    table = read(spark, "documents").select("doc_id", "text").unionByName(docs(spark, rows).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in table.collect()}
    got = quality.score_documents(table, read(spark, "labels")).collect()
    assert len(got) == len(texts) and len(models[0].weights) > 3
    for r in got:
        values, total = plain_statistics(texts[r.doc_id]), models[0].intercept
        for rule, weight in models[0].weights:
            if all(values[name] <= x if sign == "<=" else values[name] > x for name, sign, x in rule.bounds):
                total += weight
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), r.doc_id
        assert r.predicted == (r.score >= 0.7)


def test_held_out_labels_are_never_seen(spark):
    labels = read(spark, "labels")
    flipped = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = (
        {r.doc_id: r.score for r in quality.score_documents(read(spark, "documents"), x).collect()}
        for x in (labels, flipped)
    )
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_paths_are_conjunctions():
    tree = "\n".join(
        [
            "DecisionTreeClassificationModel: uid=x, depth=2",
            "  If (feature 0 <= 1.5)",
            "   If (feature 1 > -2.0E-3)",
            "    Predict: 1.0",
            "   Else (feature 1 <= -2.0E-3)",
            "    Predict: 0.0",
            "  Else (feature 0 > 1.5)",
            "   Predict: 0.0",
        ]
    )
    a, b, not_a, not_b = ("x", "<=", 1.5), ("y", ">", -0.002), ("x", ">", 1.5), ("y", "<=", -0.002)
    assert [r.bounds for r in quality.paths(tree, ["x", "y"])] == [(a,), (a, b), (a, not_b), (not_a,)]


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate(SMALL)] + [(0, None), (None, "x" * 100_000), (None, None)]
    labels = spark.createDataFrame(
        [(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (4, 0), (4, 0)], "doc_id bigint, quality int"
    )
    scored = quality.score_documents(docs(spark, rows), labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_documents(docs(spark, []), labels).count() == 0
    unlabelled = quality.score_documents(docs(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_filter_keeps_columns_and_good_documents(spark):
    kept = quality.keep_good(read(spark, "documents"), read(spark, "labels"))
    assert kept.columns == read(spark, "documents").columns
    truth = read(spark, "labels").toPandas().set_index("doc_id").quality
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = set(truth[truth == 1].index)
    assert len(good & ids) / len(good) > 0.98 and len((set(truth.index) - good) & ids) <= 3
