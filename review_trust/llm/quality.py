"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the labelled documents; every path from a root to a node becomes a rule, a conjunction of
bounds on statistics. A lasso logistic regression weights the rules and leaves few of them. The rules that stay are
compiled into one column expression, so scoring needs neither a model object nor Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import leave_out, let, text_key
from review_trust.sources.artifacts import cut

# Documents the rules are fitted on at most; beyond that a sample by hash of about this size.
FIT_ROWS = 200_000
TREES = 12
DEPTH = 3
LASSO = 0.0005
SEED = 7
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Text statistics by name; zero where there is nothing to measure. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)

    def share(pattern: str) -> Column:
        return F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(0.0)

    counts = let(
        F.array_remove(F.split(text, r"\s+"), ""),
        lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")),
    )
    words, distinct = counts["words"], counts["distinct"]
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_chars": F.when(words > 0, n / words).otherwise(0.0),
        "distinct_words": F.when(words > 0, distinct / words).otherwise(0.0),
        "line_words": words / lines,
        "upper": share(r"[A-Z]"),
        "digits": share(r"[0-9]"),
        "stops": share(r"[.,;:]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'-]"),
    }


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, "<=" or ">", value) that must all hold."""

    bounds: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        test = F.lit(True)
        for name, sign, value in self.bounds:
            test = test & ((F.col(name) <= value) if sign == "<=" else (F.col(name) > value))
        return test


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 from columns that hold the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def paths(tree: str, names: list[str]) -> list[Rule]:
    """Every path from the root to a node below it, from the indented text form of a tree."""
    found, open_bounds = [], []
    for line in tree.splitlines():
        split = re.match(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if split:
            depth = len(split[1])
            open_bounds = [b for b in open_bounds if b[0] < depth]
            open_bounds.append((depth, (names[int(split[2])], split[3], float(split[4]))))
            found.append(Rule(tuple(b for _, b in open_bounds)))
    return found


def fit(train: DataFrame, names: list[str]) -> RuleModel:
    """Fit rules on ``train`` (the statistics and ``quality``, 0 or 1).

    Without labelled rows every score is one half; with one label only, it is near that label.
    """
    counts = {r.quality: r["count"] for r in train.groupBy("quality").count().collect()}
    n, ones = sum(counts.values()), counts.get(1, 0)
    if len(counts) < 2:
        odds = (ones + 1) / (n - ones + 1)
        return RuleModel(math.log(odds), ())
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(train)
    forest = RandomForestClassifier(
        labelCol="quality", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=SEED
    ).fit(rows)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree.toDebugString, names)))
    if not rules:
        return RuleModel(math.log(ones / (n - ones)), ())
    fired = F.array(*[F.when(r.column(), 1.0).otherwise(0.0) for r in rules])
    lasso = LogisticRegression(
        labelCol="quality", featuresCol="fired", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60
    ).fit(train.select("quality", array_to_vector(fired).alias("fired")))
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(lasso.intercept, tuple((r, w) for r, w in zip(rules, weights) if w))


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, which no fit may see; a null id is in no part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, doc, held_out, score, predicted.

    ``labels`` has doc_id and quality; labels that are null, belong to held-out ids or contradict each other are not
    learnt from. Null and empty texts are scored on statistics of zero. Repeated rows each get a row; ``doc`` is a hash
    of the text that tells rows apart that share a doc_id.
    """
    stats = statistics(F.col("text"))
    names = list(stats)
    kept = docs.select("doc_id", text_key(F.col("text")).alias("doc"), *[c.alias(n) for n, c in stats.items()])
    # The texts are read once; fitting and scoring use the stored statistics.
    kept = cut(kept, "statistics")
    known = (
        labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_max"))
        .filter("quality = _max")
        .select("doc_id", F.col("quality").cast("int"))
    )
    train = cut(kept.join(known, "doc_id").select("doc_id", "quality", *names), "labelled")
    n = train.count()
    if n > FIT_ROWS:
        share = int(FIT_ROWS / n * 1_000_000)
        train = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    score = fit(train.select("quality", *names), names).score()
    scored = kept.select("doc_id", "doc", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted to be of low quality, with all their columns."""
    scored = score_documents(docs, labels)
    bad = scored.filter("predicted = 0").select("doc_id", "doc").distinct()
    return leave_out(docs, cut(bad, "low-quality"))
