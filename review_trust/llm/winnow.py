"""Benchmark decontamination by winnowing, in DataFrame operations only.

A passage of ``window`` words that a document shares with an item holds ``window - gram + 1`` word grams, the same on
both sides, so both select the same (rightmost) smallest gram hash of that passage as a fingerprint. Joining the
fingerprints therefore finds every shared passage; a hit is extended word by word to its neighbours, and counts if the
run of equal words reaches the window. Extending by ``window - gram`` words to each side covers every window that holds
the gram. Items shorter than a window are joined on the hash of all their words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import broadcast_if_small, leave_out, let, positions, text_key, words
from review_trust.sources.artifacts import cut

WINDOW = 10
GRAM = 5


def _run_length(tests: list[Column]) -> Column:
    """How many tests hold before the first one that doesn't (null counts as failing)."""
    length = F.lit(len(tests))
    for i, test in reversed(list(enumerate(tests))):
        length = F.when(test, length).otherwise(i)
    return length


def fingerprints(tokens: Column, window: int, gram: int) -> Column:
    """The selected grams of an array of words: their place p from 0, hash h, the words before and from p on.

    The gram at p is selected if it is the rightmost smallest of some window of consecutive grams: as many neighbours
    as a window has besides it must be larger, those on its left larger or equal. Each element holds only the words
    that a window around it can reach, so no row carries the whole text along.
    """
    span = window - gram

    def selected(h: Column) -> Callable[[Column], Column]:
        def test(p: Column) -> Column:
            left = _run_length([F.get(h, p - i) >= F.get(h, p) for i in range(1, span + 1)])
            right = _run_length([F.get(h, p + i) > F.get(h, p) for i in range(1, span + 1)])
            return left + right >= span

        return test

    def element(w: Column, h: Column) -> Callable[[Column], Column]:
        return lambda p: F.struct(
            p.alias("p"),
            F.get(h, p).alias("h"),
            F.slice(w, F.greatest(p - span, F.lit(0)) + 1, F.least(p, F.lit(span))).alias("before"),
            F.slice(w, p + 1, F.lit(window)).alias("from"),
        )

    def grams(hashes: Column) -> Column:
        return F.transform(
            positions(F.size(hashes) - gram + 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(gram)])
        )

    def pick(w: Column, h: Column) -> Column:
        return F.transform(F.filter(positions(F.size(h)), selected(h)), element(w, h))

    return let(tokens, lambda w: let(let(F.transform(w, lambda x: F.xxhash64(x)), grams), lambda h: pick(w, h)))


def _long_hits(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of at least ``window`` equal words around a shared fingerprint: doc_id, doc, item_id, start, length."""
    test = items.select("item_id", F.inline(fingerprints(F.col("words"), window, gram)))
    test = test.select("item_id", "h", F.col("before").alias("item_before"), F.col("from").alias("item_from"))
    test = broadcast_if_small(cut(test, "item-fingerprints"), 100_000)  # a few hundred bytes a row
    train = docs.select("doc_id", "doc", F.inline_outer(fingerprints(F.col("words"), window, gram)))
    joined = train.join(test, "h")
    left = _run_length(
        [
            F.try_element_at("before", F.lit(-i)) == F.try_element_at("item_before", F.lit(-i))
            for i in range(1, window - gram + 1)
        ]
    )
    right = _run_length([F.get("from", F.lit(i)) == F.get("item_from", F.lit(i)) for i in range(window)])
    start = (F.col("p") - left).alias("start")
    runs = joined.select("doc_id", "doc", "item_id", start, left.alias("l"), right.alias("r"))
    # The gram itself must be equal, not only its hash.
    runs = runs.filter((F.col("r") >= gram) & (F.col("l") + F.col("r") >= window))
    return runs.select("doc_id", "doc", "item_id", "start", (F.col("l") + F.col("r")).alias("length"))


def _short_hits(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """Places where all ``length`` words of a short item stand."""
    whole = items.select("item_id", "words", F.xxhash64("words").alias("h")).withColumnRenamed("words", "item_words")
    whole = broadcast_if_small(cut(whole, "short-items"), 100_000)
    grams = let(
        F.col("words"),
        lambda w: F.transform(positions(F.size(w) - length + 1), lambda p: F.slice(w, p + 1, F.lit(length))),
    )
    placed = docs.select("doc_id", "doc", F.posexplode_outer(grams).alias("start", "here"))
    hits = placed.withColumn("h", F.xxhash64("here")).join(whole, "h").filter(F.col("here") == F.col("item_words"))
    return hits.select("doc_id", "doc", "item_id", "start", F.lit(length).alias("length"))


def shared_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Spans of words that documents share with items: doc_id, doc, item_id, start, length (in words, from 0).

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text. ``doc`` is a hash of the text, for documents that
    share a doc_id. Spans of one pair may overlap. Null and empty texts have no words and so no spans; items without an
    id are left out; repeated items count once; repeated documents give their spans once each.
    """
    docs = docs.select("doc_id", text_key(F.col("text")).alias("doc"), words(F.col("text")).alias("words"))
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("words")).distinct()
    items = cut(items, "items")
    lengths = items.groupBy(F.least(F.size("words"), F.lit(window)).alias("n")).count().collect()
    found = []
    for n in sorted(r.n for r in lengths):  # at most ``window`` lengths
        if n >= window:
            found.append(_long_hits(docs, items.filter(F.size("words") >= window), window, gram))
        elif n:
            found.append(_short_hits(docs, items.filter(F.size("words") == n), n))
    if not found:
        return docs.sparkSession.createDataFrame(
            [],
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc bigint, "
            f"item_id {items.schema['item_id'].dataType.simpleString()}, start int, length int",
        )
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, doc, n_words, n_hit (words inside shared spans), items (sorted ids as strings).

    Rows that repeat both doc_id and text are one document; rows that share only the doc_id are told apart by ``doc``,
    a hash of the text. Null texts have no words. See ``shared_spans`` for the other cases.
    """
    spans = shared_spans(docs, benchmark, window, gram)
    n_words = F.size(words(F.col("text"))).cast("long")
    none = F.lit(None)
    all_docs = docs.select("doc_id", text_key(F.col("text")).alias("doc"), n_words.alias("n_words"))
    hits = spans.withColumn("item_id", F.col("item_id").cast("string")).withColumn("n_words", none.cast("long"))
    empty = {"item_id": "string", "start": "int", "length": "int"}
    rows = all_docs.withColumns({c: none.cast(kind) for c, kind in empty.items()}).unionByName(hits)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "length"))
    per_doc = rows.groupBy("doc_id", "doc").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(span).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    inside = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    n_hit = F.size(F.array_distinct(F.flatten(inside))).cast("long")
    return per_doc.select("doc_id", "doc", "n_words", n_hit.alias("n_hit"), "items")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the counts, a digest of the items and whether any word is hit."""
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that share a span with the benchmark; all their columns and repeated rows stay."""
    hit = shared_spans(docs, benchmark).select("doc_id", "doc").distinct()
    return leave_out(docs, cut(hit, "contaminated"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw) JOIN lens ON p + n - 1 <= len(w)
), hits AS (SELECT doc_id, p, grams.n AS n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
