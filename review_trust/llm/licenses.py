"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word gram of a document is looked up among the grams of the templates. A match at document word p and
template word t votes for the diagonal p - t. Votes are counted by document, template and diagonal; neighbouring
diagonals of one template are merged, so a few inserted or missing words do not break a span; the grams of a merged span
are verified by their words and measured against the template. A notice counts only if the words that decide between it
and its neighbours (a version, "lesser") are in the span, and no word beside the span denies it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from review_trust.llm.common import BROADCAST_ROWS, let, positions, text_key, words

# Phrases of the base scan and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


class Notice(NamedTuple):
    """A license text. Every phrase of ``deciding`` (at most GRAM words) must be found in a span, and none of the words
    of ``unless`` may follow it."""

    label: str
    text: str
    deciding: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


# Public license notices by name, with the label they give.
NOTICES = {
    "mit": Notice("mit", "released under the mit license", ("mit license",)),
    "mit-text": Notice(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software",
    ),
    "apache-1.1": Notice(
        "apache-1.1", "Licensed under the Apache License, Version 1.1", ("apache license", "version 1 1")
    ),
    "apache-2.0": Notice(
        "apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")
    ),
    "gpl-2.0": Notice(
        "gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public", "license version 2")
    ),
    "gpl-3.0": Notice(
        "gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public", "license version 3")
    ),
    "lgpl-2.1": Notice(
        "lgpl-2.1",
        "licensed under the GNU Lesser General Public License, version 2.1",
        ("gnu lesser general", "version 2 1"),
    ),
    "lgpl-3.0": Notice(
        "lgpl-3.0",
        "licensed under the GNU Lesser General Public License, version 3",
        ("gnu lesser general", "license version 3"),
    ),
    "agpl-3.0": Notice(
        "agpl-3.0",
        "licensed under the GNU Affero General Public License, version 3",
        ("gnu affero general", "license version 3"),
    ),
    "gpl-text": Notice(
        "gpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        ("gnu general public",),
    ),
    "lgpl-text": Notice(
        "lgpl-text",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
        ("gnu lesser general",),
    ),
    "agpl-text": Notice(
        "agpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation",
        ("gnu affero general",),
    ),
    "mpl-2.0": Notice(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license", "v 2 0"),
    ),
    "epl-2.0": Notice(
        "epl-2.0",
        "made available under the terms of the Eclipse Public License 2.0",
        ("eclipse public license", "license 2 0"),
    ),
    "bsl-1.0": Notice(
        "bsl-1.0",
        "Distributed under the Boost Software License, Version 1.0",
        ("boost software license", "version 1 0"),
    ),
    "ofl-1.1": Notice(
        "ofl-1.1",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1",
        ("open font license", "version 1 1"),
    ),
    "bsd": Notice(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "bsd-3": Notice(
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ),
    "isc": Notice(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("or without fee",),
    ),
    "zlib": Notice(
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely",
        ("redistribute it freely",),
    ),
    "unlicense": Notice("unlicense", "This is free and unencumbered software released into the public domain"),
    "cc0": Notice("cc0-1.0", "CC0 1.0 Universal", ("cc0 1 0",)),
    "cc-by-sa": Notice("cc-by-sa", "CC BY-SA"),
    "cc-by-nd": Notice("cc-by-nd", "CC BY-ND"),
    "cc-by-nc": Notice("cc-by-nc", "CC BY-NC", unless=("nd", "sa")),
    "cc-by-nc-nd": Notice("cc-by-nc-nd", "CC BY-NC-ND", ("cc by nc", "by nc nd")),
    "cc-by-nc-sa": Notice("cc-by-nc-sa", "CC BY-NC-SA", ("cc by nc", "by nc sa")),
    "cc-by-nc name": Notice(
        "cc-by-nc",
        "Creative Commons Attribution-NonCommercial",
        ("attribution noncommercial",),
        ("noderivatives", "noderivs", "sharealike"),
    ),
    "cc-by-sa name": Notice("cc-by-sa", "Creative Commons Attribution-ShareAlike", ("attribution sharealike",)),
    "cc-by-nd name": Notice("cc-by-nd", "Creative Commons Attribution-NoDerivatives", ("attribution noderivatives",)),
}
# A notice is denied by one of these words right before it ("t" is what is left of n't, "longer" of no longer).
DENIALS = ("longer", "never", "not", "t")
GRAM = 3
# Diagonals this close belong to one span; a notice counts if this share of its grams is found in the span.
NEIGHBOURS = 2
COVERAGE = 0.6


def tokens(text: str) -> list[str]:
    """The words of a template (ASCII)."""
    return re.findall(r"[0-9a-z]+", text.lower())


class Template(NamedTuple):
    """A phrase or notice with its words; ``must`` has the grams that hold each deciding phrase."""

    label: str
    base: bool
    words: list[str]
    k: int
    must: list[list[int]]
    unless: list[str]

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


def templates(phrases: dict[str, str], notices: dict[str, Notice]) -> list[Template]:
    """All templates; one shorter than a gram is one gram of its own length."""
    out = []
    given = [(Notice(label, text), True) for text, label in phrases.items()]
    for notice, base in given + [(notice, False) for notice in notices.values()]:
        w = tokens(notice.text)
        k = min(GRAM, len(w))
        must = []
        for phrase in map(tokens, notice.deciding):
            inside = range(k - len(phrase) + 1)
            must.append([t for t in range(len(w) - k + 1) if any(w[t + i : t + i + len(phrase)] == phrase for i in inside)])
            if not must[-1]:
                raise ValueError(f"no gram of {notice.text!r} holds {' '.join(phrase)!r}")
        out.append(Template(notice.label, base, w, k, must, list(notice.unless)))
    return out


def template_grams(spark: SparkSession, given: list[Template]) -> DataFrame:
    """One row per distinct gram: k, h, its words, and the (id, label, base, t, grams of the template) where it stands."""
    rows = [
        (x.k, x.words[t : t + x.k], i, x.label, x.base, t, x.grams) for i, x in enumerate(given) for t in range(x.grams)
    ]
    grams = spark.createDataFrame(rows, "k int, gram array<string>, id int, label string, base boolean, t int, n int")
    place = F.struct("id", "label", "base", "t", "n")
    return grams.groupBy("k", "gram").agg(F.collect_list(place).alias("places")).withColumn("h", F.xxhash64("gram"))


def votes(docs: DataFrame, given: list[Template]) -> DataFrame:
    """One row per document without a gram and per matched gram: doc_id, doc, n_words, p, the word before it, the place
    of p's end with the word after it, and where in a template it stands (null if none)."""
    lengths = sorted({x.k for x in given})
    grams = template_grams(docs.sparkSession, given)
    # The templates are a list of the caller's, counted here; a list beyond the bound is joined by a shuffle.
    small = sum(x.grams for x in given) <= BROADCAST_ROWS
    widest = max([1, *lengths])
    grams_of = let(
        F.col("words"),
        lambda w: let(
            F.concat(F.array(F.lit("")), w),
            lambda padded: F.transform(
                positions(F.size(w)),
                lambda p: F.struct(
                    p.alias("p"), F.slice(padded, p + 1, F.lit(widest + 2)).alias("here"), F.size(w).alias("n_words")
                ),
            ),
        ),
    )
    # A select of its own: the key must not be computed again for every gram.
    split = docs.select("doc_id", text_key(F.col("text")).alias("doc"), words(F.col("text")).alias("words"))
    rows = split.select("doc_id", "doc", F.inline_outer(grams_of))
    found = [F.array().cast("array<struct<place:struct<id:int,label:string,base:boolean,t:int,n:int>,end:int,after:string>>")]
    for k in lengths:
        here = F.slice("here", F.lit(2), F.lit(k))  # the first word of "here" is the one before
        side = grams.filter(F.col("k") == k).select(
            F.col("h").alias(f"h{k}"), F.col("gram").alias(f"gram{k}"), F.col("places").alias(f"places{k}")
        )
        rows = rows.join(F.broadcast(side) if small else side, F.xxhash64(here) == F.col(f"h{k}"), "left")
        after = F.coalesce(F.get("here", F.lit(k + 1)), F.lit(""))
        ends = F.transform(
            f"places{k}", lambda x: F.struct(x.alias("place"), (F.col("p") + k).alias("end"), after.alias("after"))
        )
        found.append(F.when(F.col(f"gram{k}") == here, ends).otherwise(found[0]))
    first = F.coalesce(F.col("p"), F.lit(0)) == 0
    rows = rows.withColumn("found", F.concat(*found)).filter(first | (F.size("found") > 0))
    n_words = F.coalesce("n_words", F.lit(0)).alias("n_words")
    before = F.get("here", F.lit(0)).alias("before")
    return rows.select("doc_id", "doc", n_words, "p", before, F.explode_outer("found").alias("x")).select(
        "doc_id", "doc", "n_words", "p", "before", "x.*"
    )


def spans(matches: DataFrame) -> DataFrame:
    """Votes gathered by diagonal and merged with neighbouring diagonals.

    doc_id, doc, n_words, id, label, base, first (smallest document word, and the word before it), last (where the span
    ends, and the word after it), ts (grams of the template found) and coverage (their share). Base phrases are never
    merged: each diagonal that holds all their grams is a place. Documents without a match stay as one row with a null
    label.
    """
    same = ["doc_id", "doc", "n_words", "id", "label", "base"]
    diagonals = (
        matches.select("doc_id", "doc", "n_words", "p", "before", "end", "after", "place.*")
        .groupBy(*same, "n", (F.col("p") - F.col("t")).alias("diagonal"))
        .agg(
            F.collect_set("t").alias("ts"),
            F.min(F.struct("p", "before")).alias("first"),
            F.max(F.struct("end", "after")).alias("last"),
        )
    )
    template = Window.partitionBy("doc_id", "doc", "id").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(template) > NEIGHBOURS
    starts = F.when(F.col("base") | F.coalesce(far, F.lit(True)), 1).otherwise(0)
    grouped = diagonals.withColumn("span", F.sum(starts).over(template.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(*same, "span").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"),
        F.max("n").alias("n"),
    )
    return merged.withColumn("coverage", F.size("ts") / F.col("n"))


def judged(found: DataFrame, given: list[Template]) -> DataFrame:
    """Spans with decided (the share of deciding phrases found) and denied (by a word before or after)."""
    rows = [(i, x.must, x.unless) for i, x in enumerate(given) if not x.base]
    rules = found.sparkSession.createDataFrame(rows, "id int, must array<array<int>>, unless array<string>")
    rules = F.broadcast(rules) if len(rows) <= BROADCAST_ROWS else rules
    hits = F.size(F.filter("must", lambda m: F.arrays_overlap(m, F.col("ts"))))
    decided = F.when(F.size("must") > 0, hits / F.size("must")).otherwise(1.0)
    denied = F.col("first.before").isin(*DENIALS) | F.array_contains("unless", F.col("last.after"))
    return found.join(rules, "id", "left").select(
        *found.columns,
        F.coalesce(decided, F.lit(1.0)).alias("decided"),
        F.coalesce(denied & F.col("unless").isNotNull(), F.lit(False)).alias("denied"),
    )


def scan(
    docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, Notice] | None = None
) -> DataFrame:
    """Per document: doc_id, doc, n_words, places of the base phrases, first and last word, labels and a score.

    ``docs`` needs doc_id and text. A null text is empty and has no words. Rows that repeat both doc_id and text are one
    document; ``doc``, a hash of the text, tells rows apart that share only a (possibly null) doc_id. The score is the
    largest share of a template that was found times the share of its deciding phrases, 0 for a denied notice, 1 for a
    base phrase, 0 without any.
    """
    given = templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    return summary(judged(spans(votes(docs, given)), given))


def summary(found: DataFrame) -> DataFrame:
    """The judged spans of a document in one row."""
    base = F.col("base")
    place = base & (F.col("coverage") >= 1)
    notice = ~base & (F.col("coverage") >= COVERAGE) & (F.col("decided") >= 1) & ~F.col("denied")
    start = F.when(place, F.col("first.p"))
    worth = F.when(place | ~base, F.when(F.col("denied"), 0.0).otherwise(F.col("coverage") * F.col("decided")))
    return found.groupBy("doc_id", "doc").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(start).alias("n_base"),
        F.min(start).cast("long").alias("first_word"),
        F.max(start).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(place | notice, F.col("label")))).alias("labels"),
        F.coalesce(F.max(worth), F.lit(0.0)).alias("score"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """Per document the base places, the labels as text and the score."""
    return scan(docs).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _sql() -> str:
    given = templates(PHRASES, NOTICES)
    rows, must, unless = [], [], []
    for i, x in enumerate(given):
        base = str(x.base).lower()
        rows += [
            f"({x.k}, '{' '.join(x.words[t : t + x.k])}', {i}, '{x.label}', {base}, {t}, {x.grams})" for t in range(x.grams)
        ]
        must += [f"({i}, {j}, {t})" for j, ts in enumerate(x.must) for t in ts]
        unless += [f"({i}, '{word}')" for word in x.unless]
    denials = ", ".join(f"'{word}'" for word in DENIALS)
    return rf"""
WITH tpl(k, g, id, label, base, t, n) AS (VALUES {", ".join(rows)}),
must(id, phrase, t) AS (VALUES {", ".join(must)}),
phrases AS (SELECT id, count(DISTINCT phrase) AS n_phrases FROM must GROUP BY id),
unless(id, word) AS (VALUES {", ".join(unless)}),
dw AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw),
g AS (
  SELECT doc_id, p - 1 AS p, 2 AS k, array_to_string(w[p : p + 1], ' ') AS g FROM pos WHERE p + 1 <= len(w)
  UNION ALL SELECT doc_id, p - 1, 3, array_to_string(w[p : p + 2], ' ') FROM pos WHERE p + 2 <= len(w)
), v AS (SELECT doc_id, id, label, base, n, p, t, g.k FROM g JOIN tpl ON g.k = tpl.k AND g.g = tpl.g),
d AS (SELECT DISTINCT doc_id, id, base, p - t AS diagonal FROM v), f AS (
  SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal)
    > {NEIGHBOURS}, true) THEN 1 ELSE 0 END AS s FROM d
), m AS (
  SELECT *, sum(s) OVER (PARTITION BY doc_id, id ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM f
), vs AS (SELECT v.*, m.span FROM v JOIN m ON v.doc_id = m.doc_id AND v.id = m.id AND v.p - v.t = m.diagonal),
c AS (
  SELECT doc_id, id, label, base, span, min(p) AS start, max(p + k) AS stop, count(DISTINCT t) / max(n) AS coverage
  FROM vs GROUP BY ALL
), q AS (
  SELECT doc_id, id, span, count(DISTINCT phrase) AS n_hit FROM vs JOIN must USING (id, t) GROUP BY ALL
), j AS (
  SELECT c.*, coalesce(coalesce(n_hit, 0) / n_phrases, 1.0) AS decided,
    NOT base AND (coalesce(w[start] IN ({denials}), false) OR coalesce(EXISTS (
      SELECT 1 FROM unless WHERE unless.id = c.id AND unless.word = w[stop + 1]), false)) AS denied
  FROM c JOIN dw USING (doc_id) LEFT JOIN q USING (doc_id, id, span) LEFT JOIN phrases ON phrases.id = c.id
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE base AND coverage >= 1) AS n_base,
    min(start) FILTER (WHERE base AND coverage >= 1) AS first_word,
    max(start) FILTER (WHERE base AND coverage >= 1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND coverage >= 1) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE (base AND coverage >= 1) OR
      (NOT base AND coverage >= {COVERAGE} AND decided >= 1 AND NOT denied)) AS labels,
    max(CASE WHEN denied THEN 0 ELSE coverage * decided END) FILTER (WHERE NOT base OR coverage >= 1) AS score
  FROM j GROUP BY 1
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM dw LEFT JOIN a ON dw.doc_id = a.doc_id
"""


SQL = _sql()
