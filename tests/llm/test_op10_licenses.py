import random

import duckdb
import pandas as pd
import pytest
from llm_data import corpus, docs, prose, word_list

from review_trust.llm import licenses


def brute(rows):
    out = set()
    for doc_id, text in rows:
        w, at = word_list(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        places = [i for i, _ in at]
        labels = ",".join(sorted({x for _, x in at}))
        out.add((doc_id, text, len(w), len(at), min(places, default=None), max(places, default=None), labels))
    return sorted((r[:1] + r[2:] for r in out), key=str)


def planted(seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    phrases = [*licenses.PHRASES, *(n.text for n in licenses.NOTICES.values()), "CC-BY", "cc by\ncc", "general public", "All Rights, Reserved"]
    for i in range(60):
        parts = [prose(rng, rng.randrange(6))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(phrases), prose(rng, rng.randrange(6))]
        rows.append((9_000 + i, " ".join(parts)))
    return [*rows, (9_999, "cc by " * 500), (9_998, "cc by")]


def test_base_places_equal_brute_force(spark):
    rows = planted(1)
    got = [tuple(r)[:6] for r in licenses.digests(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_interrupted_notice_is_one_span(spark):
    mit = licenses.NOTICES["mit-text"].text
    changed = mit.replace("this software", "this very nice software").replace("merge, ", "")
    far = mit.replace("this software", "this " + "filler " * 30 + "software")
    rows = [(1, mit), (2, f"x y {changed} z"), (3, mit[:60]), (4, far), (5, None)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[1].labels == ["mit-text"] and got[1].score == 1
    assert got[2].labels == ["mit-text"] and 0.6 < got[2].score < 1
    assert got[3].labels == [] and 0 < got[3].score < 0.6
    assert got[4].labels == ["mit-text"] and got[4].score < 0.9
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].score) == (0, 0, None, 0)


def test_method_labels_keep_base_labels(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, licenses.NOTICES["gpl-3.0"].text)]
    got = {r.doc_id: r for r in licenses.digests(docs(spark, rows)).collect()}
    assert (got[1].base_labels, got[1].labels) == ("cc-by", "cc-by,cc-by-nc")
    assert (got[2].base_labels, got[2].labels) == ("gpl", "gpl,gpl-3.0")


CASES = {
    "Licensed under the Apache License, Version 1.1": "apache-1.1",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "It is not licensed under the Apache License, Version 2.0": "",
    "It isn't licensed under the Apache License, Version 2.0, is it": "",
    "not licensed under the Apache License version": "",
    "licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
    "Licensed under the GNU General Public License, version 3 or later": "gpl,gpl-3.0",
    "licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl-3.0",
    "licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl-2.1",
    "licensed under the GNU Affero General Public License, version 3": "agpl-3.0,gpl",
    "Licensed under CC BY-NC 3.0": "cc-by,cc-by-nc",
    "Licensed under CC BY-NC-ND 3.0": "cc-by,cc-by-nc-nd",
    "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
    "Licensed under CC BY 4.0": "cc-by",
    "CC BY-NC, and that again: CC BY-NC-ND": "cc-by,cc-by-nc,cc-by-nc-nd",
    "a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License": "",
    "subject to the terms of the Mozilla Public License, v. 1.1": "",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "we talked about the license and the version of it": "",
}


def test_deciding_words_and_denials(spark):
    rows = list(enumerate(CASES))
    got = {r.doc_id: r for r in licenses.digests(docs(spark, rows)).collect()}
    assert {text: got[i].labels for i, text in rows} == CASES
    assert got[0].score == 1 and got[2].score == 0 and 0 < got[17].score < 0.6


def test_every_notice_gives_its_label_alone(spark):
    rows = list(enumerate(licenses.NOTICES.values()))
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [(i, f"x {n.text} y") for i, n in rows])).collect()}
    for i, n in rows:
        assert set(got[i].labels) - set(got[i].base_labels) == {n.label}, n.text


def test_sql_on_planted_notices(spark):
    rows = [*planted(2), *((20_000 + i, text) for i, text in enumerate(CASES))]
    frame = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}).drop_duplicates("doc_id")
    with duckdb.connect() as con:
        con.register("documents", frame)
        want = sorted(con.sql(licenses.SQL).fetchall(), key=str)
    table = docs(spark, [(int(i), t) for i, t in frame.dropna(subset="doc_id").itertuples(index=False)])
    got = sorted((tuple(r) for r in licenses.digests(table).collect()), key=str)
    want = [r for r in want if r[0] is not None]
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want])


def test_wrong_deciding_phrase_is_an_error(spark):
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, []), notices={"x": licenses.Notice("x", "some words of a text", ("other",))})


def test_empty_table(spark):
    assert licenses.digests(docs(spark, [])).count() == 0
