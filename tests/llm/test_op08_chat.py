import random
import re

import duckdb
from compare import differences

from review_trust.llm import chat

COLUMNS = "conv_id bigint, turn bigint, role string, text string, root string, level string, head string, `n.h` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "l", "h", 1) for r in rows], COLUMNS)


def norm(line):
    return " ".join(line.lower().split())


def split(line):
    level, rest = 0, line
    while rest.lstrip(" \t").startswith(">"):
        rest = rest.lstrip(" \t")[1:]
        level += 1
    return level, norm(rest)


def passages(text):
    """(level, words, lines and sentences) of every passage."""
    found, last = [], None
    for line in (text or "").split("\n"):
        level, said = split(line)
        if not said:
            last = None
        elif level == last:
            found[-1][1].append(said)
        else:
            found.append((level, [said]))
            last = level
    out = []
    for level, lines in found:
        said = " ".join(lines)
        out.append((level, said, {*lines, *re.split(r"(?<=[.!?]) ", said)}))
    return out


def brute(rows):
    said, turns = {}, {}
    for conv, turn, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        turns.setdefault(conv, set()).add(turn)
        for level, _, units in passages(text):
            for unit in units if level == 0 else ():
                said.setdefault((conv, unit), turn)
    links = {}
    for conv in turns:
        for turn in turns[conv]:
            quoted = {}
            for r in rows:
                if (r[0], r[1]) == (conv, turn):
                    quoted.update({(lv, w): units for lv, w, units in passages(r[3]) if lv})
            found = []
            for (level, _), units in quoted.items():
                at = [said[conv, u] for u in units if said.get((conv, u), turn) < turn]
                if at:
                    found.append((level, -max(at)))
            before = max((t for t in turns[conv] if t < turn), default=None)
            links[conv, turn] = (-min(found)[1] if found else before, len(quoted), len(found))
    out = {}
    for key in links:
        at, depth = key, 0
        while links[at][0] is not None:
            at, depth = (at[0], links[at][0]), depth + 1
        out[key] = (links[key][0], at[1], depth, *links[key][1:])
    return out


def talk(seed, n_conv=6, n_turns=12):
    """Messages with gaps between turns; they quote lines, sentences and rewrapped passages of each other."""
    rng = random.Random(seed)
    rows = []
    for conv in range(n_conv):
        own = []
        for turn in sorted(rng.sample(range(20), n_turns)):
            text = []
            for _ in range(rng.randrange(5)):
                if own and rng.random() < 0.6:
                    words = rng.choice(own).upper().split(" ")
                    if rng.random() < 0.4:
                        words[rng.randrange(len(words))] += "\n"
                    marks = rng.choice(["> ", ">> ", "> > ", ">"])
                    text += [marks + part for part in " ".join(words).split("\n")]
                else:
                    parts = [f"said  {rng.randrange(40)} in {conv}{rng.choice(['.', '!', '?', ''])}" for _ in range(3)]
                    own += [*parts, " ".join(parts)]
                    text.append(rng.choice([" ", "\n", "\n\n"]).join(parts))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(text)))
    return rows


def links(rows):
    return {(r.conv_id, r.turn): (r.reply_to, r.root, r.depth, r.n_quoted, r.n_linked) for r in rows}


def test_threads_equal_brute_force(spark):
    for seed in (1, 2, 3):
        rows = talk(seed)
        got = chat.conversations(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        want = brute(rows)
        assert links(got) == want
        assert sum(w[4] for w in want.values()) > 20 and any(w[3] > w[4] for w in want.values())


def test_planted_quotations_equal_sql(spark):
    rows = [*talk(7, 8, 16), (1, None, "user", "> x"), (None, 3, None, None), (9, 1, "user", None)]
    rows += rows[:2]
    got = chat.digests(frame(spark, rows)).toPandas()
    db = duckdb.connect()
    messages = frame(spark, rows).select("conv_id", "turn", "role", "text").toPandas()
    db.register("given", messages)
    db.execute(
        "CREATE VIEW conversations AS SELECT TRY_CAST(conv_id AS BIGINT) AS conv_id, TRY_CAST(turn AS BIGINT) AS turn, "
        "role, text FROM given"
    )
    assert (got.n_linked > 0).sum() > 20
    assert differences(got, db.sql(chat.SQL).df()) == []


def test_one_sentence_of_a_longer_line_and_other_wrapping(spark):
    rows = [
        (1, 0, "user", "First things first. The tea is cold! Who made it?"),
        (1, 1, "assistant", "Nobody knows.\nNobody asks."),
        (1, 2, "user", "> the tea\n> is  COLD!\nthen heat it"),
        (1, 3, "assistant", ">> The tea is cold!\n> Nobody knows. Nobody asks.\nso?"),
        (1, 4, "user", "> never said by anyone\nhm"),
    ]
    got = links(chat.conversations(frame(spark, rows)).collect())
    assert got[1, 2] == (0, 0, 1, 1, 1)
    assert got[1, 3] == (1, 0, 2, 2, 2)
    assert got[1, 4] == (3, 0, 3, 1, 0)


def test_gaps_between_turns_keep_the_thread(spark):
    got = links(chat.conversations(frame(spark, [(1, t, "user", f"t{t}") for t in (0, 1, 2, 5)])).collect())
    assert got[1, 5] == (2, 0, 3, 0, 0)


def test_reply_order_and_text(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you"),
        (1, 1, "assistant", "> hello   THERE\n\nhi\n> > deeper\n"),
        (1, 2, None, None),
        (1, 4, "user", "later"),
        (1, 2, "user", "twice"),
        (None, 1, "user", "> x"),
        (2, None, "user", "y"),
    ]
    got = chat.conversations(frame(spark, rows)).collect()
    assert [(r.conv_id, r.turn) for r in got if r.conv_id == 1] == [(1, 0), (1, 1), (1, 2), (1, 2), (1, 4)]
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].chat == "<|assistant|>\nhi" and (by[1, 1].n_quoted, by[1, 1].n_linked) == (2, 1)
    assert by[1, 4].reply_to == 2 and by[1, 4].root == 0
    assert by[None, 1].root is None and by[2, None].depth is None
    assert {r.chat for r in got if (r.conv_id, r.turn) == (1, 2)} == {"<|unknown|>\n", "<|user|>\ntwice"}


def test_long_chains(spark):
    # Conversation 1 quotes nothing; in 2 every message quotes the one two turns before, so every turn heads a run.
    rows = [(1, i, "user", f"line {i}") for i in range(300)]
    rows += [(2, i, "user", f"> line {i - 2}\nline {i}") for i in range(100)]
    got = links(chat.conversations(frame(spark, rows)).collect())
    assert all(got[1, i][1:3] == (0, i) for i in range(300))
    assert all(got[2, i][1:3] == (0, (i + 1) // 2 if i % 2 else i // 2) for i in range(100))


def test_empty_table(spark):
    assert chat.conversations(frame(spark, [])).count() == 0
