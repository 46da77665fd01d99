import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from review_trust.llm import queries, repair

BLANK = " \t\n\x0b\x0c\r"
MESSAGES = "conv_id bigint, turn bigint, role string, text string, kind int, cost string, piece string"


def plain_damage(rows):
    """Damaged rows of every conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        names = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(names).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: order(own) for c, own in out.items()}


def order(own):
    return sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))


def cheapest(symbols):
    """Cost and edits by a search over (messages read, roles so far), cheapest and then smallest string first."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(symbols) and state in ("", "a", "A"):
            return cost, edits
        if (i, state) in seen:
            continue
        seen.add((i, state))
        want = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, edits + "I", i, want))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if initial == want or (initial == "s" and state == ""):
                heapq.heappush(heap, (cost + more, edits + "K", i + 1, initial))
            heapq.heappush(heap, (cost + more + 1, edits + "R", i + 1, want))


def brute(damaged):
    out = []
    for conv, rows in damaged.items():
        faults, said = [], set()
        for _, role, text in rows:
            body = text.strip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in said else ""
            faults.append(fault or ("" if body[-1] in ".!?" else "truncated"))
            said.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(list(zip(initials, faults)))
        texts, state, left = [], "", iter(rows)
        for edit in audit:
            want = {"u": "user", "a": "assistant"}["a" if state == "u" else "u"]
            _, role, text = (0, "", "") if edit == "I" else next(left)
            if edit != "D":
                texts.append((role if edit == "K" else want, text))
                state = texts[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in texts).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def talk(rng, n_conversations, longest=12):
    rows = []
    for conv in range(n_conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            text = rng.choice(["Yes.", "No!", "what now?", "cut short", " \t", "", None, "Bye. ", "a\nb."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "p") for r in rows], MESSAGES)


def run(spark, rows, damaged=True):
    messages = frame(spark, rows)
    got = repair.repair(repair.damage(messages) if damaged else repair.undamaged(messages), messages).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = talk(random.Random(seed), 150)
    rows += rows[:5] + [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Yes.")]
    assert run(spark, rows) == brute(plain_damage(rows))


def test_a_long_conversation_in_pieces(spark, request):
    rng = random.Random(4)
    rows = [(7, t, r, f"{x} {t // 3}.") for t, (r, x) in enumerate(zip(["user", "assistant"] * 1500, "ab" * 1500))]
    rows = [(c, t, rng.choice([r, r, r, "user", "system"]), x[: rng.choice([99, 99, 3])]) for c, t, r, x in rows]
    rows += [(8, t, "user", f"{t}.") for t in range(2_000)] + talk(rng, 3)
    want = brute(plain_damage(rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # such small pieces would be one
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    assert run(spark, rows) == want
    faults = repair._faults(repair._counted(repair.damage(frame(spark, rows))))
    pieces = repair._scan(faults).filter("piece IS NOT NULL AND conv_id IN (7, 8)").groupBy("conv_id").count().collect()
    assert all(r["count"] > 1 for r in pieces)  # they were in pieces


def test_equal_messages_are_one_run(spark):
    rows = [(1, 0, "user", "Hi.")] * 3_000 + [(1, 1, "assistant", "Yes.")] + [(2, None, " ", " ")] * 40
    plain = {1: order([r[1:] for r in rows[:3_001]]), 2: [(None, " ", " ")] * 40}
    assert run(spark, rows, damaged=False) == brute(plain)


def test_powers_of_a_run():
    powers = repair.Powers()
    for symbol in range(9):
        end = repair.AT_END
        for length in range(1, 40):
            end = repair.times(repair._single(symbol), end)
            assert powers.before(symbol, length, repair.AT_END) == end
        assert all(exponent <= 5 for _, exponent in powers.known)
    long = [(1, 5_000), (6, 700), (8, 3)]
    short = [(s, 1) for s, n in long for _ in range(n)]
    assert powers.audit(long, 0, repair.AT_END, True) == powers.audit(short, 0, repair.AT_END, True)
    end = powers.before(1, 5_000, powers.before(6, 700, powers.before(8, 3, repair.AT_END)))
    assert repair.times(powers.matrix(long), repair.AT_END) == end


def test_repaired_messages_obey_the_grammar(spark):
    rows = talk(random.Random(9), 40)
    got = repair.repaired_messages(repair.undamaged(frame(spark, rows))).orderBy("conv_id", "place").collect()
    roles = {}
    for r in got:
        roles.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("s?(ua)+", "".join(r)) for r in roles.values())
    digests = {r[0]: r[-1] for r in run(spark, rows, damaged=False)}
    for conv in roles:
        text = "\n".join(f"{r.role}:{r.text}" for r in got if r.conv_id == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == digests[conv]


def test_no_rows(spark):
    assert run(spark, []) == []
    only = [(5, t, "user", "x.") for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0]
    assert run(spark, only) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = queries.op13_repair(spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(plain_damage(rows))


def test_text_ids_and_odd_columns(spark):
    rows = frame(spark, talk(random.Random(3), 9))
    odd = rows.withColumns({c: F.lit("x") for c in ("_id", "Copies", "digest", "first", "blank", "meta.url")})
    odd = odd.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert repair.repair(repair.undamaged(odd), odd).count() == 9
