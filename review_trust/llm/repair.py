"""Conversation structure repair by a run-length dynamic program.

Messages of a conversation become symbols: what role they have (system, user, assistant or another) and whether they must
go (blank, repeated) or are cut short. The repaired roles must read ``(system? (user assistant)+)?``. An edit keeps a
message, changes its role, deletes it or inserts an empty one; the cheapest edits are wanted, and among them the
smallest as a string of their initials.

What is read so far is one of four states, so a symbol is a 4 x 4 matrix of costs in min-plus arithmetic and a sequence is
the product of its symbols' matrices. Equal symbols in a row are one run, whose matrix is a power: it is put together
from powers of two that are computed once per symbol. Going back over the runs gives the cost that is still to come at
the end of every run; going forward from the start and taking the smallest initial that loses nothing gives the edits.

Messages are sorted by conversation over all tasks, so a long conversation is cut into pieces that lie in consecutive
tasks. A task finishes the conversations that lie within it. The first and the last one may go on elsewhere; of these it
returns the matrix, and from the matrices, at most two a task, follows the cost to come at the end of each piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import BLANKS, broadcast_if_small
from review_trust.sources.artifacts import cut

# Costs of the edits, besides keeping at 0, and of a message that stays cut short.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = ("system", "user", "assistant")
STOPS = (".", "!", "?")
LEGAL = ("su", "ua", "au")

# States: nothing yet, after the system message, after a user's, after an assistant's.
STATES = range(4)
# What may follow a state is a user's message, after which it is 2, or an assistant's, after which it is 3.
FOLLOWING = (2, 2, 3, 2)
# Costs to come when all messages are read: a complete conversation, or none, needs nothing more.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 50

# Symbols: the initial's place in INITIALS, plus SHORT for a message cut short; GONE must be deleted.
INITIALS = "sua"
OTHER, SHORT, GONE = 3, 4, 8
# Edits of a run worked out one by one; a longer run is halved.
STRETCH = 512

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _edits(symbol: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits that use up a message, in the order of their initials: initial, cost, next state."""
    out = []
    for state in STATES:
        edits = [("D", DELETE, state)]
        if symbol != GONE:
            short = TRUNCATED if symbol >= SHORT else 0
            role = symbol % SHORT
            if role == 0 and state == 0:
                edits.append(("K", short, 1))
            if role + 1 == FOLLOWING[state]:
                edits.append(("K", short, FOLLOWING[state]))
            edits.append(("R", REROLE + short, FOLLOWING[state]))
        out.append(edits)
    return out


EDITS = [_edits(symbol) for symbol in range(GONE + 1)]


def times(a: Matrix, v: Vector) -> Vector:
    return tuple(min(min(x + y for x, y in zip(row, v)), NEVER) for row in a)


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = [times(a, column) for column in zip(*b)]
    return tuple(zip(*columns))


def _single(symbol: int) -> Matrix:
    """The matrix of one message, with insertions before it."""
    rows = []
    for state in STATES:
        best = [NEVER] * len(STATES)
        at, paid = state, 0
        for _ in range(3):  # more insertions come back to a state they have left
            for _, cost, then in EDITS[symbol][at]:
                best[then] = min(best[then], paid + cost)
            at, paid = FOLLOWING[at], paid + INSERT
        rows.append(tuple(best))
    return tuple(rows)


class Powers:
    """Matrices of runs whose length is a power of two, each computed once."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], Matrix] = {}

    def get(self, symbol: int, exponent: int) -> Matrix:
        key = (symbol, exponent)
        if key not in self.known:
            half = self.get(symbol, exponent - 1) if exponent else None
            self.known[key] = product(half, half) if half else _single(symbol)
        return self.known[key]

    def before(self, symbol: int, length: int, end: Vector) -> Vector:
        """The costs to come before a run, from those after it."""
        exponent = 0
        while length:
            if length & 1:
                end = times(self.get(symbol, exponent), end)
            length >>= 1
            exponent += 1
        return end

    def matrix(self, runs: list[tuple[int, int]]) -> Matrix:
        units = [tuple(0 if i == j else NEVER for j in STATES) for i in STATES]
        columns = []
        for column in units:
            for symbol, length in reversed(runs):
                column = self.before(symbol, length, column)
            columns.append(column)
        return tuple(zip(*columns))

    def _unroll(self, symbol: int, length: int, state: int, end: Vector, out: list[str]) -> int:
        """Append the edits of a run and return the state after it."""
        if length > STRETCH:
            rest = 1 << (length - 1).bit_length() - 1
            state = self._unroll(symbol, length - rest, state, self.before(symbol, rest, end), out)
            return self._unroll(symbol, rest, state, end, out)
        one = self.get(symbol, 0)
        costs = [end]
        for _ in range(length):
            costs.append(times(one, costs[-1]))
        for left in range(length, 0, -1):
            now, then = costs[left], costs[left - 1]
            edits = EDITS[symbol]
            while True:
                letter, cost, after = edits[state][0]
                if cost + then[after] == now[state]:
                    break
                if INSERT + now[FOLLOWING[state]] == now[state]:
                    out.append("I")
                    state = FOLLOWING[state]
                    continue
                letter, cost, after = next(e for e in edits[state][1:] if e[1] + then[e[2]] == now[state])
                break
            out.append(letter)
            state = after
        return state

    def audit(self, runs: list[tuple[int, int]], start: int, end: Vector, last: bool) -> tuple[str, int, int]:
        """The edits of ``runs``, the state after them and the cost to come before them; ``last``: nothing follows."""
        ends = [end]
        for symbol, length in reversed(runs):
            ends.append(self.before(symbol, length, ends[-1]))
        cost = ends.pop()[start]
        out: list[str] = []
        state = start
        for (symbol, length), after in zip(runs, reversed(ends)):
            state = self._unroll(symbol, length, state, after, out)
        while last and AT_END[state]:
            out.append("I")
            state = FOLLOWING[state]
        return "".join(out), state, cost


def damage(messages: DataFrame) -> DataFrame:
    """``messages`` as the contract of the query damages them: conv_id, turn, role, text, copies.

    A null role or text reads as one space, and so does a null conv_id or turn in what decides on the damage.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return messages.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, "".join(STOPS), "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(messages: DataFrame) -> DataFrame:
    """``messages`` as they are, in the columns of ``damage``."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space).alias("text"), F.coalesce("role", space).alias("role")
    return messages.select("conv_id", "turn", role, text, F.lit(1).alias("copies"))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows that agree in all as one with their number, and a digest of the text that orders rows of one turn and role."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    return counted.withColumn("digest", F.unhex(F.md5("text")))


def _place() -> Column:
    """Orders turns, null first."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def _faults(counted: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copies, blank, later (said before in another turn), short; no text."""
    same = ["conv_id", "role", "digest"]
    repeated = counted.groupBy(*same).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = broadcast_if_small(cut(repeated.select(*[F.col(c).alias(f"{c}_") for c in same], "first"), "repeated"))
    body = F.btrim("text", F.lit(BLANKS))
    rows = counted.select(
        *["conv_id", "turn", "role", "digest", "copies"],
        (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(*STOPS)).alias("short"),
    )
    met = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same]
    joined = rows.join(repeated, met, "left")
    later = F.coalesce(F.col("first") < _place(), F.lit(False)).alias("later")
    return joined.select("conv_id", "turn", "role", "digest", "copies", "blank", "short", later)


def _counts(faults: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated."""
    copies = F.col("copies").cast("long")
    duplicate = F.when(F.col("blank"), 0).otherwise(copies - 1 + F.col("later").cast("long"))
    turns = faults.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), copies).otherwise(0)).alias("blank"),
        F.sum(duplicate).alias("duplicate"),
        F.count_if(~F.col("blank") & ~F.col("later") & F.col("short")).alias("truncated"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    return turns.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *sums)


class _Piece:
    """The messages of a conversation that a task has read so far."""

    def __init__(self, conv_id: object):
        self.conv_id, self.runs, self.illegal = conv_id, [], 0
        self.first = self.last = None

    def _run(self, symbol: int, length: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + length)
        elif length:
            self.runs.append((symbol, length))

    def add(self, symbol: int, initial: str, copies: int) -> None:
        self._run(symbol, 1)
        self._run(GONE, copies - 1)
        self.illegal += copies - 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial


def _scan(faults: DataFrame) -> DataFrame:
    """Conversations that lie within a task with their edits, and pieces of those that may not."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "", 0).otherwise(F.instr(F.lit(INITIALS), initial))
    role = F.when(role == 0, OTHER).otherwise(role - 1)
    symbol = F.when(F.col("blank") | F.col("later"), GONE).otherwise(role + F.when(F.col("short"), SHORT).otherwise(0))
    order = ["conv_id", "turn", "role", "digest"]
    rows = faults.select(*order, symbol.cast("int").alias("symbol"), initial.alias("initial"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, here = Powers(), TaskContext.get().partitionId()

        def open_piece(piece: _Piece) -> dict:
            return {
                "conv_id": piece.conv_id,
                "piece": here,
                "symbols": [s for s, _ in piece.runs],
                "lengths": [n for _, n in piece.runs],
                "matrix": [x for row in powers.matrix(piece.runs) for x in row],
                "illegal": piece.illegal,
                "first": piece.first,
                "last": piece.last,
            }

        def finished(piece: _Piece) -> dict:
            audit, _, cost = powers.audit(piece.runs, 0, AT_END, True)
            return {"conv_id": piece.conv_id, "illegal": piece.illegal, "cost": cost, "audit": audit}

        piece, pieces, schema = None, 0, None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_SCANNED])
            done: list[dict] = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "symbol", "initial", "copies"))
            for conv_id, symbol, first, copies in zip(*columns):
                if piece is None or piece.conv_id != conv_id:
                    if piece:
                        done.append(open_piece(piece) if pieces == 1 else finished(piece))
                    piece, pieces = _Piece(conv_id), pieces + 1
                piece.add(symbol, first, copies)
            yield pa.RecordBatch.from_pylist(done, schema)
        if piece:
            yield pa.RecordBatch.from_pylist([open_piece(piece)], schema)

    kind = faults.schema["conv_id"].dataType.simpleString()
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, {_SCAN}")


_SCAN = (
    "piece int, symbols array<int>, lengths array<bigint>, matrix array<bigint>, illegal bigint, first string, "
    "last string, cost bigint, audit string"
)
_SCANNED = [
    ("piece", pa.int32()),
    ("symbols", pa.list_(pa.int32())),
    ("lengths", pa.list_(pa.int64())),
    ("matrix", pa.list_(pa.int64())),
    ("illegal", pa.int64()),
    ("first", pa.string()),
    ("last", pa.string()),
    ("cost", pa.int64()),
    ("audit", pa.string()),
]


def _together(scanned: DataFrame) -> DataFrame:
    """The edits of the conversations that are in pieces: conv_id, illegal, cost, audit.

    At most two pieces a task; only their matrices and end states come to the driver.
    """
    spark, kind = scanned.sparkSession, scanned.schema["conv_id"].dataType.simpleString()
    pieces = scanned.filter("piece IS NOT NULL")
    # Two pieces a task at most: 16 numbers each.
    found = pieces.select("conv_id", "piece", "matrix", "illegal", "first", "last").collect()
    found.sort(key=lambda r: r.piece)
    groups: dict[object, list] = {}
    for row in found:
        groups.setdefault(row.conv_id, []).append(row)
    ends: dict[tuple[object, int], Vector] = {}
    totals = []
    for conv_id, rows in groups.items():
        end: Vector = AT_END
        for row in reversed(rows):
            ends[conv_id, row.piece] = end
            end = times(tuple(row.matrix[i : i + 4] for i in range(0, 16, 4)), end)
        illegal = sum(r.illegal for r in rows) + sum(a.last + b.first not in LEGAL for a, b in zip(rows, rows[1:]))
        totals.append((conv_id, illegal, end[0]))
    lasts = {(conv_id, rows[-1].piece) for conv_id, rows in groups.items()}

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                key, runs = (row["conv_id"], row["piece"]), list(zip(row["symbols"], row["lengths"]))
                audits = [powers.audit(runs, start, ends[key], key in lasts)[:2] for start in STATES]
                made = {
                    "conv_id": [key[0]] * len(audits),
                    "piece": [key[1]] * len(audits),
                    "start": list(STATES),
                    "then": [state for _, state in audits],
                    "part": [audit for audit, _ in audits],
                }
                types = [batch.schema.field("conv_id").type, *[pa.int32()] * 3, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), types)], list(made))

    columns = f"conv_id {kind}, piece int, start int, then int, part string"
    ways = cut(pieces.select("conv_id", "piece", "symbols", "lengths").mapInArrow(unroll, columns), "piece-edits")
    # Four short rows a piece.
    then = {(r.conv_id, r.piece, r.start): r.then for r in ways.select("conv_id", "piece", "start", "then").collect()}
    chosen = []
    for conv_id, rows in groups.items():
        state = 0
        for row in rows:
            chosen.append((conv_id, row.piece, state))
            state = then[conv_id, row.piece, state]
    picked = spark.createDataFrame(chosen, f"c {kind}, p int, s int")
    total = spark.createDataFrame(totals, f"c {kind}, illegal bigint, cost bigint")
    mine = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("start") == F.col("s"))
    parts = ways.join(F.broadcast(picked), mine)
    # As many parts as there are tasks at most; together they are the one string that is returned.
    audits = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    audit = F.array_join(F.col("parts.part"), "").alias("audit")
    joined = audits.join(F.broadcast(total), F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.select("conv_id", "illegal", "cost", audit)


def _edited(rows: Iterable[tuple], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the messages that ``audit`` makes of ``rows`` (role, text, copies)."""
    state, edits = 0, iter(audit)
    name = {2: ROLES[1], 3: ROLES[2]}

    def inserted(letter: str | None) -> Iterator[tuple[str, str]]:
        nonlocal state, edit
        while letter == "I":
            state = FOLLOWING[state]
            yield name[state], ""
            letter = next(edits, None)
        edit = letter

    edit: str | None = None
    for role, text, copies in rows:
        for _ in range(copies):
            yield from inserted(next(edits))
            if edit == "K":
                state = 1 if role[:1] == "s" else FOLLOWING[state]
                yield role, text
            elif edit == "R":
                state = FOLLOWING[state]
                yield name[state], text
    yield from inserted(next(edits, None))


def _in_order(counted: DataFrame, edits: DataFrame) -> DataFrame:
    """A conversation's edits and after them its messages in order, one conversation behind the other in a task."""
    # A digest of a whole conversation is read in order, so one task passes over it, a batch at a time.
    head = edits.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"), "cost", "illegal")
    body = counted.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies")
    both = head.unionByName(body, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple]]]:
    """Per conversation its first row, which has the edits, and the messages; these must be read to the end."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, group in groupby(rows, key=_Start()):
        head = next(group)
        yield head, ((r["role"], r["text"], r["copies"]) for r in group)


class _Start:
    """Numbers the conversations of a sorted stream: each begins with the row that has its edits."""

    def __init__(self) -> None:
        self.n = 0

    def __call__(self, row: dict) -> int:
        self.n += row["kind"] == 0
        return self.n


def _prepared(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted messages, their faults and the edits of every conversation that has messages."""
    counted = cut(_counted(messages), "messages")
    faults = cut(_faults(counted), "faults")
    scanned = cut(_scan(faults), "scanned")
    whole = scanned.filter("piece IS NULL").select("conv_id", "illegal", "cost", "audit")
    return counted, faults, whole.unionByName(_together(scanned))


def _told(
    ordered: DataFrame, make: Callable[[dict, Iterator[tuple]], Iterator[dict]], columns: str, fields: list
) -> DataFrame:
    """The rows that ``make`` yields for every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *fields])
        out: list[dict] = []
        for head, rows in _conversations(chain([first], batches)):
            for made in make(head, rows):
                out.append(made)
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, {columns}")


def repaired_messages(messages: DataFrame) -> DataFrame:
    """The repaired conversations of ``messages`` (see ``undamaged``): conv_id, place (from 0), role, text."""
    counted, _, edits = _prepared(messages)

    def make(head: dict, rows: Iterator[tuple]) -> Iterator[dict]:
        for place, (role, text) in enumerate(_edited(rows, head["text"])):
            yield {"conv_id": head["conv_id"], "place": place, "role": role, "text": text}

    fields = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    return _told(_in_order(counted, edits), make, "place bigint, role string, text string", fields)


def repair(messages: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Per conversation what is wrong with it and how it is repaired.

    ``messages`` has the columns of ``undamaged`` or ``damage``; ``all_ids`` (conv_id) adds conversations without any.
    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null conv_id is a
    conversation of its own. Messages of one turn come in the order of their role and a digest of their text; equal
    ones are adjacent and all but the first are duplicates. A role is known by its first letter; an empty one or any
    other must be changed or deleted.
    """
    counted, faults, edits = _prepared(messages)

    def make(head: dict, rows: Iterator[tuple]) -> Iterator[dict]:
        digest, separator = hashlib.sha256(), b""
        for role, text in _edited(rows, head["text"]):
            digest.update(separator + role.encode() + b":")
            digest.update(text.encode())
            separator = b"\n"
        made = {c: head[c] for c in ("conv_id", "illegal", "cost")}
        yield made | {"audit": head["text"], "repaired_sha256": digest.hexdigest()}

    columns = "illegal bigint, cost bigint, audit string, repaired_sha256 string"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    fields = [(c.split()[0], kind) for c, kind in zip(columns.split(", "), kinds)]
    repaired = _told(_in_order(counted, edits), make, columns, fields)
    parts = repaired.unionByName(_counts(faults), allowMissingColumns=True)
    if all_ids is not None:
        parts = parts.unionByName(all_ids.select("conv_id").distinct(), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    # Three rows a conversation.
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        *[F.coalesce(F.max(c), F.lit(nothing)).alias(c) for c, nothing in empty.items()],
    )
