"""Chat formatting with quotation linking, in DataFrame operations only.

A line that begins with ``>`` marks is a quotation, as deep as it has marks. Consecutive lines of one depth are a passage;
an empty line ends it. Passages are normalised (A-Z lower-cased, white space collapsed) and taken apart into their lines
and, since a quotation may be wrapped anew or begin within a line, into their sentences, each of which is hashed. So are
the passages that messages say themselves; joining the hashes within a conversation links a quoted passage to the
messages that said its parts first, of which the latest counts. A message replies to the message that it quotes at the
least depth (the latest of them), or else to the turn before, which is the largest smaller one. Conversations come out in
reply order, without the quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from review_trust.llm.common import UPPER, ascii_lower, broadcast_if_small, let
from review_trust.operators.skew import salted_join
from review_trust.sources.artifacts import cut

# Marks at the start of a line, each with blanks around it.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
# A sentence ends with one of these marks and a blank.
SENTENCE_END = "([.!?]) "
# Rounds of pointer doubling: chains of up to 2 ** ROUNDS quotations of quotations.
ROUNDS = 40


def _lines(text: Column) -> Column:
    """Lines with their depth of quotation and their normalised words."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")

    def parse(line: Column) -> Column:
        level = F.regexp_count(F.regexp_extract(line, MARKS, 0), F.lit(">"))
        said = F.regexp_replace(ascii_lower(F.regexp_replace(line, MARKS, "")), r"[\x20\x09-\x0D]+", " ")
        return F.struct(level.alias("level"), F.trim(said).alias("said"))

    return F.transform(parts, parse)


def body_of(text: Column) -> Column:
    """The lines that are no quotations, without blanks and empty lines at either end."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ~line.rlike(MARKS))
    return F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n"))


def passages(text: Column) -> Column:
    """Consecutive lines of one depth as structs: level, lines (joined by carriage returns, which no line has)."""

    def glue(lines: Column) -> Column:
        def piece(line: Column, i: Column) -> Column:
            before = F.get(lines, i - 1)
            goes_on = (before["level"] == line["level"]) & (before["said"] != "") & (line["said"] != "")
            opening = F.concat(F.lit("\n"), line["level"].cast("string"), F.lit(">"))
            return F.concat(F.when(goes_on, F.lit("\r")).otherwise(opening), line["said"])

        return F.array_join(F.transform(lines, piece), "")

    def parse(passage: Column) -> Column:
        level = F.substring_index(passage, ">", 1)
        lines = F.substring(passage, F.length(level) + F.lit(2), F.length(passage))
        return F.struct(level.cast("int").alias("level"), lines.alias("lines"))

    found = F.transform(F.array_remove(F.split(let(_lines(text), glue), "\n"), ""), parse)
    return F.filter(found, lambda p: p["lines"] != "")


def _units(messages: DataFrame, quoted: bool) -> DataFrame:
    """Hashed lines and sentences of what messages quote or say: conv_id, turn, level, passage, h, h2."""
    wanted = F.filter(passages(F.col("text")), lambda p: (p["level"] > 0) == F.lit(quoted))
    found = messages.select("conv_id", "turn", F.inline(wanted))
    said = F.translate("lines", "\r", " ")
    sentences = F.split(F.regexp_replace(said, SENTENCE_END, "$1\n"), "\n")
    units = F.explode(F.array_union(F.split("lines", "\r"), sentences)).alias("unit")
    hashed = found.select("conv_id", "turn", "level", F.xxhash64(said, F.lit(1)).alias("passage"), units)
    return hashed.select(
        "conv_id", "turn", "level", "passage", F.xxhash64("unit", F.lit(0)).alias("h"), F.hash("unit").alias("h2")
    )


def reply_links(messages: DataFrame) -> DataFrame:
    """Per conversation and turn that has quotations: conv_id, turn, n_quoted, n_linked, quoted_turn (null if none).

    ``n_quoted`` counts the different passages that the turn quotes, ``n_linked`` those of which a line or a sentence
    was said before.
    """
    marked = messages.filter(F.contains("text", F.lit(">")))
    quotes = cut(_units(marked, quoted=True).distinct(), "quotes")
    # What nobody quotes need not be grouped. 8 bytes a row; equal hashes of other units only let more rows through.
    key = F.xxhash64("conv_id", "h").alias("unit_key")
    said = _units(messages, quoted=False).select("conv_id", "turn", "h", "h2", key)
    asked = broadcast_if_small(cut(quotes.select(key).distinct(), "quoted-units"))
    originals = said.join(asked, "unit_key", "left_semi").groupBy("conv_id", "h", "h2").agg(
        F.min("turn").alias("first_turn")
    )
    linked = salted_join(quotes, originals, ["conv_id", "h", "h2"], ["turn", "passage"])
    earlier = F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn"))
    found = linked.groupBy("conv_id", "turn", "level", "passage").agg(F.max(earlier).alias("said_in"))
    place = F.when(F.col("said_in").isNotNull(), F.struct("level", (-F.col("said_in")).alias("later")))
    return found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quoted"), F.count("said_in").alias("n_linked"), (-F.min(place)["later"]).alias("quoted_turn")
    )


def runs(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, quoted_turn, ...), one row per turn, with reply_to, place, root and head.

    ``place`` numbers the turns of a conversation, ``root`` is its first turn, and ``head`` the turn that began the run of
    turns which each reply to the one before. A conversation may be longer than a task can hold, so turns are sorted
    into blocks; windows stay within one, and what comes before a block is carried over from one row per block.
    """
    blocks = cut(turns.repartitionByRange("conv_id", "turn").withColumn("block", F.spark_partition_id()), "turn-blocks")
    within = ["block", "conv_id"]
    inside = Window.partitionBy(*within).orderBy("turn")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.groupBy(*within).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n"))
    carried = ends.select(
        *within,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("places_before"),
        F.max("hi").over(earlier).alias("last_before"),
        F.coalesce(F.min("lo").over(earlier), F.col("lo")).alias("root"),
    )
    numbered = blocks.withColumn("row", F.row_number().over(inside)).withColumn("previous", F.lag("turn").over(inside))
    previous = F.coalesce("previous", "last_before")
    reply_to = F.coalesce("quoted_turn", previous)
    begins = F.when(reply_to.isNull() | (reply_to != previous), F.col("turn"))
    placed = numbered.join(carried, within).select(
        *blocks.columns,
        "root",
        reply_to.alias("reply_to"),
        (F.col("places_before") + F.col("row")).alias("place"),
        begins.alias("begins"),
    )
    placed = cut(placed, "turn-places")
    heads = placed.groupBy(*within).agg(F.max("begins").alias("begins"))
    heads = heads.select(*within, F.max("begins").over(earlier).alias("head_before"))
    head = F.max("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("head", head).join(heads, within)
    columns = [c for c in turns.columns if c != "quoted_turn"]
    return out.select(*columns, "reply_to", "place", "root", F.coalesce("head", "head_before").alias("head"))


def _hung(placed: DataFrame, heads: DataFrame, later: DataFrame) -> DataFrame:
    """What a run hangs on: conv_id, head, at (the head of the run that it quotes), depth below that.

    One reply leads to the quoted turn, the rest from turn to turn.
    """
    quoted = placed.select(
        "conv_id", F.col("turn").alias("reply_to"), F.col("head").alias("at"), F.col("place").alias("at_place")
    )
    quoted = quoted.join(later.select("conv_id", "reply_to").distinct(), ["conv_id", "reply_to"], "left_semi")
    places = heads.select("conv_id", F.col("head").alias("at"), F.col("head_place").alias("at_head_place"))
    target = salted_join(quoted, places, ["conv_id", "at"], ["reply_to"], "inner").select(
        "conv_id", "reply_to", "at", (F.col("at_place") - F.col("at_head_place") + 1).alias("depth")
    )
    linked = salted_join(later, target, ["conv_id", "reply_to"], ["head"], "inner")
    return linked.select("conv_id", "head", "at", "depth")


def depths(placed: DataFrame) -> DataFrame:
    """Stored ``runs`` with depth: the number of replies between a turn and the root of its conversation.

    Within a run the depth grows by one a turn, so only the heads of runs are traced to the root, by doubling pointers
    until all have arrived. A round joins those still under way with the heads.
    """
    heads = placed.filter("head = turn").select("conv_id", "reply_to", "head", F.col("place").alias("head_place"))
    heads = cut(heads, "run-heads")
    later = heads.filter("reply_to IS NOT NULL")
    first = heads.filter("reply_to IS NULL").select("conv_id", "head", F.col("head").alias("at"), F.lit(0).cast("long"))
    done = first.toDF("conv_id", "head", "at", "depth")
    active = cut(_hung(placed, heads, later), "heads") if later.limit(1).count() else done.limit(0)
    for _ in range(ROUNDS):
        if active.limit(1).count() == 0:
            break
        ahead = done.withColumn("arrived", F.lit(True)).unionByName(active.withColumn("arrived", F.lit(False)))
        ahead = ahead.toDF("conv_id", "at", "next_at", "next_depth", "arrived")
        moved = salted_join(active, ahead, ["conv_id", "at"], ["head"], "inner").select(
            "conv_id",
            "head",
            F.col("next_at").alias("at"),
            (F.col("depth") + F.col("next_depth")).alias("depth"),
            "arrived",
        )
        moved = cut(moved, "heads")
        done = done.unionByName(moved.filter("arrived").drop("arrived"))
        active = moved.filter("NOT arrived").drop("arrived")
    else:
        raise RuntimeError(f"quotations of quotations of more than 2 ** {ROUNDS} messages")
    known = done.drop("at").withColumnRenamed("depth", "head_depth").join(heads.drop("reply_to"), ["conv_id", "head"])
    joined = salted_join(placed, known, ["conv_id", "head"], ["turn"], "inner")
    depth = (F.col("head_depth") + F.col("place") - F.col("head_place")).alias("depth")
    return joined.select(*[c for c in placed.columns if c not in ("place", "head")], depth)


def conversations(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) in reply order: conv_id, turn, role, reply_to, root, depth, n_quoted,
    n_linked, chat.

    Sorted by conversation and turn, so every message comes after the one it replies to; a conversation is a run of rows,
    however long. ``root`` is its first turn, ``depth`` the number of replies from there. ``chat`` is the role's marker
    and the words without quotations; quotations that were not said before are left out as well, ``n_quoted`` and
    ``n_linked`` tell how many there are. A null text is empty and a null role is ``unknown``. Repeated rows of a turn
    each get a row and link as one message. Rows without a conv_id or turn link to nothing and have null links.
    """
    known = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = known.select("conv_id", "turn").distinct().join(reply_links(known), ["conv_id", "turn"], "left")
    turns = turns.fillna(0, ["n_quoted", "n_linked"])
    placed = depths(cut(runs(turns), "replies"))
    role = F.coalesce("role", F.lit("unknown"))
    chat = F.concat(F.lit("<|"), role, F.lit("|>\n"), body_of(F.col("text"))).alias("chat")
    rows = messages.select("conv_id", "turn", "role", chat).join(placed, ["conv_id", "turn"], "left")
    columns = ["conv_id", "turn", "role", "reply_to", "root", "depth", "n_quoted", "n_linked", "chat"]
    return rows.select(*columns).orderBy("conv_id", "turn")


def digests(messages: DataFrame) -> DataFrame:
    """Per message its place in the conversation and a digest of its formatted words."""
    rows = conversations(messages)
    return rows.select(*[c for c in rows.columns if c != "chat"], F.sha2("chat", 256).alias("chat_sha256"))


SQL = rf"""
WITH RECURSIVE x AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS s
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), l AS (SELECT rid, conv_id, turn, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM x),
m AS (
  SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '{MARKS}', 0), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(translate(regexp_replace(line, '{MARKS}', ''), '{UPPER}', '{UPPER.lower()}'),
      '[\x20\x09-\x0D]+', ' ', 'g')) AS said FROM l
), b AS (
  SELECT *, CASE WHEN said <> '' AND lag(said) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS opens
  FROM m WINDOW w AS (PARTITION BY rid ORDER BY i)
), g AS (SELECT *, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS p FROM b),
a AS (
  SELECT conv_id, turn, level, string_agg(said, ' ' ORDER BY i) AS said, list(said) AS parts
  FROM g WHERE said <> '' GROUP BY rid, conv_id, turn, level, p
), u AS (
  SELECT DISTINCT conv_id, turn, level, said, unnest(list_concat(parts,
    string_split(regexp_replace(said, '{SENTENCE_END}', '\1' || chr(10), 'g'), chr(10)))) AS unit FROM a
), o AS (SELECT conv_id, unit, min(turn) AS first_turn FROM u WHERE level = 0 GROUP BY 1, 2),
k AS (
  SELECT u.conv_id, u.turn, u.level, u.said, max(CASE WHEN o.first_turn < u.turn THEN o.first_turn END) AS t
  FROM u LEFT JOIN o ON u.conv_id = o.conv_id AND u.unit = o.unit WHERE u.level > 0 GROUP BY 1, 2, 3, 4
), n AS (
  SELECT conv_id, turn, count(*) AS n_quoted, count(t) AS n_linked,
    (list(t ORDER BY level, t DESC) FILTER (WHERE t IS NOT NULL))[1] AS quoted FROM k GROUP BY 1, 2
), c AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM (SELECT DISTINCT conv_id, turn FROM x)
), p AS (
  SELECT c.conv_id, c.turn, coalesce(quoted, previous) AS reply_to, coalesce(n_quoted, 0) AS n_quoted,
    coalesce(n_linked, 0) AS n_linked FROM c LEFT JOIN n ON c.conv_id = n.conv_id AND c.turn = n.turn
), r AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM p WHERE reply_to IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, r.root, r.depth + 1 FROM p JOIN r ON p.conv_id = r.conv_id AND p.reply_to = r.turn
)
SELECT v.conv_id, v.turn, v.role, p.reply_to, r.root, r.depth, p.n_quoted, p.n_linked,
  sha256('<|' || coalesce(v.role, 'unknown') || '|>' || chr(10) || trim(array_to_string(list_filter(
    string_split(coalesce(v.text, ''), chr(10)), lambda x: NOT regexp_matches(x, '{MARKS}')), chr(10)),
    ' ' || chr(9) || chr(13) || chr(10))) AS chat_sha256
FROM conversations v LEFT JOIN p ON v.conv_id = p.conv_id AND v.turn = p.turn
  LEFT JOIN r ON v.conv_id = r.conv_id AND v.turn = r.turn
"""
