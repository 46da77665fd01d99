"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold at most this many rows; each operator states the width of its rows.
BROADCAST_ROWS = 500_000

# The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Everything that separates words of ASCII digits, ASCII letters and non-ASCII characters in lower-cased text.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; the built-in lower() would change those as well."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """The words of a text as an array, empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside other lambdas the optimizer would inline it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(count: Column) -> Column:
    """0 .. count - 1, empty if count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def text_key(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(text)


def field(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def leave_out(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone``: doc_id and, if it has it, doc (``text_key``); nulls count as equal.

    The columns of ``docs`` are packed while it is joined, so none of their names can clash.
    """
    names = ["doc_id", "doc"][: len(gone.columns)]
    packed = docs.select(
        F.struct(*[field(c) for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("own_doc_id"),
        text_key(F.col("text")).alias("own_doc"),
    )
    mine = [F.col(f"own_{c}").eqNullSafe(F.col(c)) for c in names]
    return packed.join(broadcast_if_small(gone.select(*names)), mine, "left_anti").select("row.*")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else as it is, for a shuffled join.

    ``df`` should be a stored table, whose rows are counted from file footers.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``, as one table each, from sorted batches; holds one group at a time."""
    open_rows: list[pa.Table] = []
    open_key = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            piece = table.slice(start, i - start)
            if open_rows and rows[start] != open_key:
                yield pa.concat_tables(open_rows)
                open_rows = []
            open_key = rows[start]
            if i < len(rows):
                yield pa.concat_tables([*open_rows, piece])
                open_rows = []
            else:
                open_rows.append(piece)
            start = i
    if open_rows:
        yield pa.concat_tables(open_rows)


def session(spark: SparkSession) -> SparkSession:
    """Settings the Python stages rely on: small Arrow batches, since a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark
