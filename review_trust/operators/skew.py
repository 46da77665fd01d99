"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_trust.sources.artifacts import cut

# Rows of one key that a task should get at most; a key with more is spread over as many salts as that takes.
TARGET_ROWS = 1_000_000

# Largest id set that is broadcast: rows, and bytes of the ids besides some for each row.
BROADCAST_IDS = 1_000_000
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 32


def key_bytes(key: str) -> Column:
    """Bytes of a key, to be summed up."""
    return F.octet_length(F.col(key).cast("string"))


def fits_broadcast(ids: DataFrame, key: str, n_ids: int, n_bytes: int | None = None) -> bool:
    """True if a table of ``n_ids`` rows is small in rows and in the bytes of its ``key``, counted if not given."""
    if n_ids > BROADCAST_IDS:
        return False
    if n_bytes is None:
        n_bytes = ids.agg(F.sum(key_bytes(key))).first()[0] or 0
    return n_bytes + n_ids * ROW_BYTES <= BROADCAST_BYTES


def hot_keys(rows: DataFrame, on: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Every key of more than ``TARGET_ROWS`` rows with its number of salts, so that no salt has many more rows.

    ``counts`` (the keys and ``n``) saves counting where the caller knows them. There are at most
    rows / TARGET_ROWS such keys.
    """
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / TARGET_ROWS).cast("int").alias("_salts")
    return counts.filter(F.col("n") > TARGET_ROWS).select(*on, salts)


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join review-level ``rows`` with a ``table`` that has one row per key.

    Rows of a hot key are spread over its salts by the hash of their ``spread``
    columns, and the table rows of those keys are repeated once per salt; every
    other key joins as usual.
    """
    on = list(on)
    hot = cut(hot_keys(rows, on, counts), "hot-keys")
    if hot.count() <= BROADCAST_IDS:
        hot = F.broadcast(hot)
    n_salts = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*spread), n_salts).cast("int")
    left = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    right = table.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n_salts - 1))).drop("_salts")
    joined = left.join(right, [*on, "_salt"], how).drop("_salt")
    return joined.select(*rows.columns) if how == "left_semi" else joined


def semi_join_ids(
    rows: DataFrame,
    ids: DataFrame,
    key: str,
    n_ids: int,
    spread: Sequence[str],
    counts: DataFrame | None = None,
    n_bytes: int | None = None,
) -> DataFrame:
    """Keep the rows whose ``key`` is in ``ids``: broadcast while the set is small, else salted."""
    ids = ids.select(key)
    if fits_broadcast(ids, key, n_ids, n_bytes):
        return rows.join(F.broadcast(ids), key, "left_semi").select(*rows.columns)
    return salted_join(rows, ids, [key], spread, "left_semi", counts)
