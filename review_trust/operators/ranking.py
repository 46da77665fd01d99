"""Top-K items per user by cosine similarity, plain and weighted by item trust."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_trust.functions.vectors import SCORE_DIGITS, matrix, unit_rows
from review_trust.operators.skew import fits_broadcast, salted_join
from review_trust.schema import BASELINE, ITEM, TRUST, USER
from review_trust.sources.artifacts import Scratch, cut, removable

# Item vectors up to this size are broadcast; larger catalogues are broadcast in blocks of this size, one by one.
BROADCAST_BYTES = 64 << 20
ID_BYTES = 64
# Groups of similar items that are skipped together, and cells they come from.
TILE_ITEMS = 4096
MAX_CELLS = 4096
# Users x items scored at a time inside a task, and items among them: 1 MB of float32, which stays in a core's cache.
CHUNK_SCORES = 1 << 18
CHUNK_ITEMS = 512
# Pairs scored again at a time.
CHUNK_PAIRS = 1 << 16

_CANDIDATES = f"variant string, {USER} string, {ITEM} string, score double"


def item_trust(reviews: DataFrame, trust: DataFrame) -> DataFrame:
    """Mean trust of an item's reviews; a reviewer without a score counts as fully trusted.

    A small score table is broadcast to the reviews. Beyond that, reviews are
    counted per (user, item) first, so that the salted join sees each pair once.
    """
    scores = trust.select(USER, "trust_score")
    if fits_broadcast(scores, USER, scores.count()):
        scored = reviews.select(USER, ITEM, F.lit(1).alias("n")).join(F.broadcast(scores), USER, "left")
    else:
        pairs = cut(reviews.groupBy(USER, ITEM).agg(F.count("*").alias("n")), "pairs")
        scored = salted_join(pairs, scores, [USER], [ITEM])
    weighted = F.sum(F.coalesce("trust_score", F.lit(1.0)) * F.col("n"))
    return scored.groupBy(ITEM).agg((weighted / F.sum("n")).alias("item_trust_factor"))


class _Tile(NamedTuple):
    """Items of one cell in id order, with what bounds their similarity to a user."""

    order: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    trust: np.ndarray
    center: np.ndarray
    cosine: float  # of the widest angle between the center and a vector
    best_trust: float


def _tile(rows: pa.Table) -> _Tile:
    vectors = unit_rows(matrix(rows.column("profile")))
    center = unit_rows(vectors.sum(axis=0, keepdims=True))[0]
    trust = rows.column("item_trust_factor").to_numpy()
    ids = rows.column(ITEM).to_numpy(zero_copy_only=False)
    cosine = float(np.clip((vectors @ center).min(), -1.0, 1.0))
    return _Tile(rows.column("order").to_numpy(), ids, vectors, trust, center, cosine, float(trust.max()))


def _tiles(block: pa.Table) -> list[_Tile]:
    block = block.sort_by([("tile", "ascending"), ("order", "ascending")])
    number = block.column("tile").to_numpy()
    bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
    return [_tile(block.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])]


class _Best:
    """The best ``k`` items so far of a batch of users, for one variant; empty places have a score of -inf.

    A user's row has room for more: it fills up in any order and is settled when it is full.
    """

    def __init__(self, n_users: int, k: int):
        self.k, self.width = k, 3 * k + 4
        self._scores = np.full((n_users, self.width), -np.inf)
        self._order = np.full((n_users, self.width), np.iinfo(np.int64).max)
        self.filled = np.zeros(n_users, np.int64)
        self.loose = np.zeros(n_users, bool)  # not settled since the last addition
        # What a score must reach to matter; rounding may still lift it by one unit of the last digit.
        self.least = np.full(n_users, -np.inf)

    @property
    def scores(self) -> np.ndarray:
        self.settle(np.flatnonzero(self.loose))
        return self._scores[:, : self.k]

    @property
    def order(self) -> np.ndarray:
        self.settle(np.flatnonzero(self.loose))
        return self._order[:, : self.k]

    def load(self, batch: pa.RecordBatch, variant: str) -> None:
        size = pc.list_value_length(batch.column(f"{variant}_order")).to_numpy()
        rows = np.repeat(np.arange(len(size)), size)
        places = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        for name, into in (("score", self._scores), ("order", self._order)):
            into[rows, places] = batch.column(f"{variant}_{name}").flatten().to_numpy(zero_copy_only=False)
        self.filled = size.astype(np.int64)
        self.settle(np.arange(len(size)))

    def add(self, users: np.ndarray, scores: np.ndarray, tile: _Tile) -> None:
        """Take in the rounded scores of some pairs: one row each for places in ``users``, in order, columns of the tile and scores."""
        rows, order, values = users[scores[0].astype(np.int64)], tile.order[scores[1].astype(np.int64)], scores[2]
        while len(rows):
            own, first, n = np.unique(rows, return_index=True, return_counts=True)
            place = np.arange(len(rows)) + np.repeat(self.filled[own] - first, n)
            fits = place < self.width
            self._scores[rows[fits], place[fits]] = values[fits]
            self._order[rows[fits], place[fits]] = order[fits]
            self.filled[own] = np.minimum(self.filled[own] + n, self.width)
            self.loose[own] = True
            some = (self.filled[own] >= self.k) & np.isneginf(self.least[own])
            self.settle(own[some | (self.filled[own] == self.width)])
            left = ~fits & (values >= self.least[rows])
            rows, values, order = rows[left], values[left], order[left]

    def settle(self, users: np.ndarray) -> None:
        """Leave the best ``k`` in the rows of ``users``, in order."""
        if not len(users):
            return
        scores, order = self._scores[users], self._order[users]
        by_id = np.argsort(order, axis=1, kind="stable")
        by_score = np.argsort(-np.take_along_axis(scores, by_id, axis=1), axis=1, kind="stable")[:, : self.k]
        chosen = np.take_along_axis(by_id, by_score, axis=1)
        kept = np.full_like(scores, -np.inf), np.full_like(order, np.iinfo(np.int64).max)
        for old, new, into in zip((scores, order), kept, (self._scores, self._order)):
            new[:, : self.k] = np.take_along_axis(old, chosen, axis=1)
            into[users] = new
        self.filled[users] = np.minimum(self.filled[users], self.k)
        self.loose[users] = False
        self.least[users] = kept[0][:, self.k - 1] - 2.0 * 10.0**-SCORE_DIGITS

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, place, score and order of every user's best items."""
        scores, order = self.scores, self.order
        rows, places = np.nonzero(scores > -np.inf)
        return rows, places, scores[rows, places], order[rows, places]


def _cosines(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Similarity of pairs, row by row, not below 0."""
    return np.maximum(np.einsum("ij,ij->i", users, items), 0.0)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest score of each row, NaN left out."""
    own = np.where(np.isnan(scores), -np.inf, scores)
    return np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k]


def _limits(
    scores: np.ndarray, tile: _Tile, best: dict[str, _Best], users: np.ndarray, slack: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a rough score, off by less than ``slack``, must reach to change the best items: of both variants, and what a
    similarity must reach to change either.

    ``scores`` are those of the tile's first items.
    """
    k, trust = best[BASELINE].k, tile.trust[: scores.shape[1]]
    limits = []
    for variant, off in ((BASELINE, slack), (TRUST, slack * max(1.0, float(np.abs(tile.trust).max())))):
        limit = best[variant].least[users] - off
        short = np.flatnonzero(np.isneginf(limit))
        if len(short) and len(trust) > k:  # without k items yet: what is below the best k of these stays out
            own = np.maximum(scores[short], 0.0)
            limit[short] = _kth(own * trust if variant == TRUST else own, k) - 2.0 * (off + 10.0**-SCORE_DIGITS)
        limits.append(limit)
    # No trust factor is above the best, so a weighted score of ``limit`` takes a similarity of limit / best.
    plain, trusted = limits
    within = trusted / tile.best_trust if tile.best_trust > 0 else np.full(len(users), np.inf)
    within = np.where(trusted > 0, within, -np.inf)
    return plain, trusted, (np.minimum(plain, within) - 2.0**-22).astype(np.float32)


def _score_tiles(vectors: np.ndarray, tiles: list[_Tile], best: dict[str, _Best]) -> None:
    """Score a batch of users against tiles, leaving out those that cannot change a user's best items.

    No item of a tile is nearer to the user than the tile's center less its widest angle. Single precision tells which
    pairs may be among the best, within twice the bound on its error; only those are scored, in double precision.
    """
    if not len(vectors):
        return
    rough = vectors.astype(np.float32)
    slack = (vectors.shape[1] + 16) * 2.0**-23
    centers = np.clip(vectors @ np.stack([t.center for t in tiles]).T, -1.0, 1.0)
    inside = np.array([t.cosine for t in tiles])
    across = np.sqrt(1.0 - centers**2) * np.sqrt(1.0 - inside**2)
    reach = np.where(centers >= inside, 1.0, centers * inside + across) + 1e-9
    reach = np.maximum(reach, 0.0)
    # Used for each product: new memory would take as long as the product itself.
    room = np.empty(max(CHUNK_SCORES, CHUNK_ITEMS), np.float32)
    for t in np.argsort(-reach.mean(axis=0)):
        tile = tiles[t]
        trusted = np.maximum(reach[:, t] * tile.best_trust, 0.0)
        users = np.flatnonzero((reach[:, t] >= best[BASELINE].least) | (trusted >= best[TRUST].least))
        items = tile.vectors.astype(np.float32)
        step = max(1, CHUNK_SCORES // min(CHUNK_ITEMS, len(items)))
        for first in range(0, len(users), step):
            some = users[first : first + step]
            left, limits, found = rough[some], None, []
            for at in range(0, len(items), CHUNK_ITEMS):
                right = items[at : at + CHUNK_ITEMS]
                scores = room[: len(left) * len(right)].reshape(len(left), len(right))
                np.matmul(left, right.T, out=scores)
                if limits is None:
                    limits = _limits(scores, tile, best, some, slack)
                plain, trusted, either = limits
                rows = np.flatnonzero(~(np.maximum(scores.max(axis=1), 0.0) < either))
                if len(rows):
                    near = np.maximum(scores[rows], 0.0)
                    pairs = np.flatnonzero(near >= either[rows, None])
                    row, column = np.divmod(pairs, len(right))
                    row, column, near = rows[row], at + column, near.ravel()[pairs]
                    kept = (near >= plain[row]) | (near * tile.trust[column] >= trusted[row])
                    found.append((row[kept], column[kept]))
            _add_pairs(vectors, tile, best, some, found)


def _add_pairs(
    vectors: np.ndarray, tile: _Tile, best: dict[str, _Best], users: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]
) -> None:
    """Score pairs of places in ``users`` and in the tile in double precision and take them in."""
    if not found:
        return
    row, column = (np.concatenate(x) for x in zip(*found))
    by_user = np.argsort(row, kind="stable")
    row, column = row[by_user], column[by_user]
    for at in range(0, len(row), CHUNK_PAIRS):
        r, c = row[at : at + CHUNK_PAIRS], column[at : at + CHUNK_PAIRS]
        exact = _cosines(vectors[users[r]], tile.vectors[c])
        for variant, b in best.items():
            values = np.round(exact * tile.trust[c] if variant == TRUST else exact, SCORE_DIGITS) + 0.0
            kept = values >= b.least[users[r]]
            b.add(users, np.stack((r[kept], c[kept], values[kept])), tile)


_STATE = ", ".join(
    f"{variant}_{name} array<{kind}>"
    for variant in (BASELINE, TRUST)
    for name, kind in (("score", "double"), ("order", "bigint"), ("id", "string"))
)


class _Names:
    """The ids of the items of some tiles, by ``order``."""

    def __init__(self, tiles: list[_Tile]):
        order = np.concatenate([t.order for t in tiles])
        places = np.argsort(order)
        self.order = order[places]
        self.ids = pa.array(np.concatenate([t.ids for t in tiles])[places], pa.string())

    def of(self, rows: np.ndarray, order: np.ndarray, batch: pa.RecordBatch, variant: str) -> pa.Array:
        """The ids of the best items of a batch; those of earlier tiles stand in the batch."""
        at = np.minimum(np.searchsorted(self.order, order), len(self.order) - 1)
        old = np.flatnonzero(self.order[at] != order)
        if not len(old):
            return self.ids.take(pa.array(at))
        lists = batch.column(f"{variant}_order")
        size = pc.list_value_length(lists).to_numpy()
        known, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        keys = np.repeat(np.arange(len(size)), size) * len(known) + place
        by_key = np.argsort(keys)
        wanted = rows[old] * len(known) + np.searchsorted(known, order[old])
        at[old] = len(self.order) + by_key[np.searchsorted(keys, wanted, sorter=by_key)]
        return pa.concat_arrays([self.ids, batch.column(f"{variant}_id").flatten().cast(pa.string())]).take(pa.array(at))


def _rank_broadcast(users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Every task holds all item vectors; users are neither shuffled nor repeated."""
    table = items.toArrow().sort_by(ITEM)
    table = table.append_column("order", pa.array(np.arange(len(table))))
    tiles = users.sparkSession.sparkContext.broadcast(
        [_tile(table.slice(at, TILE_ITEMS)) for at in range(0, len(table), TILE_ITEMS)]
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names(tiles.value)
        for batch in batches:
            best = {variant: _Best(batch.num_rows, k) for variant in (BASELINE, TRUST)}
            _score_tiles(unit_rows(matrix(batch.column("profile"))), tiles.value, best)
            yield from _listed(batch, best, names)

    return users.mapInArrow(rank, _CANDIDATES + ", rank int")


def _blocks(items: Scratch, n_items: int, dim: int, block_bytes: int) -> tuple[Scratch, int]:
    """The items in cells of similar ones, cut into tiles and these packed into blocks: ``order``, ``tile``, ``block``.

    The centers of the cells are items picked by a hash, at most ``MAX_CELLS``; they decide what is skipped, not what is
    found. ``order`` grows with the id. Each table is removed when the next one is written.
    """
    spark, table = items.spark, items.table
    n_cells = min(MAX_CELLS, math.ceil(math.sqrt(n_items) / 4))
    picked = table.orderBy(F.xxhash64(ITEM), ITEM).limit(n_cells).select("profile").toArrow()  # at most MAX_CELLS rows
    centers = spark.sparkContext.broadcast(unit_rows(matrix(picked.column("profile"))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit_rows(matrix(batch.column("profile")))
            cells = (vectors @ centers.value.T).argmax(axis=1) if len(vectors) else np.zeros(0)
            columns = [*batch.columns, pa.array(cells.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell"])

    ordered = table.repartitionByRange(ITEM).sortWithinPartitions(ITEM).withColumn("order", F.monotonically_increasing_id())
    kinds = f"{ITEM} string, profile array<double>, item_trust_factor double, `order` bigint, cell int"
    celled = removable(ordered.mapInArrow(nearest, kinds), "cells")
    items.remove()
    centers.destroy()
    rows = max(1, block_bytes // (dim * 8 + ID_BYTES))
    place, block, filled, n_tiles = [], 0, 0, 0
    for cell, n in celled.table.groupBy("cell").count().orderBy("cell").collect():  # at most MAX_CELLS rows
        parts = math.ceil(n / min(rows, TILE_ITEMS))
        for part in range(parts):
            size = math.ceil(n / parts)
            if filled and filled + size > rows:
                block, filled = block + 1, 0
            place.append((cell, part, parts, n_tiles, block))
            filled, n_tiles = filled + size, n_tiles + 1
    places = spark.createDataFrame(place, "cell int, part int, parts int, tile int, block int")
    parts = F.broadcast(places.select("cell", "parts").distinct())
    part = F.pmod(F.xxhash64(ITEM), F.col("parts")).cast("int").alias("part")
    spread = celled.table.join(parts, "cell").select(*celled.table.columns, part)
    placed = spread.join(F.broadcast(places.drop("parts")), ["cell", "part"]).drop("cell", "part")
    if block:  # a round reads the folders of its blocks only
        placed = placed.repartition("block")
    blocks = removable(placed, "blocks", ("block",))
    celled.remove()
    return blocks, block + 1


def _rank_in_rounds(users: Scratch, items: Scratch, n_items: int, dim: int, k: int, block_bytes: int) -> DataFrame:
    """Exact top-K for catalogues too large to broadcast at once.

    Blocks of items are broadcast one after the other. Users stay where they are: a round reads them with their best
    items so far and writes both again, so what moves is every item once to every executor, whatever the number of
    users. A batch of users skips the tiles that cannot change its best items. What a round has read is removed.
    """
    context = users.spark.sparkContext
    blocks, n_blocks = _blocks(items, n_items, dim, block_bytes)
    state = users

    def round_of(tiles: Broadcast, first: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = _Names(tiles.value)
            for batch in batches:
                best = {variant: _Best(batch.num_rows, k) for variant in (BASELINE, TRUST)}
                if not first:
                    for variant, b in best.items():
                        b.load(batch, variant)
                _score_tiles(unit_rows(matrix(batch.column("profile"))), tiles.value, best)
                if last:
                    yield from _listed(batch, best, names)
                    continue
                arrays = [batch.column(USER), batch.column("profile")]
                for variant, b in best.items():
                    rows, _, scores, order = b.listed()
                    ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
                    found = (pa.array(scores), pa.array(order), names.of(rows, order, batch, variant))
                    arrays += [pa.ListArray.from_arrays(ends, values) for values in found]
                yield pa.RecordBatch.from_arrays(arrays, [USER, "profile", *(c.split()[0] for c in _STATE.split(", "))])

        return run

    for block in range(n_blocks):
        last = block == n_blocks - 1
        # About block_bytes: a hash deals the items of a large cell to its tiles.
        tiles = context.broadcast(_tiles(blocks.table.filter(F.col("block") == block).toArrow()))
        kinds = f"{_CANDIDATES}, rank int" if last else f"{USER} string, profile array<double>, {_STATE}"
        after = state.table.mapInArrow(round_of(tiles, block == 0, last), kinds)
        if last:
            blocks.remove()
            return after
        old, state = state, Scratch(after, "best-items")
        old.remove()
        tiles.destroy()
    raise AssertionError("no block")


def _listed(batch: pa.RecordBatch, best: dict[str, _Best], names: _Names) -> Iterator[pa.RecordBatch]:
    for variant, b in best.items():
        rows, places, scores, order = b.listed()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([variant] * len(rows), pa.string()),
                batch.column(USER).take(pa.array(rows)),
                names.of(rows, order, batch, variant),
                pa.array(scores),
                pa.array((places + 1).astype(np.int32)),
            ],
            names=["variant", USER, ITEM, "score", "rank"],
        )


def rank_items(
    user_profiles: DataFrame,
    item_profiles: DataFrame,
    trust_factors: DataFrame,
    top_k: int = 10,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Both rankings of ``top_k`` items per user as (variant, user, rank, item, score).

    The score is the cosine of the profiles, not below 0; the ``trust`` variant
    multiplies it by the item's trust factor, 1.0 where there is none. Items a
    user has already reviewed stay in. Equal scores rank by item id. Item vectors of more than ``broadcast_bytes`` are
    broadcast in blocks of ``block_bytes``, with the same result.
    """
    stored = removable(
        item_profiles.join(trust_factors, ITEM, "left").select(
            ITEM,
            F.col("profile").cast("array<double>").alias("profile"),
            F.coalesce("item_trust_factor", F.lit(1.0)).alias("item_trust_factor"),
        ),
        "items",
    )
    users = user_profiles.select(USER, F.col("profile").cast("array<double>").alias("profile"))
    n_items, dim = stored.table.agg(F.count("*"), F.max(F.size("profile"))).first()
    if not n_items:
        ranked = stored.spark.createDataFrame([], _CANDIDATES + ", rank int")
    elif n_items * (dim * 8 + ID_BYTES) <= broadcast_bytes:
        ranked = _rank_broadcast(users, stored.table, top_k)
    else:
        ranked = _rank_in_rounds(removable(users, "users"), stored, n_items, dim, top_k, block_bytes)
    return ranked.select("variant", USER, "rank", ITEM, "score")
