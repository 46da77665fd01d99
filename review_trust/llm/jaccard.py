"""N-gram Jaccard join: a size-aware heavy-light join over the shingle sets of documents.

Sets are compared once each, whatever the number of documents that have them; a set is known by a digest.

* Light sets (fewer shingles than a boundary) are linked by enumeration: two sets of sizes a and b are linked exactly if
  they share a subset of as many shingles as the threshold asks of those sizes, so every set lists its subsets of each
  such size and equal subsets meet in an aggregate. No set is compared with another.
* Heavy sets are linked by scanning inverted lists. All shingles are put in one order: by hash, with those that a sample
  of documents shows to be frequent last (the sample decides on the order only, never on a result). Two linked sets
  share a shingle within the first ``n - ceil(t n) + 1`` of each, so only these are listed; a list is cut by size, since
  linked sets differ little in size, and members that cannot reach the threshold from their place in the list leave it.
  Lists that have the same smallest member form a bundle. Within a bundle the lists are scanned to count how many of
  these first shingles any two sets share, which bounds their whole overlap; the sets that pass bring all their
  shingles and are scanned again, which gives the exact overlap.
* The boundary is where enumerating subsets is expected to cost as much as scanning lists, from the histogram of small
  sizes and the mean length of the lists.

A bundle with more shingles than ``BLOCK_SHINGLES`` is split into blocks. Its members are compared with its smallest one
first, and what is connected by that, in any bundle, is a core. Only pairs of which one is outside the core of their
bundle are left to compare, so a large group of near copies takes work in proportion to its members. Every pair of
blocks that has such pairs is a task of its own. Tasks hand on links that connect what is linked within them, never all
pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import broadcast_if_small, groups, leave_out, text_key
from review_trust.llm.components import FEW_EDGES, components
from review_trust.llm.shingles import HASH_BITS, shingles, texts_words
from review_trust.sources.artifacts import cut

# What the operator takes if nothing else is asked for.
SHINGLE_WORDS = 4
# Linked if 100 * intersection >= percent * union.
PERCENT = 85
# Sets of at most this size may be enumerated; the boundary lies at or below it.
LIGHT_MAX = 20
# One document in SAMPLE shows which shingles are frequent: at least SAMPLE_HITS of the sampled ones have them.
SAMPLE = 16
SAMPLE_HITS = 4
# The most frequent shingles that are put last; others keep their place, which costs time but changes no result.
FREQUENT = 100_000
# Shingles that a task of a bundle holds per block: 8 bytes each.
BLOCK_SHINGLES = 1 << 21

_LAST = np.int64(1 << HASH_BITS)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Shingles that linked sets of sizes a and b share at least."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of size n every set that is linked to it shares one of."""
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes of sets that can be linked to one of size n."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def _ordered(text_shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Shingles as sorted numbers whose order puts the frequent ones last."""
    if not len(frequent) or not len(text_shingles):
        return text_shingles
    at = np.minimum(np.searchsorted(frequent, text_shingles), len(frequent) - 1)
    return np.sort(np.where(frequent[at] == text_shingles, text_shingles + _LAST, text_shingles))


def _texts(batch: pa.RecordBatch, shingle_words: int) -> Iterator[np.ndarray]:
    for words in texts_words(batch.column("text").cast(pa.binary()).to_pylist()):
        yield shingles(words, shingle_words)


def _node(text_shingles: np.ndarray) -> int:
    """A 64-bit digest of a set; sets that differ are told apart up to some billions of them."""
    return int.from_bytes(hashlib.blake2b(text_shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def frequent_shingles(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """The most frequent shingles of a sample of documents: at most FREQUENT numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _texts(batch, shingle_words):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["shingle"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))
    top = counts.filter(F.col("n") >= SAMPLE_HITS).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    return np.sort(top.select("shingle").toArrow().column("shingle").to_numpy().astype(np.int64))


def document_sets(docs: DataFrame, frequent: np.ndarray, shingle_words: int, percent: int) -> DataFrame:
    """Per row: doc_id, doc, n (size), node (digest; null if empty), its first shingles, and all of them if few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_texts(batch, shingle_words))
            ordered = [_ordered(f, frequent) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("doc"),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([_node(f) if len(f) else None for f in found], pa.int64()),
                    _lists([o[: prefix_length(len(o), percent)] if len(o) else o for o in ordered]),
                    _lists([o if len(o) <= LIGHT_MAX else o[:0] for o in ordered]),
                ],
                ["doc_id", "doc", "n", "node", "first", "light"],
            )

    source = docs.select("doc_id", text_key(F.col("text")).alias("doc"), "text")
    schema = "doc_id bigint, doc bigint, n bigint, node bigint, first array<bigint>, light array<bigint>"
    return source.mapInArrow(run, schema)


def whole_sets(docs: DataFrame, frequent: np.ndarray, shingle_words: int) -> DataFrame:
    """Per row: node and all its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_texts(batch, shingle_words))
            ordered = _lists([_ordered(f, frequent) for f in found])
            nodes = pa.array([_node(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, ordered], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node bigint, shingles array<bigint>")


# Light sets -----------------------------------------------------------------------------------------------------------


def subset_sizes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, shared shingles) for every size that a set of size n can be linked to."""
    sizes = [(min(n, m), max(n, m), needed(n, m, percent)) for m in partners(n, percent) if m]
    return [s for s in sizes if s[2] <= s[0]]


def boundary(costs: dict[int, tuple[int, int]], list_length: float) -> int:
    """The size from which scanning lists is cheaper than enumerating subsets.

    ``costs`` has, for every size, how many subsets and how many first shingles all sets of that size list.
    """

    def cost(limit: int) -> float:
        light = sum(subsets for n, (subsets, _) in costs.items() if n < limit)
        return light + sum(first * list_length for n, (_, first) in costs.items() if n >= limit)

    return min(range(1, LIGHT_MAX + 2), key=cost)


def light_links(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links (u, v) between sets of fewer than ``limit`` shingles, from equal subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, light in zip(batch.column("node").to_pylist(), batch.column("light").to_pylist()):
                n, keys, smaller, larger = len(light), [], [], []
                for lo, hi, k in subset_sizes(n, percent):
                    if hi >= limit:
                        continue
                    for subset in combinations(light, k):
                        raw = np.array([lo, hi, *subset], np.int64).tobytes()
                        keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                        smaller.append(n == lo)
                        larger.append(n == hi)
                nodes = np.full(len(keys), node, np.int64)
                flags = [pa.array(smaller, pa.bool_()), pa.array(larger, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(nodes), *flags], ["key", "node", "smaller", "larger"]
                )

    light = sets.filter((F.col("n") > 0) & (F.col("n") < limit)).select("node", "light").dropDuplicates(["node"])
    listed = light.mapInArrow(run, "key binary, node bigint, smaller boolean, larger boolean")
    # All sets of the smaller size are linked to all of the larger one, so a star connects what is linked.
    shared = listed.groupBy("key").agg(
        F.min("node").alias("u"),
        F.max("node").alias("_max"),
        F.max("smaller").alias("smaller"),
        F.max("larger").alias("larger"),
    )
    shared = shared.filter("u <> _max AND smaller AND larger").select("key", "u")
    return listed.join(shared, "key").select("u", F.col("node").alias("v")).filter("u <> v").distinct()


# Heavy sets -----------------------------------------------------------------------------------------------------------


def _reaches(a: Column, b: Column, overlap: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (a + b)


def bundles(postings: DataFrame, percent: int) -> DataFrame:
    """Members of the lists, gathered by the smallest member: pivot, size class, node, n.

    ``postings`` has shingle, node, n, i (place among the node's shingles), for shingles with two nodes at least.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
    listed = postings.withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    rest = F.col("n") - F.col("i")
    for _ in range(2):  # members that leave may take the last chance of others
        best = listed.groupBy("shingle", "class").agg(
            F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.max(rest).alias("_rest"), F.min("n").alias("_n")
        )
        best = best.filter("_lo <> _hi")
        listed = listed.join(best, ["shingle", "class"])
        able = _reaches(F.col("n"), F.col("_n"), F.least(rest, F.col("_rest")), percent)
        listed = listed.filter(able).select(*postings.columns, "class")
    pivots = listed.groupBy("shingle", "class").agg(F.min("node").alias("pivot"), F.max("node").alias("_hi"))
    pivots = pivots.filter("pivot <> _hi").drop("_hi")
    return listed.join(pivots, ["shingle", "class"]).select("pivot", "class", "node", "n").distinct()


def _blocks(size: Column) -> Column:
    """How many blocks the members of a bundle need."""
    return F.ceil(F.coalesce(F.sum(size), F.lit(0)) / BLOCK_SHINGLES).cast("int")


def large_bundles(members: DataFrame, size: Column) -> DataFrame:
    """Bundles that take more than one block: pivot, class, blocks; at most one for BLOCK_SHINGLES shingles."""
    return members.groupBy("pivot", "class").agg(_blocks(size).alias("blocks")).filter("blocks > 1")


def in_blocks(members: DataFrame, size: Column) -> DataFrame:
    """Members once per pair of blocks (x, y) of their bundle that they belong to, with their own block.

    Members with ``core`` are connected already: their blocks, numbered after the others, meet no other core block.
    """
    key = ["pivot", "class"]
    totals = members.groupBy(*key).agg(
        _blocks(F.when(~F.col("core"), size)).alias("outer"), _blocks(F.when(F.col("core"), size)).alias("inner")
    )
    placed = members.join(totals, key)
    own = F.when(F.col("core"), F.col("outer") + F.pmod(F.xxhash64("node"), F.greatest("inner", F.lit(1))))
    own = F.coalesce(own, F.pmod(F.xxhash64("node"), F.greatest("outer", F.lit(1)))).cast("int")
    met = F.when(F.col("core"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    other = placed.withColumn("block", own).filter(met > 0)
    other = other.withColumn("_other", F.explode(F.sequence(F.lit(0), met - 1)))
    return other.select(
        *members.columns,
        "block",
        F.least("block", "_other").alias("x"),
        F.greatest("block", "_other").alias("y"),
    )


def with_pivot(members: DataFrame, size: Column, large: DataFrame) -> DataFrame:
    """Members of ``large`` bundles, each in one block (x), with the bundle's smallest member in every one (first)."""
    placed = members.join(broadcast_if_small(large), ["pivot", "class"])
    first = F.col("node") == F.col("pivot")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return placed.select(*members.columns, first.alias("first"), F.explode(F.when(first, every).otherwise(one)).alias("x"))


def pivot_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the smallest member of a bundle with others, from ``with_pivot`` and all ``shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None
        for batch in batches:
            us, vs = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("pivot", "class", "x")))
            for own, node, held in zip(keys, batch.column("node").to_pylist(), batch.column("shingles")):
                held = np.asarray(held.values)
                if own != key:
                    key, first = own, held
                    continue
                at = np.minimum(np.searchsorted(first, held), len(first) - 1)
                common = np.count_nonzero(first[at] == held)
                if (100 + percent) * common >= percent * (len(first) + len(held)):
                    us.append(own[0])
                    vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    rows = members.repartition("pivot", "class", "x").sortWithinPartitions("pivot", "class", "x", F.desc("first"))
    return rows.mapInArrow(run, "u bigint, v bigint")


def _overlaps(arrays: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For every array in turn, how many of its numbers each of the arrays holds, from inverted lists."""
    values = np.concatenate(arrays)
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for a in arrays:
        lo, hi = np.searchsorted(values, a, "left"), np.searchsorted(values, a, "right")
        lengths = hi - lo
        if not len(a):
            yield np.zeros(len(arrays), np.int64)
            continue
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(lo, lengths)
        yield np.bincount(owner[at], minlength=len(arrays))


def _numpy_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in column]


def _group_columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    nodes, sizes = group.column("node").to_numpy(), group.column("n").to_numpy()
    return nodes, sizes, group.column("block").to_numpy(), group.column("x")[0].as_py() == group.column("y")[0].as_py()


_KEYS = ["pivot", "class", "x", "y"]


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node")


def survivors(members: DataFrame, percent: int) -> DataFrame:
    """Members (with ``first``) that share enough first shingles with another one: pivot, class, node, n.

    Up to the smaller of both sets' last listed shingle their overlap is known; beyond it they share at most what is
    left of either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, _KEYS):
            nodes, sizes, block, same = _group_columns(group)
            first = _numpy_lists(group.column("first"))
            last = np.array([f[-1] for f in first])
            listed = np.array([len(f) for f in first])
            passed = np.zeros(len(nodes), bool)
            for i, common in enumerate(_overlaps(first)):
                known = np.searchsorted(first[i], last, "right")
                bound = common + np.minimum(sizes[i] - known, sizes - listed)
                ok = (last <= last[i]) & ((100 + percent) * bound >= percent * (sizes[i] + sizes))
                ok &= (block != block[i]) | same
                ok[i] = False
                if ok.any():
                    passed |= ok
                    passed[i] = True
            if passed.any():
                kept = group.select(["pivot", "class", "node", "n"]).filter(pa.array(passed))
                yield from kept.combine_chunks().to_batches()

    return _grouped(members).mapInArrow(run, "pivot bigint, class bigint, node bigint, n bigint").distinct()


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among members (with ``shingles``) of a bundle: enough of them to connect all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, _KEYS):
            nodes, sizes, block, same = _group_columns(group)
            label = np.arange(len(nodes))
            us, vs = [], []
            for i, common in enumerate(_overlaps(_numpy_lists(group.column("shingles")))):
                ok = (100 + percent) * common >= percent * (sizes[i] + sizes)
                ok &= (block != block[i]) | same
                ok[i] = False
                new = np.unique(label[ok])
                for other in new[new != label[i]].tolist():
                    j = int(np.flatnonzero(ok & (label == other))[0])
                    us.append(nodes[i])
                    vs.append(nodes[j])
                    label[label == other] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return _grouped(members).mapInArrow(run, "u bigint, v bigint").distinct()


def links(docs: DataFrame, sets: DataFrame, frequent: np.ndarray, shingle_words: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes that connect all linked sets; ``sets`` is the stored result of ``document_sets``."""
    filled = sets.filter("n > 0")
    listed = filled.select("node", "n", F.posexplode("first").alias("i", "shingle"))
    lengths = listed.groupBy("shingle").agg(
        F.min("node").alias("_lo"),
        F.max("node").alias("_hi"),
        F.count("*").alias("c"),
        F.min("n").alias("_n"),
        F.max("n").alias("_m"),
        F.min(F.col("n") - F.col("i")).alias("_rest"),
    )
    # In a list of two sets both sizes and places are known here: most of them can't be linked.
    able = (F.col("c") > 2) | _reaches(F.col("_n"), F.col("_m"), F.col("_rest"), percent)
    shared = cut(lengths.filter((F.col("_lo") != F.col("_hi")) & able).select("shingle", "c"), "shared-shingles")
    mean = shared.agg(F.avg("c")).first()[0] or 1.0
    small = filled.filter(F.col("n") <= LIGHT_MAX).groupBy("n").agg(F.count_distinct("node").alias("c")).collect()
    costs = {
        r.n: (r.c * sum(math.comb(r.n, k) for _, _, k in subset_sizes(r.n, percent)), r.c * prefix_length(r.n, percent))
        for r in small
    }
    limit = boundary(costs, mean)
    light = light_links(sets, limit, percent)

    # Sets just below the boundary are listed as well, for their links across it. 8 bytes a row.
    heavy = listed.filter(F.col("n") >= -(-percent * limit // 100))
    postings = heavy.join(broadcast_if_small(shared.select("shingle"), 1_000_000), "shingle").distinct()
    members = cut(bundles(postings, percent), "bundles")
    n_first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    of_nodes = filled.select("node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def whole(nodes: DataFrame) -> DataFrame:
        ids = broadcast_if_small(cut(of_nodes.join(nodes, "node", "left_semi").select("doc_id"), "verified"), 2_000_000)
        texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
        return whole_sets(texts, frequent, shingle_words).dropDuplicates(["node"])

    large = cut(large_bundles(members, n_first), "large-bundles")
    known, cores = light, None
    if large.limit(1).count():
        crowd = cut(with_pivot(members, n_first, large), "crowds")
        stars = pivot_links(crowd.join(whole(crowd.select("node").distinct()), "node"), percent)
        stars = cut(stars.distinct(), "pivot-links")
        known, cores = light.unionByName(stars), cut(components(stars), "cores")

    def marked(rows: DataFrame) -> DataFrame:
        """``rows`` of bundles with core: connected with the smallest member of their bundle."""
        if cores is None:
            return rows.withColumn("core", F.lit(False))
        small = broadcast_if_small(cores, 1_000_000)
        of_node = small.withColumnsRenamed({"id": "node", "component": "_own"})
        of_pivot = small.withColumnsRenamed({"id": "pivot", "component": "_its"})
        core = F.coalesce(F.col("_own") == F.col("_its"), F.lit(False))
        joined = rows.join(of_node, "node", "left").join(of_pivot, "pivot", "left")
        return joined.select(*rows.columns, core.alias("core"))

    first = filled.select("node", "first")
    wanted = broadcast_if_small(cut(members.select("node").distinct(), "bundled"), 2_000_000)
    first = first.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    blocks = in_blocks(marked(members), n_first)
    passed = cut(survivors(blocks.join(first, "node"), percent), "survivors")
    blocks = in_blocks(marked(passed), F.col("n"))
    exact = exact_links(blocks.join(whole(passed.select("node").distinct()), "node"), percent)
    return known.unionByName(exact)


def similar_documents(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, doc, n_shingles, component_id.

    Documents are linked if their shingles of ``shingle_words`` words have a similarity of ``percent`` percent at least.

    The component is the smallest doc_id that links reach. Texts without words have no shingles and link
    nothing. Rows without a doc_id are linked with nothing either and have a null component; rows that repeat a doc_id
    are one document that has the links of all of them, and each gets a row. ``doc`` is a hash of the text.
    """
    known = docs.filter("doc_id IS NOT NULL")
    frequent = frequent_shingles(known, shingle_words)
    sets = cut(document_sets(docs, frequent, shingle_words, percent), "shingle-sets")
    with_id = sets.filter("doc_id IS NOT NULL")
    node_ids = cut(with_id.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id")), "set-ids")
    found = cut(links(known, with_id, frequent, shingle_words, percent), "links")
    # Few links go to the sets instead of being shuffled with them, twice.
    few = found.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    for end, own in (("u", "a"), ("v", "b")):
        ids = node_ids.withColumnsRenamed({"node": end, "id": own})
        found = (F.broadcast(found) if few else found).join(ids, end)
    # A doc_id with several texts ties their sets together.
    several = with_id.groupBy("doc_id").agg(
        F.min("node").alias("_lo"),
        F.max("node").alias("_hi"),
        F.count("node").alias("_filled"),
        F.count("*").alias("_rows"),
    )
    # Stored, so that fewer scans start at once: the driver makes a buffer of 4 MB for each stage and each scan.
    several = cut(several.filter("_lo <> _hi OR (_filled > 0 AND _filled < _rows)").select("doc_id"), "several-texts")
    tied = with_id.join(broadcast_if_small(several, FEW_EDGES), "doc_id", "left_semi")
    tied = tied.join(node_ids, "node").filter("id <> doc_id")
    ends = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = components(ends.unionByName(tied.select(F.col("id").alias("u"), F.col("doc_id").alias("v"))))
    labelled = node_ids.join(nodes, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    # Stored, so that the join shuffles it by itself and may split the copies of one set among tasks. 16 bytes a row.
    columns = ["doc_id", "doc", "n", "component"]
    filled = sets.filter("n > 0").join(broadcast_if_small(cut(labelled, "set-components")), "node", "left")
    # A text without words goes with the other texts of its doc_id.
    empty = sets.filter("n = 0").join(nodes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    joined = filled.select(*columns).unionByName(empty.select(*columns))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "doc", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_smallest(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all their columns stay."""
    similar = similar_documents(docs, shingle_words, percent)
    extra = similar.filter("component_id < doc_id").select("doc_id").distinct()
    return leave_out(docs, cut(extra, "near-duplicates"))
