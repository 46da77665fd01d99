"""SimHash near-dedup by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits; bit by bit the majority of its shingles' XXH64 decides. Two fingerprints link if they
differ in at most two bits. They are found by keys, not by comparing all pairs:

* The 64 bits are three segments of 21, 21 and 22 bits, each a word of 23 bits for the perfect binary Golay code. Every
  such word lies within three errors of exactly one codeword, its nearest; a word at three errors lies at four errors
  of five more. Decoding a segment gives the indices of these one or six codewords.
* Two errors leave at least one segment whole, and of the three ways to pair a segment with the next one there is one
  with the first whole and at most one error in the second. Words one error apart share an index that is the nearest of
  at least one of them: if they have one nearest codeword it is that; if not, each lies four errors from the other's.
* So a key is a segment's number, its bits and an index of the next segment. Fingerprints that are nearest to a key are
  joined with all that have it, and the bits of every pair are compared.

A key that many fingerprints have is not joined: there, fingerprints that reach the same bits by changing at most one
outside the whole segment differ in two at most, and any two that differ in two reach such bits. These meet in an
aggregate, at most 44 at a time, so the work grows with the number of fingerprints, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import broadcast_if_small
from review_trust.llm.components import components
from review_trust.sources.artifacts import cut

SHINGLE_WORDS = 3
SEED = 42  # fixed value of the shingle hash
MAX_BITS = 2  # what the keys are made for

# First bit and number of bits of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
# The generator polynomial of the Golay code, the length of its words and of its remainders.
GENERATOR, WORD_BITS, CHECK_BITS = 0b110001110101, 23, 11
INDEX_BITS = WORD_BITS - CHECK_BITS
# A key of more fingerprints than this is handled by single changed bits instead of a join.
CROWD = 64
# Shingles whose bits are counted at once: 64 bytes each.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> bytes:
    """The 64-bit SimHash of a text, most significant byte first; zero for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    line = b" ".join(words)
    ends = ends[size - 1 :] or ends[-1:]  # fewer words than a shingle are one
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(ends), CHUNK):
        hashes = b"".join(digest(line[a:b], SEED) for a, b in zip(starts[at:], ends[at : at + CHUNK]))
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(ends)).tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a bigint, of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = b"".join(fingerprint(t, size) for t in batch.column("text").to_pylist())
            values = np.frombuffer(marks, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


class Golay:
    """Syndrome decoding of 23-bit words to the codewords within three errors, or four where three are needed."""

    def __init__(self) -> None:
        remainders, r = [], 1
        for _ in range(WORD_BITS):
            remainders.append(r)
            r <<= 1
            r ^= GENERATOR if r >> CHECK_BITS else 0
        self.low, self.high = (self._sums(remainders[i : i + INDEX_BITS]) for i in (0, INDEX_BITS))
        errors: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
        for weight in range(5):
            for bits in combinations(range(WORD_BITS), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= remainders[b]
                if weight < 4 or sum(map(int, f"{errors[syndrome][0]:b}")) == 3:
                    errors[syndrome].append(sum(1 << b for b in bits))
        # One row per syndrome: the nearest codeword's error pattern, then the five of weight four or -1.
        self.errors = np.array([e + [-1] * (6 - len(e)) for e in errors], np.int64)

    @staticmethod
    def _sums(remainders: list[int]) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for r in remainders:
            table = np.concatenate((table, table ^ r))
        return table

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Six columns per word: the index of its nearest codeword, then those at four errors or -1."""
        syndromes = self.low[words & ((1 << INDEX_BITS) - 1)] ^ self.high[words >> INDEX_BITS]
        errors = self.errors[syndromes]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)


def golay_keys(prints: DataFrame) -> DataFrame:
    """``prints`` (fp) with its keys: key, home (the index is that of the nearest codeword), segment, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            bits = fp.view(np.uint64)
            parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for j, whole in enumerate(parts):
                index = golay.indices(parts[(j + 1) % len(parts)])
                rows, columns = np.nonzero(index >= 0)
                key = (np.int64(j) << 40) | (whole[rows] << INDEX_BITS) | index[rows, columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(columns == 0), pa.array(np.full(len(rows), j, np.int32)), pa.array(fp[rows])],
                    ["key", "home", "segment", "fp"],
                )

    return prints.select("fp").mapInArrow(run, "key bigint, home boolean, segment int, fp bigint")


def crowded_links(members: DataFrame) -> DataFrame:
    """Links (u, v) among ``members`` (segment, fp) that have the bits of that segment in common."""
    ways = F.lit(None).cast("array<bigint>")
    for j, (at, n) in enumerate(SEGMENTS):
        masks = [0, *(1 << b for b in range(64) if not at <= b < at + n)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        ways = F.when(F.col("segment") == j, F.array(*[F.lit(m).cast("bigint") for m in signed])).otherwise(ways)
    reached = members.select("segment", "fp", F.explode(ways).alias("change"))
    met = reached.groupBy("segment", F.col("fp").bitwiseXOR(F.col("change")).alias("bits")).agg(
        F.collect_list("fp").alias("near")  # bounded: one per change, so 44 at most
    )
    pairs = met.filter(F.size("near") > 1).select(F.array_min("near").alias("u"), F.explode("near").alias("v"))
    return pairs.filter("u <> v").distinct()


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (u, v) that connect all distinct fingerprints of ``prints`` (fp) which differ in at most two bits."""
    keys = cut(golay_keys(prints), "golay-keys")
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    shared = cut(keys.join(counts.filter("n > 1 AND homes > 0"), "key"), "shared-keys")
    few = shared.filter(F.col("n") <= crowd)
    homes = few.filter("home").select("key", F.col("fp").alias("u"))
    pairs = homes.join(few.select("key", F.col("fp").alias("v")), "key").filter(
        (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    )
    met = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    many = shared.filter(F.col("n") > crowd).select("segment", "fp").distinct()
    return met.unionByName(crowded_links(many))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, crowd: int = CROWD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, others are ignored): doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that links lead to. A null or blank text has the fingerprint zero and links
    like any other. Rows that repeat a doc_id are one document with the links of all their texts. A null doc_id links,
    but is nobody's smallest: a component of such rows only has a null id. ``crowd`` never changes the result.
    """
    rows = cut(fingerprints(docs, size), "fingerprints")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    texts = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("_v"))
    torn = cut(texts.filter("u <> _v").drop("_v"), "repeated-ids")
    tied = rows.join(broadcast_if_small(torn), "doc_id").select("u", F.col("fp").alias("v"))
    stars = components(links(prints, crowd).unionByName(tied))
    roots = stars.select(F.col("component").alias("fp"), "component").distinct()
    linked = stars.select(F.col("id").alias("fp"), "component").unionByName(roots)
    known = cut(linked.join(prints, "fp"), "linked-prints")
    smallest = known.groupBy("component").agg(F.min("first").alias("smallest"))
    named = known.join(smallest, "component").select("fp", "smallest")
    alone = prints.join(known.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("smallest"))
    out = rows.join(cut(named.unionByName(alone), "named-prints"), "fp")
    mark = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", mark, F.col("smallest").alias("component_id"))
