"""Periodic runs: stretches of words that repeat a root three times or more, found by Lyndon roots.

A run's root has, in the order of the words or in the reverse order, a rotation that is the longest Lyndon word where it
starts. So both Lyndon arrays hold a root of every run:

* Baier grouping. The first phase of the linear-time suffix sorter keeps suffixes in ordered groups, each with the
  beginning its suffixes share. Groups are taken from the largest to the smallest; a suffix that is the nearest smaller
  one to the left of some suffixes of the group goes up into a new group behind its own, and its beginning grows by
  theirs. When a group is taken, the beginning of its suffixes is the longest Lyndon word there: the array falls out
  without a second phase. The phase runs once for each order.
* Extension. A root at ``i`` of ``p`` words reaches as far to the right as the words from ``i`` and ``i + p`` agree, and
  likewise to the left. These common extensions are found by halving, with hashes of all prefixes, for all roots at
  once; every run found is then compared word by word, so the hashes decide nothing.

Texts are mostly free of runs. Every part of a run of a third of the shortest length occurs twice within the run, so
only stretches in which all such parts occur twice are looked at, and all others hold no run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 24
MIN_PERIODS = 3  # fixed: the search for stretches relies on it

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

Run = tuple[int, int, int]  # start, length, period


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place, by Baier's grouping of suffixes."""
    n = len(symbols)
    sorted_places = sorted(range(n), key=symbols.__getitem__)
    place_of = [0] * n  # where a suffix is in sorted_places
    group = [0] * n  # a suffix's group, known by the place of its first member
    size, known = [0] * n, [1] * n  # of a group: members, and words of the beginning they share
    start = 0
    for at, i in enumerate(sorted_places):
        if symbols[i] != symbols[sorted_places[start]]:
            start = at
        place_of[i], group[i] = at, start
        size[start] += 1
    left = list(range(-1, n - 1))  # no suffix between left[i] and i is in a smaller group than those still to be taken
    lengths = [0] * n
    end = n
    while end:
        start = group[sorted_places[end - 1]]
        shared = known[start]
        smaller: dict[int, int] = {}
        for i in sorted_places[start:end]:
            lengths[i] = shared
            p = left[i]
            while p >= 0 and group[p] >= start:
                p = left[p]
            while left[i] != p:
                left[i], i = p, left[i]
            if p >= 0:
                smaller[p] = smaller.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in smaller.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (times, old), members in sorted(moves.items()) if len(moves) > 1 else moves.items():
            new = old + size[old]
            grown = known[old] - times * shared
            for j in members:
                new -= 1
                other, at = sorted_places[new], place_of[j]
                sorted_places[at], place_of[other] = other, at
                sorted_places[new], place_of[j] = j, new
            for j in members:
                group[j] = new
            size[old], size[new] = new - old, len(members)
            known[new] = grown
        end = start
    return lengths


class _Prefixes:
    """Hashes of all prefixes, to compare parts of a sequence; equal parts never differ in hash."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        spread = (words.astype(np.uint64) + np.uint64(1)) * _SPREAD
        spread ^= spread >> np.uint64(29)
        self.powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * self.powers[:n])))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the parts of ``length`` from a and from b agree, for a <= b."""
        first = (self.sums[a + length] - self.sums[a]) * self.powers[b - a]
        return first == self.sums[b + length] - self.sums[b]

    def extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How far the words from a and from b (a < b) agree to the right, or for step -1 before a and b to the left."""
        most = self.n - b if step > 0 else a
        low = np.zeros(len(a), np.int64)
        bit = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while bit:
            length = low + bit
            fits = np.flatnonzero(length <= most)
            back = length[fits] if step < 0 else 0
            good = fits[self.equal(a[fits] - back, b[fits] - back, length[fits])]
            low[good] += bit
            bit >>= 1
        return low


def _reach(words: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """First word of, and first word behind, the stretch around i in which words p apart agree, word by word."""
    start, end = i, i + p
    while end < len(words) and words[end] == words[end - p]:
        end += 1
    while start and words[start - 1] == words[start - 1 + p]:
        start -= 1
    return start, end


def _runs_of(words: np.ndarray, min_words: int) -> set[Run]:
    """All runs of a sequence of numbers."""
    n = len(words)
    at = np.arange(n)
    orders = [lyndon_lengths(order.tolist()) for order in (words, words.max() - words)]
    i, p = np.divmod(np.unique(np.concatenate([at * (n + 1) + lengths for lengths in orders])), n + 1)
    hashes = _Prefixes(words)
    # Of three periods or more around a root one is whole to the right of it, or to the left.
    right, left = np.flatnonzero(i + 2 * p <= n), np.flatnonzero(i >= p)
    right = right[hashes.equal(i[right], i[right] + p[right], p[right])]
    left = left[hashes.equal(i[left] - p[left], i[left], p[left])]
    keep = np.union1d(right, left)
    if not len(keep):
        return set()
    i, p = i[keep], p[keep]
    start = i - hashes.extend(i, i + p, -1)
    end = i + p + hashes.extend(i, i + p, 1)
    long = end - start >= np.maximum(min_words, MIN_PERIODS * p)
    roots = {(s, e, q): r for s, e, q, r in zip(*(c[long].tolist() for c in (start, end, p, i)))}
    out = set()
    for (s, e, q), root in roots.items():
        whole = np.array_equal(words[s : e - q], words[s + q : e])
        ends = (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == n or words[e] != words[e - q])
        if not (whole and ends):  # hashes met by chance
            s, e = _reach(words, root, q)
        if e - s >= max(min_words, MIN_PERIODS * q):
            out.add((s, e - s, q))
    return out


def _stretches(words: np.ndarray, size: int, least: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of at least ``least`` words all of whose parts of ``size`` words occur twice within them."""
    todo = [(0, len(words))]
    while todo:
        first, end = todo.pop()
        if end - first < least:
            continue
        part = words[first:end].astype(np.uint64) * _SPREAD
        part ^= part >> np.uint64(31)
        hashes = np.zeros(end - first - size + 1, np.uint64)
        for k in range(size):
            hashes = hashes * _BASE + part[k : k + len(hashes)]
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        twice = np.zeros(len(hashes) + 2, bool)
        twice[order[1:][same] + 1] = True
        twice[order[:-1][same] + 1] = True
        if twice[1:-1].all():
            yield first, end
            continue
        starts = np.flatnonzero(twice[1:] & ~twice[:-1])
        ends = np.flatnonzero(twice[:-1] & ~twice[1:])
        todo += [(first + a, first + b + size - 1) for a, b in zip(starts.tolist(), ends.tolist())]


def find_runs(words: list[bytes], min_words: int = MIN_WORDS) -> list[Run]:
    """All runs of a text by start and period."""
    if len(words) < min_words:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return []
    numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out: set[Run] = set()
    for first, end in _stretches(numbers, max(1, min_words // MIN_PERIODS), min_words):
        part = np.unique(numbers[first:end], return_inverse=True)[1]
        out |= {(first + s, n, p) for s, n, p in _runs_of(part, min_words)}
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words less those of any run behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def repeat_end(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """What the contract of the query makes of a text: the end of one in ten repeats; without a doc_id none does."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapse_runs(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its runs (start, length, period) and its words without their repeats.

    Words are separated by ASCII white space; ``collapsed`` joins those that stay by one space. A run has at least
    ``min_words`` words and three periods. A null, empty or blank text has no words and no runs. Rows are independent,
    so repeated rows come out alike. ``rewrite`` changes the words of a document before they are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            ids = batch.column("doc_id")
            for doc_id, text in zip(ids.to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                words = rewrite(doc_id, words) if rewrite else words
                runs.append([dict(zip(("start", "length", "period"), r)) for r in find_runs(words, min_words)])
                texts.append(b" ".join(collapse(words, [tuple(r.values()) for r in runs[-1]])))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, columns)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the run of greatest exponent and digests of the runs and the collapsed text."""
    found = collapse_runs(docs, rewrite=repeat_end)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start and period, so the first of equal exponents stays.
    best = F.aggregate(
        "runs",
        none,
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    exponent = F.call_function("div", F.col("best.length") * 1000, F.col("best.period"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        exponent.alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
