"""Document fingerprints: Merkle trees over sections, paragraphs and blocks of a paragraph.

A paragraph is a line; it is cut into blocks of some words where its content says so (after a sentence, or where a mix
of the last three bytes of a word hits one in sixteen), so an edit changes the blocks it touches and no others. Sections
end at an empty line or where a paragraph's hash hits one in eight. A node's hash covers its children's hashes; equal
roots mean equal texts, and two trees are compared from the root down, leaving equal branches closed.

The fingerprint is the tree as text: ``root|section;section``, a section ``hash:paragraph,paragraph``, a paragraph
``hash=leaf.leaf``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import text_key

# Documents in a block of neighbours, and blocks at most; the first document of each is copied to the block before.
BLOCK_DOCS = 1_000
MAX_BLOCKS = 20_000

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t")] = True


def _digest(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def _cuts(text: bytes) -> np.ndarray:
    """Where blocks end: after every line feed and after some blanks behind a word."""
    d = np.frombuffer(text, np.uint8)
    ends = d == 10
    if len(d) > 3:
        w = d.astype(np.uint32)
        mixed = w[2:-1] * np.uint32(0x9E3779B1) + w[1:-2] * np.uint32(0x85EBCA6B) + w[:-3] * np.uint32(0xC2B2AE35)
        hit = _STOP[d[2:-1]] | ((mixed >> np.uint32(20)) % 16 == 0)
        ends = ends.copy()
        ends[3:] |= _SPACE[d[3:]] & ~_SPACE[d[2:-1]] & hit
    return np.flatnonzero(ends) + 1


def fingerprint(text: bytes) -> str:
    """The Merkle tree of a text."""
    sections: list[str] = []
    paragraphs: list[str] = []
    leaves: list[str] = []

    def end_paragraph(empty: bool) -> None:
        mark = _digest(".".join(leaves).encode(), 8)
        paragraphs.append(f"{mark}={'.'.join(leaves)}")
        leaves.clear()
        if empty or int(mark[:2], 16) % 8 == 0:
            end_section()

    def end_section() -> None:
        mark = _digest(",".join(p.partition("=")[0] for p in paragraphs).encode(), 8)
        sections.append(f"{mark}:{','.join(paragraphs)}")
        paragraphs.clear()

    start = 0
    for end in _cuts(text).tolist():
        leaves.append(_digest(text[start:end], 4))
        if text[end - 1] == 10:
            end_paragraph(text[start:end] == b"\n" and len(leaves) == 1)
        start = end
    if start < len(text):
        leaves.append(_digest(text[start:], 4))
    if leaves:
        end_paragraph(False)
    if paragraphs:
        end_section()
    root = _digest(";".join(s.partition(":")[0] for s in sections).encode() + hashlib.sha256(text).digest(), 16)
    return f"{root}|{';'.join(sections)}"


def _children(print_: str) -> list[str]:
    body = print_.partition("|")[2]
    return body.split(";") if body else []


def _paragraphs(section: str) -> list[str]:
    return section.partition(":")[2].split(",")


def _leaves(paragraph: str) -> list[str]:
    return paragraph.partition("=")[2].split(".")


def likeness(a: str, b: str) -> float:
    """The share of blocks that two fingerprints have in common, from 0 to 1; equal roots are 1 at once.

    Sections that occur in both are counted without looking into them, then paragraphs of the other sections, then
    leaves of the other paragraphs.
    """
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    common, total = 0, (a.count("=") + a.count(".")) + (b.count("=") + b.count("."))
    left, right = Counter(_children(a)), Counter(_children(b))
    for inside in (_paragraphs, _leaves):
        same = left & right
        common += sum((node.count("=") + node.count(".")) * n for node, n in same.items())
        left, right = (Counter(x for node in side.elements() for x in inside(node)) for side in (left - same, right - same))
    common += (left & right).total()
    return 2 * common / total if total else 0.0


def first_edit(a: str, b: str) -> int | None:
    """The number of the first paragraph (from 0) in which two fingerprints differ, null if they are equal."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return None
    at = 0
    left, right = _children(a), _children(b)
    for i, section in enumerate(left):
        inside = _paragraphs(section)
        if i < len(right) and section == right[i]:
            at += len(inside)
            continue
        other = _paragraphs(right[i]) if i < len(right) else []
        same = next((k for k, p in enumerate(inside) if k >= len(other) or p != other[k]), len(inside))
        return at + same
    return at


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where two fingerprints differ: (first, end) paragraphs of ``a`` and the (first, end) of ``b`` in their place.

    Sections are aligned first and only those that differ are opened; paragraphs count from 0, and an empty range means
    that the other text has something more there. Equal fingerprints have no edits.
    """
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    left, right = ([_paragraphs(section) for section in _children(x)] for x in (a, b))
    at, to = (list(accumulate(map(len, side), initial=0)) for side in (left, right))
    found = []
    for tag, i, j, k, m in SequenceMatcher(None, _children(a), _children(b), autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        inside, other = list(chain(*left[i:j])), list(chain(*right[k:m]))
        found += [
            (at[i] + p, at[i] + q, to[k] + r, to[k] + s)
            for kind, p, q, r, s in SequenceMatcher(None, inside, other, autojunk=False).get_opcodes()
            if kind != "equal"
        ]
    return found


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` in blocks of neighbours by descending doc_id: block, ahead, doc_id, doc, text, sorted within a block.

    The first document of every block is there once more as the end (``ahead``) of the block before it, so a task finds
    the following document of each of its own.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(MAX_BLOCKS, docs.count() // BLOCK_DOCS + 1)
    ids = docs.select(F.col("doc_id").cast("double")).filter("doc_id IS NOT NULL")
    cuts = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    rows = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket").transform(rows)
    place = F.when(F.col("doc_id").isNull(), len(splits)).otherwise(len(splits) - 1 - F.col("_bucket")).cast("int")
    rows = rows.withColumn("block", place).drop("_id", "_bucket")
    order = F.struct((-F.col("doc_id")).alias("_o"), "doc")
    # One row per block, so at most MAX_BLOCKS.
    firsts = rows.groupBy("block").agg(F.min(order).alias("first")).orderBy("block").collect()
    heads = [(r.block, -r.first._o if r.first._o is not None else None, r.first.doc) for r in firsts]
    before = [heads[i - 1][0] for i in range(len(heads))]
    table = [(b, i, d, p) for (b, i, d), p in zip(heads, before)]
    head = docs.sparkSession.createDataFrame(table, "block int, _first bigint, _doc bigint, _before int")
    rows = rows.join(F.broadcast(head), "block", "left")
    leads = F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("doc") == F.col("_doc"))
    own = F.struct(F.col("block").alias("to"), F.lit(False).alias("ahead"))
    copy = F.struct(F.col("_before").alias("to"), F.lit(True).alias("ahead"))
    spread = rows.withColumn("place", F.explode(F.when(leads, F.array(own, copy)).otherwise(F.array(own))))
    spread = spread.select(F.col("place.to").alias("block"), "place.ahead", "doc_id", "doc", "text")
    return spread.repartition("block").sortWithinPartitions("block", "ahead", F.desc_nulls_last("doc_id"), "doc")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its fingerprint and that of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_edit. The
    following document is the next by descending doc_id, after the last the first; rows without a doc_id come last and
    rows that repeat one are ordered by a hash of their text. A single document follows itself. A null text is empty.
    """
    kind = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    schema = kind + "near_edited double, near_next double, first_edit bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # block, ahead, doc_id, text, fingerprint
        for batch in batches:
            made = []
            columns = [batch.column(c).to_pylist() for c in ("block", "ahead", "doc_id", "text")]
            for block, ahead, doc_id, text in zip(*columns):
                mark = fingerprint(text.encode())
                if last and last[0] == block and not last[1]:
                    made.append(_compare(last[2], last[3], last[4], text, mark))
                last = (block, ahead, doc_id, text, mark)
            yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in made], _SCHEMA)

    return in_order(docs).mapInArrow(run, schema)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("first_edit", pa.int64())]
)


def _compare(doc_id: int | None, text: str, mark: str, following: str, following_mark: str) -> tuple:
    changed = edited(text, following).encode()
    changed_mark = mark if changed == text.encode() else fingerprint(changed)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed).hexdigest(),
        mark,
        changed_mark,
        likeness(mark, changed_mark),
        likeness(mark, following_mark),
        first_edit(mark, changed_mark),
    )
