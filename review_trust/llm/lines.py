"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of descending doc_id. A batch's distinct line hashes are merge-anti-joined with the runs
there are: hashes that no run knows are new, and the batch's largest doc_id that holds such a line keeps it; hashes that
are known only add to the count of documents. Both go into the batch's own run. When a level has ``fanout`` runs they
are compacted into one run of the next level. Runs are tables bucketed and sorted by hash, so that neither the
anti-joins nor the compactions move them, and superseded runs are dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import BLANKS, broadcast_if_small, field, text_key
from review_trust.sources.artifacts import cut, scratch_path

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2

_BLANKS = BLANKS.encode()


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased (bytes.lower() leaves all other bytes alone)."""
    return line.strip(_BLANKS).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars or len(key) >= 4 * min_chars:
        return len(key) >= min_chars
    return len(key.decode("utf-8", "replace")) >= min_chars


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per document and distinct long key: doc_id, doc (hash of the text), h, positions of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            hashes: list[bytes] = []
            positions: list[list[int]] = []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                at: dict[bytes, list[int]] = {}
                for p, line in enumerate((text or b"").split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        at.setdefault(hashlib.md5(key).digest(), []).append(p)
                rows += [i] * len(at)
                hashes += at
                positions += at.values()
            at_rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at_rows),
                    batch.column("doc").take(at_rows),
                    pa.array(hashes, pa.binary()),
                    pa.array(positions, pa.list_(pa.int32())),
                ],
                ["doc_id", "doc", "h", "positions"],
            )

    source = docs.select("doc_id", text_key(F.col("text")).alias("doc"), "text")
    return source.mapInArrow(run, "doc_id bigint, doc bigint, h binary, positions array<int>")


class LineRuns:
    """The levelled runs; each has the columns h, n (documents) and keeper (doc_id that keeps the line, if new here)."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _store(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch (doc_id, h) with the runs and add its own run."""
        own = batch.select("doc_id", "h").distinct()
        own = own.groupBy("h").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        new = F.lit(True)
        for i, name in enumerate(n for level in self.levels for n in level):
            known = self.spark.table(name).select("h", F.lit(True).alias(f"known{i}"))
            own = own.join(known, "h", "left")
            new = new & F.col(f"known{i}").isNull()
        self._push(self._store(own.select("h", "n", F.when(new, F.col("keeper")).alias("keeper"))), 0)

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(self._compact(old), level + 1)

    def _compact(self, names: list[str]) -> str:
        merged = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select("h", F.col("n").alias("n2"), F.col("keeper").alias("keeper2"))
            merged = merged.join(other, "h", "full_outer").select(
                "h",
                (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"),
                F.coalesce("keeper", "keeper2").alias("keeper"),
            )
        stored = self._store(merged)
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        return stored

    def close(self) -> DataFrame:
        """Everything in one run, as a stored table of the lines of at least two documents; drops the runs."""
        left = [n for level in self.levels for n in level]
        last = left[0] if len(left) == 1 else self._compact(left)
        shared = cut(self.spark.table(last).filter("n > 1"), "shared-lines")
        self.spark.sql(f"DROP TABLE {last}")
        return shared


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``docs`` (doc_id, text and others) with repeated long lines dropped, plus ``n_lines`` and ``n_dropped``.

    ``text`` is replaced by the lines that stay. A null text is one empty line and comes out empty. Rows of equal doc_id
    are one document: it counts once, and all of them keep a line if theirs is the largest doc_id. A null doc_id is
    smaller than any other and counts as no document. Columns n_lines and n_dropped of the input are replaced.
    """
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return _deduped(docs, others, min_chars, min_docs, batches, counted=True)


def keep_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with repeated long lines dropped from ``text`` as by ``dedup_lines``, all other columns as they are."""
    return _deduped(docs, docs.columns, min_chars, min_docs, batches, counted=False)


def _deduped(
    docs: DataFrame, others: list[str], min_chars: int, min_docs: int, batches: int, counted: bool
) -> DataFrame:
    spark = docs.sparkSession
    cuts = [
        c
        for c in docs.select(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 1000))
        .first()[0]
        or []
    ]
    batch = F.lit(len(cuts))
    for i, c in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > c, i).otherwise(batch)
    hashes = line_hashes(docs, min_chars).withColumn("batch", batch)
    path = scratch_path(spark, "line-hashes")
    hashes.write.partitionBy("batch").parquet(path)
    schema = "doc_id bigint, doc bigint, h binary, positions array<int>, batch int"
    hashes = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark)
    for i in range(len(cuts) + 1):
        runs.add(hashes.filter(F.col("batch") == i))
    repeated = runs.close().filter(F.col("n") >= min_docs).select("h", "keeper")
    # 24 bytes a row.
    losers = hashes.join(broadcast_if_small(repeated), "h").filter(
        F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    )
    drops = losers.groupBy("doc_id", "doc").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("_drop"))
    drops = drops.withColumnsRenamed({"doc_id": "_id", "doc": "_doc"}).hint("shuffle_hash")
    mine = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_doc"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.transform("_drop", lambda p: p + 1))
    text = F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda p: F.element_at("_lines", p)), "\n")
    )
    # Other columns are packed while the rows are joined, so none of their names can clash.
    carried = [c for c in others if c not in ("doc_id", "text")]
    row = [F.struct(*[field(c) for c in carried]).alias("_row")] if carried else []
    joined = docs.select("doc_id", "text", *row).join(drops, mine, "left").withColumn("_lines", lines)
    counts = [
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    ]
    done = joined.select("doc_id", text.alias("text"), *counts, *(["_row"] if carried else []))
    columns = [F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in others]
    return done.select(*columns, *(["n_lines", "n_dropped"] if counted else []))


def digests(docs: DataFrame) -> DataFrame:
    """Per document its number of lines, how many were dropped, and a digest of the rest."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), k AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < r.keeper, false) AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
