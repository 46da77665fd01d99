"""Stored tables: step outputs that are built once, and scratch tables that cut lineage."""

from __future__ import annotations

import hashlib
import json
import logging
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

# Packs texts that lie near their copies, which Spark's default looks for in 64 KiB only.
COMPRESSION = "zstd"
# Long texts that many rows share are stored once a file up to this size in all, not the default of 1 MiB; beyond it
# they are written out row by row.
DICTIONARY_BYTES = 16 << 20


def exists(spark: SparkSession, path: str) -> bool:
    """True if a finished table lies at ``path`` (on whatever file system the path names)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def files_of(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of every file at ``path`` (which may hold wildcards), in order; hidden files are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for top in system.globStatus(place) or []:
        files = system.listFiles(top.getPath(), True)
        while files.hasNext():
            file = files.next()
            if not file.getPath().getName().startswith(("_", ".")):
                found.append([file.getPath().toString(), file.getLen(), file.getModificationTime()])
    return sorted(found)


def recorded(spark: SparkSession, path: str) -> dict:
    """What the table at ``path`` was built from, as ``materialize`` has noted it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run the step that builds it first")
    if not exists(spark, f"{path}.parameters"):
        raise ValueError(f"{path} has no record of what it was built from: remove it")
    return json.loads(spark.read.text(f"{path}.parameters").first()[0])


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    metrics: Mapping[str, str] | None = None,
    partition_by: tuple[str, ...] = (),
    parameters: Mapping[str, object] | None = None,
    upstream: Sequence[str] = (),
    inputs: Sequence[str] = (),
    check: Callable[[Mapping[str, object]], None] | None = None,
) -> DataFrame:
    """Read the table at ``path``; build and write it first if it is not there yet.

    ``metrics`` are SQL aggregates observed by the write job itself, so a step
    summary costs no extra pass; they are stored beside the table. ``check``
    is given them and may raise, in which case the table counts as unfinished.

    A record of what the table was built from lies beside it too: its
    ``parameters``, the records of the tables ``upstream`` and the names, sizes
    and times of the files ``inputs``, as digests. So it covers all that is
    upstream; a table with another record, or with none, is refused.
    """
    record = {
        "parameters": dict(parameters or {}),
        "upstream": {name.rsplit("/", 1)[-1]: _digest(recorded(spark, name)) for name in upstream},
        "inputs": {name: _digest(files_of(spark, name)) for name in inputs},
    }
    if exists(spark, path):
        found, wanted = recorded(spark, path), json.loads(json.dumps(record))
        if found != wanted:
            other = sorted(k for k in wanted if found.get(k) != wanted[k])
            built = f"{path} was built with other {', '.join(other)}: {found}, not {wanted}"
            raise ValueError(f"{built}; remove it or use another folder")
        logger.info("%s exists, step skipped", path)
        return spark.read.parquet(path)
    df = build()
    observation = None
    if metrics:
        observation = Observation(path)
        df = df.observe(observation, *[F.expr(e).alias(n) for n, e in metrics.items()])
    _note(spark, f"{path}.parameters", record)
    packed = {"compression": COMPRESSION, "parquet.dictionary.page.size": DICTIONARY_BYTES}
    df.write.mode("overwrite").partitionBy(*partition_by).options(**packed).parquet(path)
    if observation is not None:
        summary = observation.get
        logger.info("%s written: %s", path, summary)
        _note(spark, f"{path}.summary", summary)
        if check:
            try:
                check(summary)
            except Exception:
                remove(spark, f"{path}/_SUCCESS")
                raise
    return spark.read.parquet(path)


def summary_of(spark: SparkSession, path: str) -> dict:
    """The metrics that were observed when the table at ``path`` was written."""
    return json.loads(spark.read.text(f"{path}.summary").first()[0]) if exists(spark, f"{path}.summary") else {}


def _digest(record: object) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()


def _note(spark: SparkSession, path: str, value: object) -> None:
    line = json.dumps(value, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder on this machine: on a
    cluster the other executors could not read it.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="review-trust-"))
        shared = context.getCheckpointDir()
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder per application."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a scratch table, in folders by ``partition_by``, and read it back.

    The result has no lineage to recompute when an executor is lost, is pruned
    by column like any Parquet table, and has known file sizes for planning.
    """
    return Scratch(df, name, partition_by).table


def removable(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> Scratch:
    """``cut``, with the means to remove the table."""
    return Scratch(df, name, partition_by)


def cut_by_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """``cut`` in buckets by ``key``: aggregates by the key, or by it and more, and joins on it then shuffle nothing.

    All rows of a key lie in one bucket, which one task reads.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    written = df.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", COMPRESSION)
    written.option("path", path).saveAsTable(table)
    return spark.table(table)


class Scratch:
    """A scratch table that can be removed once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.partitionBy(*partition_by).option("compression", COMPRESSION).parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        remove(self.spark, self.path)
