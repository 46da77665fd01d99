"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings, safe to set on a session somebody else has built.
RUNTIME_CONF = {
    # Epoch milliseconds are read as UTC wall-clock time.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Vector rows are wide: keep Arrow batches to a few thousand rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # A shuffle's files go when the query that wrote them ends, not when the driver next collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Good and malformed lines go to their two folders as they are read, without a sort of the wide rows.
    "spark.sql.maxConcurrentOutputFileWriters": "2",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # Small tables are read in as many splits as there are cores, without a shuffle.
    spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "review-trust") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
