"""Reviews derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from review_trust.schema import ITEM, USER
from review_trust.sources.artifacts import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables up to this size are dealt to all cores where a query does heavy work on each row.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, path: str) -> DataFrame:
    """Give every core work on a small table that lies in fewer splits than there are cores.

    What moves is bounded by ``SPREAD_BYTES`` whatever the cluster: a larger table is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return df.repartition(cores) if size <= SPREAD_BYTES else df


def reviews(
    spark: SparkSession,
    sf_dir: str,
    *,
    text: bool = False,
    text_length: bool = False,
    text_md5: bool = False,
    embedding: bool = False,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """One review per line item: who ordered which part, when, and how it was rated.

    ``text`` joins the title and body in, ``text_md5`` the title and the digest
    of the body, ``text_length`` the length of the body, ``embedding`` a vector
    per review, ``vectors`` (see ``vectors``) only the ``vector_id`` of it; all
    are left out unless asked for, so a query pays only for what it reads.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = [
        F.concat(F.lit("U"), "o_custkey").alias(USER),
        F.concat(F.lit("I"), "l_partkey").alias(ITEM),
        (
            F.unix_millis(F.col("l_shipdate").cast("timestamp"))
            + F.col("l_linenumber") * 3600000
            + F.col("l_partkey") % 1000
        ).alias("timestamp"),
        (F.lit(1.0) + F.col("l_quantity").cast("int") % 5).cast("double").alias("rating"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        (F.nullif(F.col("l_linenumber"), F.lit(7)) - 1).cast("long").alias("helpful_vote"),
    ]
    if text or text_length or text_md5:
        body = F.col("text") if text else F.md5("text") if text_md5 else F.length("text")
        documents = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
        n_documents = documents.count()  # row count from the file footers
        if text:  # the reviews of a document then lie together, so that its repeated text packs well
            documents = documents.hint("merge")
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(
            documents, (F.col("l_orderkey") * 7 + F.col("l_partkey")) % n_documents == F.col("doc_id")
        )
        body = F.when(F.col("l_linenumber") != 5, F.col("body"))
        if text or text_md5:
            columns += [F.col("p_name").alias("title"), body.alias("text" if text else "text_md5")]
        else:
            columns.append(F.coalesce(body, F.lit(0)).alias("text_length"))
    if embedding or vectors is not None:
        name = "embedding" if embedding else "vector_id"
        joined = (table(spark, sf_dir, "embeddings") if embedding else vectors).select("vec_id", name)
        n_vectors = joined.count()
        df = df.join(joined, (F.col("l_partkey") * 31 + F.col("o_custkey")) % n_vectors == F.col("vec_id"))
        columns.append(F.col(name))
    return df.select(*columns)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, stored under a ``vector_id`` that no two rows share, whatever their ``vec_id``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cut(rows.withColumn("vector_id", F.monotonically_increasing_id()), "vectors")


def web_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as marked-up reviews: titles with a link and a tag, bodies of raw HTML, some of them null."""
    page = F.col("page_id")
    title = F.concat(F.lit("Visit "), "url", F.lit(" now <b>bold</b>"))
    text = F.concat("html", F.lit(" see www.x"), page, F.lit(".org/a  end"))
    return spread(table(spark, sf_dir, "pages"), f"{sf_dir}/pages.parquet").select(
        "page_id",
        F.when(page % 10 != 3, title).alias("title"),
        F.when(page % 10 != 7, text).alias("text"),
    )
