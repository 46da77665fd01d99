from pyspark.sql import functions as F

from review_trust.operators import skew


def test_hot_key_is_spread_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(skew, "TARGET_ROWS", 100)
    rows = spark.range(9000).select(
        F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("key"),
        F.col("id").alias("v"),
    )
    table = rows.select("key").distinct().filter("key != 'k7'").withColumn("w", F.length("key"))
    joined = skew.salted_join(rows, table, ["key"], ["v"])
    plain = rows.join(table, "key", "left")
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
    kept = skew.salted_join(rows, table, ["key"], ["v"], "left_semi")
    assert kept.columns == rows.columns
    assert kept.count() == rows.filter("key != 'k7'").count()


def test_every_key_above_the_target_is_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "TARGET_ROWS", 2)
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [("d",)], "key string")
    assert {r.key: r._salts for r in skew.hot_keys(rows, ["key"]).collect()} == {"a": 3, "b": 2}
    salted = skew.salted_join(rows, rows.distinct().withColumn("w", F.lit(1)), ["key"], ["key"])
    assert salted.count() == 11 and salted.filter("w = 1").count() == 11


def test_more_than_a_thousand_hot_keys_and_one_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "TARGET_ROWS", 10)
    rows = spark.range(30_000).select(
        F.when(F.col("id") < 1_000, F.lit(-1)).otherwise(F.col("id") % 1_500).alias("key"), F.col("id").alias("v")
    )
    salts = {r.key: r._salts for r in skew.hot_keys(rows, ["key"]).collect()}
    assert len(salts) == 1_501 and salts[-1] == 100
    table = rows.select("key").distinct().withColumn("w", F.col("key") * 2)
    joined = skew.salted_join(rows, table, ["key"], ["v"])
    assert joined.count() == 30_000 and joined.filter("w = 2 * key").count() == 30_000


def test_broadcasts_are_measured_in_bytes(spark, monkeypatch):
    ids = spark.createDataFrame([("x" * 1_000,), ("y" * 1_000,)], "id string")
    assert skew.fits_broadcast(ids, "id", 2)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 2_000)
    assert not skew.fits_broadcast(ids, "id", 2)


def test_hot_rows_land_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(skew, "TARGET_ROWS", 100)
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), F.col("id").alias("v"))
    table = spark.createDataFrame([("hot", 1)], "key string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.salted_join(rows, table, ["key"], ["v"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 8_000
