"""Block-wise windows and hot-key joins against plain ones."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from netlens.operators import skew


def rows(spark):
    rng = random.Random(3)
    seqs = {"hot": sorted(rng.sample(range(5000), 700)), "cold": sorted(rng.sample(range(5000), 9)), "one": [7]}
    data = [(key, seq, rng.randrange(-5, 9)) for key, items in seqs.items() for seq in items]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, seq bigint, v bigint").repartition(5)


def test_running_previous_rolling(spark):
    frame = rows(spark)
    order = Window.partitionBy("k").orderBy("seq")
    want = frame.select(
        "k", "seq", F.sum("v").over(order).alias("total"), F.row_number().over(order).cast("bigint").alias("rn"),
        F.lag("v").over(order).alias("prev_v"), F.sum("v").over(order.rowsBetween(-4, 0)).alias("last_v"),
    )
    total = skew.running_sum(frame, ["k"], "seq", {"total": F.col("v")}, bits=5).select("k", "seq", "total")
    number = skew.row_numbers(frame, ["k"], "seq", bits=5).select("k", "seq", "rn")
    before = skew.previous_value(frame, ["k"], "seq", ["v"], bits=5).select("k", "seq", "prev_v")
    last = skew.rolling_sum(frame, ["k"], "seq", ["v"], 5, size=16).select("k", "seq", "last_v")
    got = total.join(number, ["k", "seq"]).join(before, ["k", "seq"]).join(last, ["k", "seq"])
    key = lambda row: (row.k, row.seq)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_attach_by_key(spark):
    frame = rows(spark)
    facts = frame.where("k <> 'one'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"), F.min("seq").alias("low"))
    want = sorted(map(tuple, frame.join(facts.drop("n"), "k", "left").select("k", "seq", "v", "top", "low").collect()), key=repr)
    for hot in (1, 1024):
        got = skew.attach_by_key(frame, facts, ["k"], "n", ["seq"], hot_keys=hot)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_no_hot_key_reaches_one_task(spark):
    """A key with all rows is windowed in many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(0, 4096).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), F.lit(1).cast("bigint").alias("v"))
        summed = skew.running_sum(frame, ["k"], "seq", {"total": F.col("v")}, bits=6)
        sizes = summed.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and summed.agg(F.max("total")).first()[0] == 4096
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
