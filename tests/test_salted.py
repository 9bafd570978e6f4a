from pyspark.sql import functions as F

from tideglass.operators.salted import heavy_keys, salted, two_stage

SCHEMA = "k string, id long, v double, _salt string"


def run(df, parts=8):
    return two_stage(df, "k", F.col("id"), ["id", "v"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, parts)


def test_equals_plain_grouping_with_repeats_nulls_and_a_hot_key(spark, rows):
    data = [("hot", i, float(i % 7), "c") for i in range(900)] + [(f"k{i % 20}", 1000 + i, 1.0, "c") for i in range(100)]
    data += [(None, 5000 + i, 2.0, "c") for i in range(300)] + [("", 6000, None, "c")]
    df = spark.createDataFrame(data + data[100:200], SCHEMA)
    want = df.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert rows(run(df), "k", "n", "s") == rows(want, "k", "n", "s")


def test_heavy_keys_are_bounded_and_spread(spark):
    df = spark.createDataFrame([("hot", i, 1.0, "") for i in range(1000)] + [(f"k{i}", i, 1.0, "") for i in range(1000)], SCHEMA)
    assert [r["_key"] for r in heavy_keys(df, "k", 8).collect()] == ["hot"]
    assert salted(df, "k", F.col("id"), 8).where("k = 'hot'").select("_salt").distinct().count() == 4
    assert heavy_keys(df.withColumn("k", F.col("id")), "k", 4).count() <= 4


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
