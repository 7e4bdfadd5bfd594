"""Piecewise windows against plain windows over the whole key."""

import random

import pytest
from pyspark.sql import Window, functions as F

from haulmetrics.operators.timeline import Timeline, time_bucket


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for key, n in (("hot", 400), ("a", 25), ("b", 1)):
        for t in sorted(rng.sample(range(100_000), n)):
            data.append((key, t * 1_000_000, rng.choice([None, 1.5, 2.5]), rng.randint(0, 1)))
    return spark.createDataFrame(data, "key string, seq bigint, x double, flag int").withColumn(
        "bucket", time_bucket(F.col("seq"), 3600)).cache()


LINE = Timeline(("key",), ("seq",))


def test_neighbours_match_plain_windows(rows):
    w = Window.partitionBy("key").orderBy("seq")
    got = LINE.neighbours(rows, before=["seq", "x"], after=["x"]).select(
        "key", "seq", F.col("prev.seq").alias("p"), F.col("prev.x").alias("px"), F.col("next.x").alias("nx"), F.col("prev").isNull().alias("first"))
    want = rows.select("key", "seq", F.lag("seq").over(w).alias("p"), F.lag("x").over(w).alias("px"), F.lead("x").over(w).alias("nx"),
                       F.lag("seq").over(w).isNull().alias("first"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_running_matches_plain_window_and_brings_key_values(rows, spark):
    per_key = spark.createDataFrame([("hot", 9), ("a", 8)], "key string, extra int")
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    got = LINE.running(rows, {"n": F.col("flag")}, per_key).select("key", "seq", "n", "extra")
    want = rows.withColumn("n", F.sum("flag").over(w)).join(per_key, "key", "left").select("key", "seq", "n", "extra")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    attached = LINE.attach(rows, per_key).select("key", "seq", "extra")
    assert sorted(attached.collect(), key=str) == sorted(want.select("key", "seq", "extra").collect(), key=str)


def test_running_without_key(rows):
    whole = Timeline((), ("seq", "key"))
    got = [r.n for r in whole.running(rows, {"n": F.lit(1)}).orderBy("seq", "key").collect()]
    assert got == list(range(1, 427))


def test_no_window_holds_a_whole_key(rows):
    """Row-level windows are partitioned by key and bucket."""
    plan = LINE.neighbours(rows, before=["x"])._jdf.queryExecution().optimizedPlan().toString()
    specs = [line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "windowspecdefinition(" in line]
    row_level = [s for s in specs if "seq" in s]
    assert row_level and all(s.startswith("key") and "bucket" in s.split("ASC")[0] for s in row_level)


def test_running_from_sums_inside_pieces_is_not_shuffled_again(rows, spark, tmp_path):
    per_key = spark.createDataFrame([("hot", 9), ("a", 8)], "key string, extra int")
    rows.withColumn("inside", LINE.running_inside(F.col("flag"))).write.parquet(str(tmp_path / "rows"))
    staged = spark.read.parquet(str(tmp_path / "rows"))
    got = LINE.running(staged, {"n": F.col("flag")}, per_key, {"n": "inside"}).select("key", "seq", "n", "extra")
    want = LINE.running(rows, {"n": F.col("flag")}, per_key).select("key", "seq", "n", "extra")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_and_last_of_the_leading_order_column(rows):
    """Taken by `max` and `min`, not by a position of two columns, which would sort the rows first."""
    line = Timeline(("key",), ("seq", "flag"))
    w = Window.partitionBy("key").orderBy("seq", "flag")
    got = line.neighbours(rows, before=["seq"], after=["seq"])
    want = rows.select("key", "seq", F.lag("seq").over(w).alias("p"), F.lead("seq").over(w).alias("n"))
    assert sorted(got.select("key", "seq", F.col("prev.seq").alias("p"), F.col("next.seq").alias("n")).collect(), key=str) == sorted(want.collect(), key=str)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
