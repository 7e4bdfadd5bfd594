"""Exact quantiles: the distributed path must equal the built-in one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmetrics.operators.quantiles import aggregate_with_quantiles, global_quantiles

PROBS = {f"q{int(p * 1000)}": ("x", p) for p in (0.0, 0.005, 0.1, 0.25, 0.5, 0.9, 0.995, 1.0)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot", rng.choice([rng.gauss(0, 50), 7.0, 7.0, -1.25])) for _ in range(5000)]
    data += [("cold", float(i)) for i in range(4)] + [("one", 3.5)] + [("hot", None)] * 10
    return spark.createDataFrame(data, "g string, x double").repartition(5).cache()


def expected(rows, group):
    xs = [r.x for r in rows.where(F.col("g") == group).collect() if r.x is not None]
    return {n: float(np.quantile(xs, p)) for n, (_, p) in PROBS.items()}


@pytest.mark.parametrize("hot_rows", [2, 100, 10**6])
def test_groups(rows, hot_rows):
    got = aggregate_with_quantiles(rows, ["g"], [F.count("x").alias("n")], PROBS, hot_rows).collect()
    assert {r.g for r in got} == {"hot", "cold", "one"}
    for r in got:
        for name, value in expected(rows, r.g).items():
            assert r[name] == pytest.approx(value, abs=1e-9), (r.g, name)
    assert {r.g: r.n for r in got} == {"hot": 5000, "cold": 4, "one": 1}


def test_whole_table(rows):
    hot = rows.where("g = 'hot'")
    assert global_quantiles(hot, PROBS, 10).first().asDict() == pytest.approx(expected(rows, "hot"))


def test_hot_group_with_few_or_no_values(spark):
    data = [("few", float(i) if i < 7 else None) for i in range(300)] + [("none", None)] * 300
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.asDict() for r in aggregate_with_quantiles(df, ["g"], [], PROBS, 100).collect()}
    for name, (_, p) in PROBS.items():
        assert got["few"][name] == pytest.approx(p * 6)
        assert got["none"][name] is None


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_nan_counts_as_missing_at_every_size(spark, hot_rows):
    data = [("g", x) for x in [float("nan")] * 8 + [None] * 3 + [float(i) for i in range(11)]] + [("nan", float("nan"))] * 4
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.asDict() for r in aggregate_with_quantiles(df, ["g"], [], PROBS, hot_rows).collect()}
    whole = global_quantiles(df, PROBS, hot_rows).first().asDict()
    for name, (_, p) in PROBS.items():
        assert got["g"][name] == pytest.approx(p * 10) == whole[name]
        assert got["nan"][name] is None


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_extreme_values(spark, hot_rows):
    values = [float("-inf"), -1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0 + 2**-52, 1e9, 1e9 + 1, 1.7e308, float("inf")]
    values = (values * 3)[:33]
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
    wanted = {f"q{k}": ("x", k / 32) for k in range(33)}
    got = global_quantiles(df, wanted, hot_rows).first()
    assert [got[f"q{k}"] for k in range(33)] == sorted(values)


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plan_of_a_whole_table(spark, rows):
    """Rows meet neither a sketch nor a constant key: they are counted per value first."""
    plan = _plan(global_quantiles(rows.where("g = 'hot'"), PROBS, 10))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "percentile_approx" not in plan


@pytest.mark.parametrize("hot_rows", [2, 10**9])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_the_input_is_read_twice_at_most(spark, hot_rows, keys):
    """Rows are counted as they leave the input, whatever the size of the groups."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch
    df = spark.range(600).selectExpr("if(id < 500, 'hot', cast(id % 7 AS string)) AS g", "cast(id % 97 AS double) AS x", "cast(id AS double) AS y")
    df = df.mapInArrow(counted, "g string, x double, y double")
    wanted = {"median_x": ("x", 0.5), "p90_y": ("y", 0.9)}
    got = {r.g if keys else "": r.asDict() for r in aggregate_with_quantiles(df, keys, [F.max("y").alias("top")], wanted, hot_rows).collect()}
    assert read.value <= 2 * 600
    plain = df.groupBy(*keys).agg(F.max("y").alias("top"), F.percentile("x", 0.5).alias("median_x"), F.percentile("y", 0.9).alias("p90_y")).collect()
    assert got == {r.g if keys else "": r.asDict() for r in plain}
