"""Statistics against pandas and known values."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulmetrics.functions.tails import chi_square_tail, student_two_sided
from haulmetrics.operators import route, stats

NAMES = ["a", "b", "c", "y"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        y = rng.random()
        rows.append((i, rng.choice([0.0, 0.0, round(y, 1)]), None if i % 7 == 0 else y * 3 + rng.gauss(0, 1),
                     None if i % 5 == 0 else float(rng.randint(0, 4)), None if i % 50 == 0 else y))
    pdf = pd.DataFrame(rows, columns=["id", *NAMES])
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double").repartition(4).cache()
    return df, pdf


@pytest.mark.parametrize("bucket_rows", [10**6, 40])
def test_spearman_with_gaps_and_ties(table, bucket_rows):
    df, pdf = table
    want = pdf[NAMES].corr(method="spearman")
    got = stats.spearman_matrix(df, "id", ["a", "b", "c"], "y", bucket_rows).collect()
    assert len(got) == 16
    for r in got:
        assert r.spearman_r == pytest.approx(want.loc[r.x, r.y], abs=1e-12), (r.x, r.y)


def test_ranks_are_not_broadcast(spark, table, tmp_path):
    """A small file says nothing of the cells and ranks made from it."""
    table[0].write.parquet(str(tmp_path / "rows"))
    got = stats.spearman_pairs(spark.read.parquet(str(tmp_path / "rows")), "id", [("a", "y"), ("b", "y")])
    got.collect()
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "value" in line]
    assert joins and not any("Broadcast" in line for line in joins), joins


def test_pearson_and_ranking(table):
    df, pdf = table
    want = pdf[NAMES].corr()
    for r in stats.pearson_matrix(df, ["a", "b", "c"], "y").collect():
        assert r.pearson_r == pytest.approx(want.loc[r.x, r.y], abs=1e-12)
    ranking = stats.feature_ranking(df, "id", ["a", "b", "c"], "y").collect()
    assert [r.abs_spearman for r in ranking] == sorted((r.abs_spearman for r in ranking), reverse=True)
    assert {r.feature: r.n for r in ranking}["b"] == int(pdf[["b", "y"]].dropna().shape[0])


@pytest.mark.parametrize("bucket_rows", [10**6, 30])
def test_kruskal_is_tie_corrected(table, bucket_rows):
    df, pdf = table
    data = pdf.assign(t=pdf.y.round(1))[["c", "t"]].dropna()
    ranks, n = data.t.rank(), len(data)
    h = 12 / (n * (n + 1)) * sum(g.sum() ** 2 / len(g) for _, g in ranks.groupby(data.c)) - 3 * (n + 1)
    sizes = data.t.value_counts()
    h /= 1 - (sizes ** 3 - sizes).sum() / (n ** 3 - n)
    row = stats.kruskal_wallis(df.withColumn("t", F.round("y", 1)).withColumn("k", F.lit("one")), ["c", "k"], "t", bucket_rows).collect()
    assert [r.feature for r in row] == ["c"] and row[0].degrees_of_freedom == 4
    assert row[0].kw_statistic == pytest.approx(h)


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0, 2.2281388519649385, 10.0), (18.307038053275146, 10.0, 0.0, 5.0), (0.0, 3.0, 63.65674116287158, 1.0)],
                               "h double, k double, t double, d double")
    got = df.select(chi_square_tail("h", "k").alias("p"), student_two_sided("t", "d").alias("q")).collect()
    assert [r.p for r in got] == pytest.approx([0.05, 0.05, 1.0], abs=1e-9)
    assert [r.q for r in got] == pytest.approx([0.05, 1.0, 0.01], abs=1e-9)


def test_histogram_matches_numpy(table):
    df, pdf = table
    counts, edges = np.histogram(pdf.b.dropna(), bins=50)
    got = stats.histogram(df, "b").orderBy("bin").collect()
    assert [r.row_count for r in got] == list(counts)
    assert [r.bin_start for r in got] == pytest.approx(list(edges[:-1]))


def test_constant_column_histogram(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert sum(r.row_count for r in stats.histogram(df, "x").collect()) == 3


def test_describe_and_box(table):
    df, pdf = table
    row = stats.describe(df, ["b"]).first()
    want = pdf.b.describe()
    assert [row.n, row["mean"], row["std"], row.min_value, row.q25, row.q50, row.q75, row.max_value] == pytest.approx(list(want))
    boxes = {r.category: r for r in stats.box_statistics(df, "c", "y").collect()}
    assert len(boxes) == 5
    q = pdf[["c", "y"]].dropna().groupby("c").y.quantile(0.75)
    assert all(boxes[str(float(k))].q3 == pytest.approx(v) for k, v in q.items())


def test_sample_repeats(table):
    df, _ = table
    one = {r.id for r in stats.seeded_sample(df, "id", 50).collect()}
    two = {r.id for r in stats.seeded_sample(df.repartition(9), "id", 50).collect()}
    other = {r.id for r in stats.seeded_sample(df, "id", 50, seed=1).collect()}
    assert len(one) == 50 and one == two and one != other


def test_insights_rules(spark):
    rows = [("idle_ratio", -0.9), ("speed_kmh", 0.8), ("route_directness", -0.7), ("hour_of_day", 0.1)]
    ranking = spark.createDataFrame([(f, r, abs(r)) for f, r in rows], "feature string, spearman_r double, abs_spearman double")
    assert {r.category for r in stats.insights(ranking).collect()} == {"Idle Management", "Scheduling"}


def test_column_classes(spark):
    df = spark.createDataFrame([(i, float(i % 20), float(i % 3), "k%d" % (i % 2), i % 2 == 0, 3.0) for i in range(100)],
                               "trip_id bigint, speed double, few double, label string, flag boolean, lat double")
    got = {r.column_name: r.column_class for r in route.classify_columns(df, {"few": "numeric"}).collect()}
    assert got == {"trip_id": "id_like", "speed": "numeric", "few": "numeric", "label": "categorical", "flag": "categorical", "lat": "geospatial"}


def test_outlier_clipping(spark):
    df = spark.createDataFrame([(i, float(i), None if i else 9999.0) for i in range(1001)], "trip_id bigint, x double, trip_distance_km double")
    out = route.clip_outliers(df)
    low, high = out.agg(F.min("x"), F.max("x")).first()
    assert (low, high) == (5.0, 995.0)
    assert out.where("trip_distance_km IS NOT NULL").first().trip_distance_km == 5000.0
    assert out.agg(F.count_distinct("trip_id")).first()[0] == 1001


def test_enrichment_depends_on_keys(spark):
    merged = spark.createDataFrame([(1, 10, 5.0)], "trip_id int, timestamp int, x double")
    assert route.enrich(merged, spark.createDataFrame([(1,)], "other int")).columns == merged.columns
    by_time = route.enrich(merged, spark.createDataFrame([(1, 11, 7.0)], "trip_id int, timestamp int, x double")).first()
    by_trip = route.enrich(merged, spark.createDataFrame([(1, 7.0)], "trip_id int, x double")).first()
    assert by_time.x_combined is None and by_trip.x_combined == 7.0


def test_stop_count_counts_the_first_row(spark):
    rows = [(1, i * 60, v) for i, v in enumerate([10.0, 0.0, 0.0, 20.0])]
    df = (spark.createDataFrame(rows, "trip_id bigint, t bigint, speed_kmh double").withColumn("timestamp", F.timestamp_seconds("t"))
          .withColumns({"lat": F.lit(3.0), "lon": F.lit(101.0), **{c: F.lit(1.0) for c in (
              "idle_time_min", "moving_time_min", "idle_percentage", "idle_efficiency", "trip_distance_km", "trip_duration_min",
              "distance_efficiency", "time_efficiency", "signal_reliability")}}))
    row = route.trip_features(route.route_efficiency(route.track_features(df))).first()
    assert row.n_stops == 1.5 and row.stops_per_km == 1.5 and row.idle_time_total == 4.0


def test_no_feature_or_category_is_left_out(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), *map(float, rng.normal(size=40)), f"c{i % 20}", float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(["trip_id long", *[f"f{k} double" for k in range(40)], "category string", "target double"]))
    names = [f"f{k}" for k in range(40)]
    assert stats.pearson_matrix(df, names, "target").count() == 41 * 41
    assert stats.pearson_matrix(df, names, "target", most=5).count() == 6 * 6
    assert stats.correlation_summary(df, "trip_id", names, "target").count() == 41
    assert stats.box_statistics(df, "category", "target").count() == 20 and stats.box_statistics(df, "category", "target", k=15).count() == 15
    assert stats.kruskal_wallis(df, ["category"], "target").first().degrees_of_freedom == 19


def test_sample_cutoff_is_raised_for_shared_keys(spark):
    """Most rows share a key that hashes high or low; the sample is the same as from a full sort."""
    df = spark.range(5000).selectExpr("id", "if(id < 4500, 7, id) AS key")
    for seed in range(4):
        want = sorted((hashlib.md5(f"{r.key}:{seed}".encode()).hexdigest(), r.key) for r in df.collect())[:60]
        assert sorted(r.key for r in stats.seeded_sample(df, "key", 60, seed).collect()) == sorted(k for _, k in want)
    assert stats.seeded_sample(df, "key", 9000).count() == 5000 and stats.seeded_sample(df.limit(0), "key", 5).count() == 0
