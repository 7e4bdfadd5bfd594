"""Feature rules, the split, training, the bundle and scoring."""

import pytest
from pyspark.sql import functions as F

from haulmetrics.operators import features, model

REQUEST = {"vehicle_id": "TRK7", "lat_start": 3.5, "lon_start": 101.25, "lat_end": 3.75, "lon_end": 101.5,
           "Trip_Distance_km": 40.0, "Trip_Duration_min": 80.0, "Idle_Time_min": 20.0, "Moving_Time_min": 60.0,
           "Avg_Speed": 30.0, "Idle_Percentage": 25.0, "Age_of_Truck_months": 48.0}


def requests(spark, *changes):
    names = list(dict.fromkeys([*REQUEST, *(k for c in changes for k in c)]))
    rows = [tuple((REQUEST | c).get(n) for n in names) for c in changes]
    kinds = ", ".join(f"{n} {'string' if n == 'vehicle_id' else 'bigint' if n in features.OPTIONAL_COUNTS else 'double'}" for n in names)
    return spark.createDataFrame(rows, kinds).withColumn("timestamp_start", F.timestamp_seconds(F.lit(1740000000)))


def test_distance_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 10.0, 10.1, 50.0, 200.0, 200.1, None)], "x double")
    assert [r.b for r in df.select(features.distance_bucket(F.col("x")).alias("b")).collect()] == [
        None, "0-10km", "0-10km", "10-50km", "10-50km", "50-200km", "200+km", None]


@pytest.mark.parametrize("times", [list(range(10)), [0, 1, 5, 5, 5, 5, 5, 5, 5, 9], [3] * 10, [0, 86400 * 3, 86400 * 9]])
def test_time_split_is_exact(spark, times):
    rows = [(100 - i, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "trip_id bigint, t bigint").withColumn("timestamp_start", F.timestamp_seconds("t"))
    got = {r.trip_id for r in features.time_split(df).where("is_train").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0] for r in order[:int(len(rows) * 0.8)]}


def test_defaults(spark):
    df = requests(spark, {}, {"speed_mean": 50.0, "speed_p25": 0.0, "speed_p75": 61.0}, {"speed_mean": 0.0, "speed_median": 9.0})
    out = features.fill_speed_defaults(features.with_optional_fields(df)).select("speed_mean", "speed_median", "speed_p25", "speed_p75", "speed_std").collect()
    assert tuple(out[0]) == pytest.approx((30.0, 30.0, 24.0, 36.0, 6.0))
    assert tuple(out[1]) == pytest.approx((50.0, 50.0, 40.0, 61.0, 10.0))
    assert tuple(out[2]) == pytest.approx((0.0, 9.0, 0.0, 0.0, 0.0))
    counts = features.fill_count_defaults(features.with_optional_fields(requests(spark, {}, {"stop_count": 8, "moving_event_count": 92, "idle_event_count": 30}))).collect()
    assert [r.telemetry_rows for r in counts] == [1, 100]
    assert counts[1].idle_percentage_rows == pytest.approx(30 / (100 + 1e-6))


def test_validation(spark):
    df = requests(spark, {}, {"lat_start": 91.0, "Trip_Distance_km": 0.0}, {"Idle_Percentage": 100.5}, {"Idle_Time_min": None}, {"Idle_Time_min": 0.0})
    assert [r.rejected_fields for r in features.validate_requests(df).collect()] == ["", "lat_start,Trip_Distance_km", "Idle_Percentage", "Idle_Time_min", ""]


def test_unseen_vehicle_gets_the_overall_mean(spark):
    means = spark.createDataFrame([("a", 0.4)], "vehicle_id string, vehicle_mean double")
    df = spark.createDataFrame([("a",), ("z",)], "vehicle_id string")
    assert {r.vehicle_id: r.vehicle_id_encoded for r in features.encode_vehicle(df, means, F.lit(0.7)).collect()} == {"a": 0.4, "z": 0.7}


@pytest.fixture(scope="module")
def frame(spark):
    i = F.col("id")
    trips = spark.range(240).select(
        i.alias("trip_id"), F.concat(F.lit("v"), i % 6).alias("vehicle_id"), F.timestamp_seconds(1735689600 + i * 4000).alias("timestamp_start"),
        (3 + (i % 10) * 0.01).alias("lat_start"), (101 + (i % 7) * 0.01).alias("lon_start"), (3 + (i % 9) * 0.02).alias("lat_end"),
        (101 + (i % 11) * 0.02).alias("lon_end"), (2 + (i % 60)).cast("double").alias("Trip_Distance_km"), (10 + (i % 50)).cast("double").alias("Trip_Duration_min"),
        (i % 10).cast("double").alias("Idle_Time_min"), (5 + i % 20).cast("double").alias("Moving_Time_min"), (15 + i % 45).cast("double").alias("Avg_Speed"),
        ((i % 10) / 10).alias("Idle_Percentage"), F.lit(30.0).alias("Age_of_Truck_months"))
    with_rates = features.fill_count_defaults(features.fill_speed_defaults(features.with_optional_fields(trips)))
    return features.time_split(features.engineered(with_rates).withColumn(features.TARGET, features.target_fixed_speed())).cache()


def test_train_save_load_score(spark, frame, tmp_path):
    bundle, scores = model.train(frame, "trips", rounds=8)
    table = {(r.model, r.split): r for r in scores.collect()}
    assert len(table) == 4 and table["ridge", "test"].r2 > 0 and table["boosted_trees", "train"].r2 > 0
    gain = model.compare_models(scores).first()
    assert gain.best_by_mae == min(("ridge", "boosted_trees"), key=lambda m: table[m, "test"].mae)

    bundle.save(str(tmp_path / "bundle"))
    loaded = model.Bundle.load(spark, str(tmp_path / "bundle"))
    a = {r.trip_id: r.predicted_route_efficiency for r in model.predict(frame, bundle).collect()}
    b = {r.trip_id: r.predicted_route_efficiency for r in model.predict(frame, loaded).collect()}
    assert a == b and all(0 <= x <= 1 for x in a.values())

    vectors = loaded.vectors(frame)
    importance = model.feature_importance(loaded, model.feature_names(vectors)).collect()
    assert len(importance) == loaded.metadata.first().feature_count
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    assert {r.feature for r in importance} >= {"Trip_Distance_km", "vehicle_id_encoded", "distance_bucket_0-10km"}

    scored = model.score_requests(requests(spark, {}, {"Avg_Speed": -1.0}, {"Trip_Distance_km": 500.0}), loaded).collect()
    assert sorted(r.rejected_fields for r in scored) == ["", "", "Avg_Speed"]
    assert all((r.predicted_route_efficiency is None) == (r.rejected_fields != "") for r in scored)


def test_unseen_levels_are_all_zero(spark, frame):
    from pyspark.ml.functions import vector_to_array
    train = frame.withColumns({"zone_start_id": F.lit(1), "zone_end_id": F.lit(2), "vehicle_id_encoded": F.lit(0.5)}).where("distance_bucket <> '200+km'")
    encoder = model.fit_encoder(train, ["Trip_Distance_km"])
    new = train.limit(1).withColumns({"zone_start_id": F.lit(99), "distance_bucket": F.lit("200+km")})
    row = encoder.transform(new).select(vector_to_array("_h_zone_start_id").alias("z"), vector_to_array("_h_distance_bucket").alias("d"),
                                        vector_to_array("_h_zone_end_id").alias("e")).first()
    assert sum(row.z) == 0 and sum(row.d) == 0 and row.e == [1.0]


@pytest.mark.parametrize("field", sorted(features.FIELD_RANGES))
def test_nan_is_rejected(spark, field):
    row, = features.validate_requests(requests(spark, {field: float("nan")})).collect()
    assert row.rejected_fields == field


def test_trips_model_learns_the_bucket_speed_target(spark, frame):
    other = features.bucket_speed_frame(frame)
    assert sorted(other.columns) == sorted([*frame.columns, "speed_efficiency"])
    row = other.where("trip_id = 30").first()
    reference = {r.distance_bucket: r.reference_speed for r in features.reference_speeds(frame.where("is_train")).collect()}
    speed = min(1.0, row.Avg_Speed / (reference[row.distance_bucket] + 1e-6))
    assert row.route_efficiency == pytest.approx(0.5 * row.directness_efficiency + 0.3 * (1 - row.idle_ratio) + 0.2 * speed)


def test_zones_take_the_cheapest_start(spark):
    at = [(a + i * 0.01, b + i * 0.02, b, a) for a, b in ((0.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, 9.0), (2.0, 7.0)) for i in range(8)]
    train = spark.createDataFrame(at, "lat_start double, lon_start double, lat_end double, lon_end double").repartition(2, "lat_start")
    zones = model.fit_zones(train, k=4, starts=5)
    for assembler, chosen in zip(zones.stages[::2], zones.stages[1::2]):
        points = assembler.transform(train)
        single = model.zone_starts(points, chosen.getPredictionCol(), k=4, starts=5)
        assert [m.getSeed() for m in single] == [model.SEED + i for i in range(5)]
        cost = min(m.summary.trainingCost for m in single)
        assert chosen.summary.trainingCost == pytest.approx(cost)
    assert model.apply_zones(train, zones).where("zone_start_id BETWEEN 0 AND 3 AND zone_end_id BETWEEN 0 AND 3").count() == len(at)


@pytest.mark.parametrize("rows, partitions", [(500, 4), (700_000, 7), (10**9, 40)])
def test_fits_run_on_as_many_tasks_as_rows_or_cores_ask_for(spark, rows, partitions):
    few = model.for_fitting(spark.range(500).repartition(40), rows)
    assert few.rdd.getNumPartitions() == partitions and sorted(r.id for r in few.collect()) == list(range(500))
