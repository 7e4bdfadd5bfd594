"""Ping and trip rules on tables of a few rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulmetrics.operators import dashboards, points, trips_hybrid, trips_ignition
from haulmetrics.plans.tables import Tables

T0 = 1735689600  # 2025-01-01 00:00 UTC
SCHEMA = ("vehicle_id string, s bigint, engine_on boolean, speed_kmh double, odometer_km double, lat double, lon double, gps_ok boolean")


def pings(spark, rows):
    """Rows of (vehicle, seconds, engine, speed, odometer[, lat, lon, gps])."""
    full = [(*r, *(3.0, 101.0, True)[len(r) - 5:]) if len(r) < 8 else r for r in rows]
    return (spark.createDataFrame([(v, T0 + s, *rest) for v, s, *rest in full], SCHEMA)
            .withColumn("ts", F.timestamp_seconds("s")))


def by_second(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("vehicle_id", "seq").collect()]


def test_rolling_median_skips_nulls(spark):
    df = pings(spark, [("a", i * 60, True, x, 1.0) for i, x in enumerate([None, 4.0, 10.0, None, None, None, 8.0])])
    assert [x for x, in by_second(points.point_steps(df), "speed_smoothed")] == [4.0, 7.0, 7.0, 10.0, None, 8.0, 8.0]


def test_odometer_reset_null_and_jump(spark):
    df = pings(spark, [("a", 0, True, 1.0, 100.0), ("a", 60, True, 1.0, 90.0), ("a", 120, True, 1.0, None),
                       ("a", 180, True, 1.0, 91.0), ("a", 230, True, 1.0, 150.0), ("a", 290, True, 1.0, 210.0)])
    got = by_second(points.point_steps(df), "odo_step_km", "invalid_odo_step")
    assert got == [(None, False), (-10.0, True), (None, False), (None, False), (59.0, True), (60.0, False)]


def test_teleport_and_bad_fix_lose_their_step(spark):
    df = pings(spark, [("a", 0, True, 1.0, 1.0), ("a", 60, True, 1.0, 1.0, 4.0, 101.0, True), ("a", 7260, True, 1.0, 1.0, 4.1, 101.0, True),
                       ("a", 14460, True, 1.0, 1.0, 4.2, 101.0, False)])
    got = by_second(points.point_steps(df), "gps_step_km", "implied_speed_kmh")
    assert got[0] == (None, None) and got[1][0] is None and got[1][1] > 140
    assert got[2][0] == pytest.approx(11.119, abs=1e-3) and got[3][0] is None and got[3][1] < 140


@pytest.mark.parametrize("first_on,hybrid,legacy", [(True, [1, 1, 1, 2, 3], [0, 0, 0, 1, 2]), (False, [0, 1, 1, 2, 3], [0, 1, 1, 2, 3])])
def test_trip_numbering(spark, first_on, hybrid, legacy):
    """Off -> on opens a trip, a silence of exactly 15 minutes opens one, even with the engine off."""
    df = pings(spark, [("a", 0, first_on, 1.0, 1.0), ("a", 60, True, 1.0, 1.0), ("a", 120, False, 1.0, 1.0), ("a", 1020, False, 1.0, 1.0),
                       ("a", 1080, True, 1.0, 1.0)])
    steps = points.point_steps(df)
    assert [x for x, in by_second(points.number_trips(steps), "trip_id")] == hybrid
    assert [x for x, in by_second(points.number_trips(steps, legacy=True), "trip_id")] == legacy


def test_bucket_width_does_not_change_results(spark):
    df = pings(spark, [("a", i * 97 + (i // 9) * 1000, i % 7 != 0, float(i % 13), 1.0 + i * 0.02, 3.0 + i * 1e-4, 101.0, i % 11 != 0) for i in range(120)])
    results = [points.clean_points(points.point_steps(df, w)).orderBy("seq").select(
        "seq", "trip_id", "fused_step_km", "speed_smoothed", "is_idle", "scale_factor").collect() for w in (60, 900, 10**6)]
    assert results[0] == results[1] == results[2]


def test_scale_factor_defaults_to_one_and_is_clipped(spark):
    far = [("far", i * 600, True, 1.0, 1.0 + i, 3.0 + i * 0.05, 101.0, True) for i in range(4)]
    df = points.clean_points(points.point_steps(pings(spark, far + [("still", 0, True, 0.0, 1.0)])))
    assert {r.vehicle_id: r.scale_factor for r in df.collect()} == {"far": 1.2, "still": 1.0}


def test_flagged_pings_leave_the_trip_but_are_counted(spark):
    rows = [("a", i * 60, True, 130.0, 1.0 + 2 * i, 3.0, 101.0, i != 2) for i in range(5)]
    trip = trips_hybrid.aggregate_trips(points.clean_points(points.point_steps(pings(spark, rows)))).first()
    assert (trip.Speeding_Count, trip.Flagged_Count) == (4, 1)
    # Standing GPS against a moving odometer: ratio 0, scale clipped to 0.8; the first ping has no step.
    assert trip.Trip_Distance_km == pytest.approx(3 * 2.0 * 0.8) and trip.Trip_Duration_min == 4


def test_single_row_trip_and_next_local_day(spark):
    rows = [("a", 0, True, 10.0, 1.0), ("b", 16 * 3600, True, 50.0, 1.0), ("b", 16 * 3600 + 300, True, 50.0, 5.0)]
    trips = trips_hybrid.aggregate_trips(points.clean_points(points.point_steps(pings(spark, rows))))
    one = trips.where("vehicle_id = 'a'").first()
    assert (one.Trip_Duration_min, one.Avg_Speed_kmh, one.Idle_Percentage) == (0.0, 0.0, 0.0)
    day = trips_hybrid.add_local_date(trips_hybrid.valid_trips(trips)).first()
    assert day.vehicle_id == "b" and day.date_myt == dt.date(2025, 1, 2)


def test_ignition_ids_run_on_over_vehicles(spark):
    rows = [("a", 0, False, 0.0, 1.0), ("a", 60, True, 0.5, 1.0), ("a", 120, True, 9.0, 2.0), ("a", 180, False, 0.0, 2.0), ("a", 240, True, 9.0, 3.0),
            ("b", 0, True, 9.0, 1.0), ("b", 400, True, 1.0, None), ("b", 700, True, 1.0, 4.0), ("c", 0, False, 1.0, 1.0), ("d", 5, True, 1.0, 1.0)]
    got = by_second(trips_ignition.engine_on_rows(points.point_steps(pings(spark, rows))), "vehicle_id", "trip_id", "delta_t_sec", "is_idle")
    assert got == [("a", 1, 60.0, True), ("a", 1, 0.0, False), ("a", 2, 0.0, False),
                   ("b", 4, 300.0, False), ("b", 4, 300.0, True), ("b", 4, 0.0, True), ("d", 7, 0.0, True)]


def test_ignition_ids_do_not_shuffle_the_rows_again(spark, tmp_path):
    """Counts inside a piece come with the steps; narrow pieces make every carry matter."""
    rows = [(v, i * 61, i % 5 > 1, 1.0, 1.0) for v in "abc" for i in range(60)]
    points.point_steps(pings(spark, rows), 300).write.parquet(str(tmp_path / "steps"))
    got = trips_ignition.engine_on_rows(spark.read.parquet(str(tmp_path / "steps")))
    # 12 trips of each vehicle, and one number more than that is used by each
    assert by_second(got, "vehicle_id", "trip_id") == [(v, k * 13 + i // 5 + 1) for k, v in enumerate("abc") for i in range(60) if i % 5 > 1]
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_trip_scores(spark):
    rows = [("a", 0, True, 0.0, None), ("a", 300, True, 60.0, 10.0), ("a", 600, True, 60.0, 8.0), ("b", 0, True, 50.0, 5.0)]
    df = pings(spark, rows)
    trips = {r.vehicle_id: r for r in trips_ignition.trips_table(trips_ignition.engine_on_rows(points.point_steps(df)), df).collect()}
    assert trips["a"].Trip_Distance_km is None and trips["a"].QA_negative_distance and trips["a"].Idle_Percentage == 0.5
    assert trips["b"].QA_zero_duration and trips["b"].Avg_Speed is None and trips["b"].Idle_Percentage == 0.0


def test_truck_age_skips_days_that_run_backwards(spark):
    day = 86400
    rows = [("a", 0, True, 1.0, 1000.0), ("a", 3600, True, 1.0, 1030.0), ("a", day, True, 1.0, 1030.0), ("a", day + 3600, True, 1.0, 1000.0),
            ("a", 2 * day, True, 1.0, None), ("b", 0, True, 1.0, 5.0),
            ("c", 0, True, 1.0, 10.0), ("c", 60, True, 1.0, 60.0), ("c", 61 * day, True, 1.0, 100.0), ("c", 61 * day + 60, True, 1.0, 110.0)]
    ages = {r.vehicle_id: r.Age_of_Truck_months for r in trips_ignition.truck_ages(pings(spark, rows)).collect()}
    assert ages["a"] == pytest.approx(1030 / 15) and ages["b"] is None and ages["c"] == pytest.approx(110 / 5)


def test_direction_sectors_keep_gaps(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (90.0, 1), (90.5, 1), (91.0, 1), (360.0, 1)], "direction double, ts int")
    assert {r.position: r.data for r in dashboards.direction_breakdown(df).collect()} == {"north": 2, "east": 1, "south": None, "west": 1}


def test_thinning_compares_with_the_distinct_point_before(spark):
    lats = [3.0, 3.004, 3.008, 3.0, 3.02, 3.0]
    df = pings(spark, [("a", i, True, 1.0, 1.0, x, 101.0, True) for i, x in enumerate(lats)])
    kept = [r.lat for r in dashboards.thinned_track(df, 0.005).orderBy("seq").collect()]
    assert kept == [3.0, 3.02]


def test_ranking_breaks_ties_by_name(spark):
    days = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 4.0), ("c", 4.0)], "vehicle_id string, Total_Moving_min double")
    got = [(r["rank"], r.vehicle) for r in dashboards.driver_ranking(days).orderBy("rank").collect()]
    assert got == [(0, "c"), (1, "a"), (2, "b")]


def test_table_invariants(spark):
    rows = [(v, i * 61, i % 17 > 2, float((i * 7) % 90), 10 + i * 0.5, 3 + i * 1e-3, 101.0, True) for v in "ab" for i in range(200)]
    t = Tables(pings(spark, rows), save=lambda df, name: df.cache())
    days, trips = t.days.collect(), t.trips.collect()
    assert sum(d.Total_Distance_km for d in days) == pytest.approx(sum(x.Trip_Distance_km for x in trips))
    for trip in t.engine_trips.collect():
        assert trip.Idle_Time_min + trip.Moving_Time_min <= trip.Trip_Duration_min + 1e-9
        assert 0 <= trip.Idle_Percentage <= 1 and 0 <= trip.Signal_Reliability <= 1
    for v in "ab":
        ids = sorted({r.trip_id for r in t.points.where(F.col("vehicle_id") == v).collect()})
        assert ids == list(range(ids[0], ids[-1] + 1))
    assert all(r.route_eff is None or 0 <= r.route_eff <= 1 for r in t.scored.collect())
