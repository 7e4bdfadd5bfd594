"""Named queries: one per operator, each over a whole table of the driver's data."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from haulmetrics.functions import geo
from haulmetrics.functions.scalars import hours_minutes
from haulmetrics.operators import (dashboards, features, model, normalize, points, route, stats, trips_hybrid,
                                   trips_ignition)
from haulmetrics.plans.staging import fresh_path
from haulmetrics.plans.tables import Tables
from haulmetrics.sources import files, telemetry_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_tables: dict[tuple[str, str], "Fixture"] = {}


class Fixture(Tables):
    """The tables over the telemetry view of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.every_ping = telemetry_view.all_pings(spark, sf_dir)
        super().__init__(telemetry_view.one_per_second(self.every_ping))

    @cached_property
    def raw(self) -> DataFrame:
        return telemetry_view.raw_text(self.every_ping)

    @property
    def target(self) -> str:
        return route.choose_target(self.trip_features.columns)


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """Tables of a data folder, kept for the session so that queries share what is written."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Fixture(spark, sf_dir)
    return _tables[key]


def forget() -> None:
    """Drop all kept tables, so the next query starts from the data folder."""
    _tables.clear()


TIE_NUDGE = 1e-9
ENDS = ("lat_start", "lon_start", "lat_end", "lon_end")


def tidy(df: DataFrame, digits: int = 5) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, epoch seconds, text dates, long integers.

    Two engines may end on either side of a rounding tie; the nudge settles ties for both.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(TIE_NUDGE), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_seconds(c.cast("timestamp"))
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, digits: int = 5):
    def register(fn: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(fixture(spark, sf_dir)), digits)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        return fn
    return register


# ---- A: scans and sinks ---------------------------------------------------------------------

@query("a01_csv_scan")
def _(t):
    folder = fresh_path(t.spark, "csv")
    written = t.raw.where(F.col("CarNumberPlate").isNotNull()).withColumnRenamed("CarNumberPlate", "Vehicle").drop("row_id")
    files.write_csv(written, folder)
    return files.read_vehicle_csvs(t.spark, folder, written.columns).groupBy("Vehicle").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("Note").alias("notes"), F.count("EngineStatus").alias("engine_values"),
        F.sum(F.col("Odometer").cast("double")).alias("sum_odometer"))


@query("a02_plate_from_file_name")
def _(t):
    name = F.concat(F.substring("vehicle_id", 1, 2), F.lit("%20"), F.substring("vehicle_id", 3, 10), F.lit(".csv"))
    return t.pings.groupBy(files.plate_from_file_name(name).alias("plate")).agg(F.count(F.lit(1)).alias("row_count"))


@query("a03_row_concat")
def _(t):
    a = t.pings.where("engine_on").select("vehicle_id", "s", "speed_kmh")
    b = t.pings.where("NOT engine_on").select("s", "vehicle_id", "fuel_level")
    return files.stack_rows([a, b])


@query("a04_missing_profile")
def _(t):
    return files.missing_profile(t.raw)


@query("a05_drop_sparse_columns")
def _(t):
    return files.missing_profile(files.drop_sparse_columns(t.raw))


def _coarse(t: Fixture) -> DataFrame:
    return t.every_ping.select("vehicle_id", F.floor(F.col("s") / F.lit(3600.0)).cast("bigint").alias("hour"), "engine_on", "gps_ok")


@query("a06_row_dedup")
def _(t):
    return files.drop_repeated_rows(_coarse(t))


@query("a06_row_dedup_counts")
def _(t):
    return files.repeat_counts(_coarse(t))


@query("a07_csv_sink")
def _(t):
    folder = fresh_path(t.spark, "csv")
    files.write_csv(trips_ignition.trip_output(t.engine_trips).select("vehicle_id", "trip_id", "Trip_Distance_km", "total_rows"), folder)
    return t.spark.read.schema("vehicle_id string, trip_id bigint, Trip_Distance_km double, total_rows bigint").csv(folder, header=True)


@query("a08_parquet_sink")
def _(t):
    folder = fresh_path(t.spark, "parquet")
    files.write_parquet(t.days.withColumn("day", F.col("date_myt").cast("string")), folder, ["day"])
    return (t.spark.read.schema("vehicle_id string, Trip_Count bigint, Total_Distance_km double, day string").parquet(folder))


@query("a09_pruned_scan")
def _(t):
    return t.pings.select("vehicle_id", "lat", "lon").groupBy("vehicle_id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


# ---- B: normalisation -----------------------------------------------------------------------

@query("b01_alias_columns")
def _(t):
    df = normalize.rename_by_alias(t.raw.drop("FuelLevelPercentage", "Direction", "Note"))
    return df.select("timestamp_utc", "vehicle_id", "engine_on", "gps_ok", F.col("speed_kmh").try_cast("double").alias("speed_kmh"),
                     F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
                     F.col("odometer_km").cast("double").alias("odometer_km"), "row_id")


@query("b02_explicit_columns")
def _(t):
    return normalize.rename_by_map(t.raw).select("timestamp", "vehicle_id", "engine_on", "gps_valid", "fuel_level")


@query("b03_parse_time")
def _(t):
    return t.raw.select("row_id", normalize.parse_time(F.col("Timestamp")).alias("parsed"))


@query("b04_parse_numbers")
def _(t):
    return t.raw.select("row_id", *[normalize.parse_number(F.col(c)).alias(c.lower())
                                    for c in ("Speed", "Odometer", "Latitude", "Longitude", "FuelLevelPercentage")])


@query("b05_blanket_truth")
def _(t):
    return t.raw.select("row_id", normalize.python_truth(F.col("EngineStatus")).alias("engine_truth"),
                        normalize.python_truth(F.col("GPSLocated")).alias("gps_truth"))


@query("b06_boolean_tokens")
def _(t):
    return t.raw.select("row_id", normalize.engine_flag(F.col("EngineStatus")).alias("engine_on"),
                        normalize.gps_flag(F.col("GPSLocated")).alias("gps_ok"))


@query("b07_require_fields")
def _(t):
    return normalize.normalize(t.raw).select("ts", "vehicle_id", "engine_on", "gps_ok", "speed_kmh")


@query("b08_time_order")
def _(t):
    df = points.on_vehicle_line(t.pings)
    line = points.VEHICLE_LINE.running(df, {"position": F.lit(1)})
    return line.select("vehicle_id", "s", "position")


@query("b09_keyed_dedup")
def _(t):
    df = t.every_ping.select("vehicle_id", "s", "event_id", "speed_kmh", "engine_on", "gps_ok", "odometer_km", "lat", "lon")
    return normalize.first_per_key(df, ["vehicle_id", "s"], "event_id")


@query("b10_snake_case")
def _(t):
    spaced = t.engine_trips.select(F.col("trip_id").alias("Trip Id"), F.col("Trip_Distance_km").alias("Trip Distance km"), "Idle_Percentage")
    return normalize.snake_case(spaced)


@query("b11_coordinate_range")
def _(t):
    far = t.pings.withColumn("lat", F.when(F.col("k") % 10 != 0, F.col("lat") * F.when(F.col("k") == 96, 30.0).otherwise(1.0)))
    return normalize.valid_coordinates(far).select("vehicle_id", "s", "lat", "lon")


@query("b12_non_negative_speed")
def _(t):
    return normalize.non_negative_speed(t.pings.select("vehicle_id", "s", (F.col("speed_kmh") - 5).alias("speed")))


@query("b13_dataset_profile")
def _(t):
    return normalize.dataset_profile(t.pings)


# ---- C: pings -------------------------------------------------------------------------------

def _ends(t: Fixture):
    return t.steps, (F.col("lat_prev"), F.col("lon_prev"), F.col("lat"), F.col("lon"))


@query("c01_haversine")
def _(t):
    df, ends = _ends(t)
    return df.select("vehicle_id", "s", geo.great_circle_km(*ends).alias("km"), geo.great_circle_m(*ends).alias("metres"))


@query("c02_compass_bearing")
def _(t):
    df, ends = _ends(t)
    return df.select("vehicle_id", "s", geo.compass_bearing(*ends).alias("bearing"))


@query("c03_signed_bearing")
def _(t):
    df, ends = _ends(t)
    return df.select("vehicle_id", "s", geo.signed_bearing(*ends).alias("bearing"))


@query("c04_angle_gap")
def _(t):
    return t.pings.select("vehicle_id", "s", geo.angle_gap(F.col("direction").cast("double"), F.col("fuel_level")).alias("gap"))


@query("c05_rolling_median_speed")
def _(t):
    df = points.VEHICLE_LINE.neighbours(points.on_vehicle_line(t.pings), before=["speed_kmh"], after=["speed_kmh"])
    return df.select("vehicle_id", "s", "speed_kmh", points.smoothed_speed().alias("speed_smoothed"))


@query("c06_lag_features")
def _(t):
    df = points.VEHICLE_LINE.neighbours(points.on_vehicle_line(t.pings), before=["ts", "lat", "lon"])
    return df.withColumns(points.lag_features()).select(
        "vehicle_id", "s", "lat_prev", "lon_prev", "time_prev", "time_delta_hours", "gps_step_raw")


STEP_COLUMNS = {
    "c07_implied_speed": ["implied_speed_kmh"], "c08_teleports": ["implied_speed_kmh", "teleport", "gps_step_km"],
    "c09_bad_fixes": ["gps_ok", "gps_step_km"], "c10_odometer_step": ["odo_step_km"],
    "c11_invalid_odometer": ["odo_step_km", "invalid_odo_step"], "c12_calibration_ratio": ["odo_gps_ratio"]}


def _step_query(columns: list[str]):
    def run(t: Fixture) -> DataFrame:
        df = points.point_steps(t.pings).withColumn("teleport", F.coalesce(F.col("implied_speed_kmh") > points.TELEPORT_KMH, F.lit(False)))
        return df.select("vehicle_id", "s", *columns)
    return run


for _name, _columns in STEP_COLUMNS.items():
    query(_name)(_step_query(_columns))


@query("c13_scale_factor")
def _(t):
    return points.scale_factors(t.steps)


@query("c14_fused_distance")
def _(t):
    return points.fuse_distance(points.VEHICLE_LINE.attach(t.steps, points.scale_factors(t.steps))).select(
        "vehicle_id", "s", "scale_factor", "fused_step_km", "from_odometer", "from_gps")


@query("c15_missing_distance")
def _(t):
    return points.fuse_distance(points.VEHICLE_LINE.attach(t.steps, points.scale_factors(t.steps))).select("vehicle_id", "s", "distance_missing")


@query("c16_speeding_labels")
def _(t):
    return points.label_speeding(t.steps).select("vehicle_id", "s", "flagged_over120", "speeding_over120", "exclude_from_metrics")


@query("c17_idle_moving")
def _(t):
    return points.label_motion(t.steps).select("vehicle_id", "s", "is_idle", "is_moving")


@query("c18_quality_counters")
def _(t):
    return points.quality_counters(t.points)


# ---- D: hybrid trips ------------------------------------------------------------------------

@query("d01_hybrid_segmentation")
def _(t):
    return points.number_trips(t.steps).select("vehicle_id", "s", "trip_id")


@query("d02_trip_key")
def _(t):
    return points.number_trips(t.steps).groupBy("trip_key").agg(F.count(F.lit(1)).alias("row_count"))


@query("d03_legacy_numbering")
def _(t):
    return points.number_trips(t.steps, legacy=True).select("vehicle_id", "s", "trip_id")


@query("d04_trip_aggregate")
def _(t):
    return t.all_trips.select("vehicle_id", "trip_id", "Trip_Start_UTC", "Trip_End_UTC", "Trip_Distance_km", "Idle_Time_min", "Moving_Time_min")


@query("d05_trip_kpis")
def _(t):
    return t.all_trips.select("vehicle_id", "trip_id", "Trip_Duration_min", "Avg_Speed_kmh", "Idle_Percentage")


@query("d06_trip_events")
def _(t):
    return t.all_trips.select("vehicle_id", "trip_id", "Speeding_Count", "Flagged_Count")


@query("d07_valid_trips")
def _(t):
    return trips_hybrid.valid_trips(t.all_trips).select("vehicle_id", "trip_id", "Trip_Duration_min", "Trip_Distance_km")


@query("d08_local_date")
def _(t):
    return trips_hybrid.add_local_date(trips_hybrid.valid_trips(t.all_trips)).select("vehicle_id", "trip_id", "Trip_Start_MYT", "date_myt")


@query("d09_vehicle_day")
def _(t):
    return trips_hybrid.aggregate_days(t.trips).drop("Daily_Avg_Speed_kmh", "Daily_Idle_Percentage")


@query("d10_vehicle_day_kpis")
def _(t):
    return trips_hybrid.aggregate_days(t.trips).select("vehicle_id", "date_myt", "Daily_Avg_Speed_kmh", "Daily_Idle_Percentage")


@query("d11_distance_consistency", digits=4)
def _(t):
    return trips_hybrid.distance_consistency(t.points, t.trips)


@query("d12_sanity_bands")
def _(t):
    return trips_hybrid.sanity_bands(t.trips)


@query("d12_suspect_trips")
def _(t):
    return trips_hybrid.suspect_trips(t.trips)


@query("d13_trips_per_vehicle")
def _(t):
    return stats.describe(trips_hybrid.trips_per_vehicle(t.points), ["trips"])


@query("d14_clean_points")
def _(t):
    return points.clean_output(t.points)


@query("d15_pipeline_summary", digits=4)
def _(t):
    return trips_hybrid.pipeline_summary(t.points, t.trips, t.days)


# ---- E: ignition trips ----------------------------------------------------------------------

@query("e01_ignition_segmentation")
def _(t):
    return trips_ignition.engine_on_rows(t.steps).select("vehicle_id", "s", "trip_id")


@query("e02_engine_on_rows")
def _(t):
    return t.engine_rows.select("vehicle_id", "s", "speed_kmh", "engine_on")


@query("e03_time_to_next")
def _(t):
    return trips_ignition.engine_on_rows(t.steps).select("vehicle_id", "s", "delta_t_sec")


@query("e04_idle_moving_raw")
def _(t):
    return t.engine_rows.select("vehicle_id", "s", "is_idle", "is_moving")


@query("e05_trip_aggregate")
def _(t):
    return trips_ignition.aggregate_trips(t.engine_rows).drop("Idle_Time_min", "Moving_Time_min", "total_rows")


TRIP_PARTS = {
    "e06_odometer_distance": ["Trip_Distance_km"], "e07_duration_speed": ["Trip_Duration_min", "Avg_Speed"],
    "e08_idle_moving_minutes": ["Idle_Time_min", "Moving_Time_min", "total_rows"], "e09_idle_fraction": ["Idle_Percentage"],
    "e10_distance_efficiency": ["Distance_Efficiency"], "e11_time_efficiency": ["Time_Efficiency"],
    "e12_idle_efficiency": ["Idle_Efficiency"], "e13_signal_reliability": ["Signal_Reliability"],
    "e15_qa_flags": ["QA_negative_distance", "QA_zero_duration"]}


def _trip_query(columns: list[str]):
    def run(t: Fixture) -> DataFrame:
        trips = trips_ignition.add_distance_duration(trips_ignition.aggregate_trips(t.engine_rows))
        return trips_ignition.add_qa_flags(trips_ignition.add_efficiencies(trips)).select("trip_id", *columns)
    return run


for _name, _columns in TRIP_PARTS.items():
    query(_name)(_trip_query(_columns))


@query("e14_truck_age", digits=4)
def _(t):
    return trips_ignition.truck_ages(t.pings)


@query("e16_trip_table")
def _(t):
    return trips_ignition.trip_output(trips_ignition.trips_table(t.engine_rows, t.pings))


@query("e17_row_table")
def _(t):
    return trips_ignition.row_output(t.engine_rows)


@query("e18_qa_report")
def _(t):
    return trips_ignition.qa_report(t.engine_trips)


@query("e19_vehicle_summary", digits=4)
def _(t):
    return trips_ignition.vehicle_summary(t.engine_trips)


@query("e19_fleet_means", digits=4)
def _(t):
    return trips_ignition.fleet_means(trips_ignition.vehicle_summary(t.engine_trips))


# ---- F: route efficiency, trip features, statistics ------------------------------------------

@query("f01_rows_to_trips")
def _(t):
    return t.merged.select("trip_id", "timestamp", "vehicle_id_trip", "trip_distance_km", "total_rows")


@query("f01_match_rate")
def _(t):
    return route.match_rate(t.merged)


@query("f02_enrichment_join")
def _(t):
    combined = t.engine_rows.select("trip_id", "timestamp", "speed_kmh", "fuel_level")
    return route.enrich(t.merged, combined).select("trip_id", "timestamp", "speed_kmh", "speed_kmh_combined", "fuel_level")


@query("f02_enrichment_all_rows")
def _(t):
    """Every row enriched from all engine rows; the query above, like its SQL answer, takes those above 60 km/h only."""
    combined = t.engine_rows.select("trip_id", "timestamp", "speed_kmh", "fuel_level")
    return route.enrich(t.merged, combined).select("trip_id", "timestamp", "speed_kmh", "speed_kmh_combined", "fuel_level")


@query("f03_route_efficiency")
def _(t):
    return t.scored.select("trip_id", "timestamp", "speed_mps", "dist_to_prev", "time_delta", "implied_speed",
                           "bearing_track", "speed_ratio", "forward_progress", "route_eff")


@query("f04_global_quantile", digits=6)
def _(t):
    return route.speed_scale(t.tracked)


@query("f05_route_diagnostics")
def _(t):
    return route.route_diagnostics(t.scored)


@query("f06_trip_telemetry")
def _(t):
    return route.aggregate_telemetry(t.scored)


@query("f07_route_directness")
def _(t):
    return t.trip_features.select("trip_id", "great_circle_km", "route_directness")


@query("f08_stops")
def _(t):
    return t.trip_features.select("trip_id", "n_stops", "stops_per_km")


@query("f09_trip_ratios")
def _(t):
    return t.trip_features.select("trip_id", "idle_ratio", "speed_cv", "km_per_hour")


@query("f10_calendar_features")
def _(t):
    return t.trip_features.select("trip_id", "hour_of_day", "day_of_week", "is_weekend", "is_peak_hour")


@query("f11_column_classes")
def _(t):
    return route.classify_columns(t.trip_features, {"n_stops": "numeric"})


@query("f12_outlier_clipping")
def _(t):
    return route.clip_outliers(t.trip_features)


@query("f13_analysis_columns")
def _(t):
    return route.analysis_roles(t.trip_features)


@query("f15_feature_ranking", digits=6)
def _(t):
    return stats.feature_ranking(t.analysis, "trip_id", t.numeric_features, t.target)


@query("f16_pearson_matrix", digits=6)
def _(t):
    return stats.pearson_matrix(t.analysis, t.numeric_features, t.target, most=MATRIX_FEATURES)


@query("f17_spearman_matrix", digits=6)
def _(t):
    return stats.spearman_matrix(t.analysis, "trip_id", t.numeric_features, t.target, most=MATRIX_FEATURES)


@query("f18_correlation_summary", digits=6)
def _(t):
    return stats.correlation_summary(t.analysis, "trip_id", t.numeric_features, t.target, most=MATRIX_FEATURES)


@query("f19_histogram")
def _(t):
    return stats.histogram(t.analysis, "route_eff_avg")


@query("f20_value_counts")
def _(t):
    return stats.value_counts(t.analysis, "hour_of_day")


@query("f21_grid_counts")
def _(t):
    return stats.grid_counts(t.analysis, "speed_avg", "route_eff_avg")


@query("f22_linear_trend")
def _(t):
    return stats.linear_trend(t.analysis, t.numeric_features, t.target)


@query("f23_box_statistics")
def _(t):
    return stats.box_statistics(t.analysis, "hour_of_day", t.target, k=BOX_CATEGORIES)


# Numbers the report asks for: features of a matrix, categories of a chart.
MATRIX_FEATURES, BOX_CATEGORIES = 30, 15
KRUSKAL_CATEGORIES = ["hour_of_day", "day_of_week", "is_weekend", "is_peak_hour"]


@query("f24_kruskal_wallis")
def _(t):
    return stats.kruskal_wallis(t.analysis, KRUSKAL_CATEGORIES, t.target, k=BOX_CATEGORIES).drop("kw_pvalue")


@query("f24_kruskal_pvalues", digits=9)
def _(t):
    return stats.kruskal_wallis(t.analysis, KRUSKAL_CATEGORIES, t.target, k=BOX_CATEGORIES)


# Rows of the checked sample, and of the report's.
SAMPLE_ROWS, REPORT_SAMPLE_ROWS = 500, 20_000


@query("f25_seeded_sample")
def _(t):
    """Size of a sample, how much of it is in the table, and how much of it a second draw repeats."""
    rows = t.engine_rows.select("vehicle_id", "s", "event_id", "speed_kmh")
    one, two = stats.seeded_sample(rows, "event_id", SAMPLE_ROWS), stats.seeded_sample(rows.orderBy("speed_kmh"), "event_id", SAMPLE_ROWS)
    found = one.join(rows, one.columns, "left_semi").agg(F.count(F.lit(1))).scalar()
    again = one.join(two, one.columns, "left_semi").agg(F.count(F.lit(1))).scalar()
    return one.agg(F.count(F.lit(1)).alias("sample_rows"), F.count_distinct("event_id").alias("distinct_rows")).select(
        "*", found.alias("rows_in_table"), again.alias("rows_repeated"))


@query("f25_sample_rows")
def _(t):
    rows = t.engine_rows.select("vehicle_id", "s", "event_id", F.round("speed_kmh", 6).alias("speed_kmh"))
    return stats.seeded_sample(rows, "event_id", REPORT_SAMPLE_ROWS)


@query("f26_map_points")
def _(t):
    return stats.map_points(t.analysis, t.target)


@query("f27_temporal_summary")
def _(t):
    return stats.temporal_summary(t.analysis, t.target)


@query("f28_percentile_profile")
def _(t):
    return stats.percentile_profile(t.analysis, [t.target, "idle_efficiency_mean", "time_efficiency_mean"])


@query("f29_describe")
def _(t):
    return stats.describe(t.analysis, t.numeric_features)


@query("f30_insights")
def _(t):
    return stats.insights(stats.feature_ranking(t.analysis, "trip_id", t.numeric_features, t.target))


@query("f31_correlation_t")
def _(t):
    return stats.correlation_tests(stats.feature_ranking(t.analysis, "trip_id", t.numeric_features, t.target)).select(
        "feature", "n", "pearson_t", "spearman_t")


@query("f31_correlation_pvalues", digits=9)
def _(t):
    return stats.correlation_tests(stats.feature_ranking(t.analysis, "trip_id", t.numeric_features, t.target))


# ---- G: dashboard ---------------------------------------------------------------------------

@query("g01_speed_by_day")
def _(t):
    return dashboards.speed_by_day_of_month(t.engine_trips)


@query("g02_driver_ranking")
def _(t):
    return dashboards.driver_ranking(t.days)


@query("g03_direction_breakdown")
def _(t):
    return dashboards.direction_breakdown(t.pings)


@query("g04_vehicle_list")
def _(t):
    return dashboards.vehicle_list(t.days)


@query("g05_thinned_track")
def _(t):
    return dashboards.thinned_track(t.pings, dashboards.TRACK_DEGREES)


@query("g06_thinned_idle_track")
def _(t):
    return dashboards.thinned_track(t.engine_rows.where("is_idle"), dashboards.IDLE_TRACK_DEGREES, "timestamp")


@query("g07_vehicle_stats")
def _(t):
    return dashboards.vehicle_stats(t.days)


@query("g08_next_trip_features", digits=4)
def _(t):
    return dashboards.next_trip_features(t.engine_trips)


@query("g09_map_box")
def _(t):
    return dashboards.in_map_box(t.pings.withColumn("lat", F.col("lat") * 2)).select("vehicle_id", "s", "lat", "lon")


@query("g10_hours_minutes")
def _(t):
    return dashboards.driver_ranking(t.days).select("vehicle", hours_minutes(F.floor(F.round("time", 6) + 0.5)).alias("driven"))


@query("g11_efficiency_percent")
def _(t):
    return t.engine_trips.select("trip_id", dashboards.efficiency_percent(F.col("Idle_Efficiency")).alias("percent"))


# ---- H: features and models ------------------------------------------------------------------

def _telemetry(columns: list[str]):
    return lambda t: features.telemetry_aggregates(t.engine_rows).select("trip_id", *columns)


for _name, _columns in {
        "h01_speed_profile": ["speed_mean", "speed_median", "speed_p25", "speed_p75", "speed_p90", "speed_std",
                              "speed_min", "speed_max", "speed_iqr", "speed_cv"],
        "h02_stop_overspeed": ["stop_count", "overspeed_count", "telemetry_rows"],
        "h03_idle_moving_shares": ["idle_event_count", "idle_percentage_rows", "moving_event_count", "moving_percentage_rows"]}.items():
    query(_name)(_telemetry(_columns))


@query("h04_aggregate_join")
def _(t):
    return features.join_telemetry(t.engine_trips, features.telemetry_aggregates(t.engine_rows)).select(
        "trip_id", "Trip_Distance_km", "speed_mean", "stop_count", "idle_event_count", "moving_event_count")


@query("h05_rates")
def _(t):
    joined = features.join_telemetry(t.engine_trips, features.telemetry_aggregates(t.engine_rows))
    return features.add_rates(joined).select("trip_id", "stop_count_per_100km", "overspeed_count_per_100km",
                                             "idle_events_per_100km", "stop_count_per_hour", "overspeed_count_per_hour")


@query("h06_training_filter")
def _(t):
    return features.trainable(t.engine_trips).select("trip_id", "Trip_Distance_km", "Trip_Duration_min")


FRAME_PARTS = {
    "h07_geo_features": ["haversine_km", "bearing", "delta_lat", "delta_lon"], "h08_detour": ["detour_ratio", "directness_efficiency"],
    "h09_cyclical_time": ["hour_sin", "hour_cos", "dow_sin", "dow_cos"], "h10_operational_ratios": ["idle_ratio", "moving_ratio", "idle_per_km"],
    "h11_distance_bucket": ["distance_bucket"]}


def _frame_query(columns: list[str]):
    return lambda t: features.engineered(features.trainable(t.engine_trips)).select("trip_id", *columns)


for _name, _columns in FRAME_PARTS.items():
    query(_name, digits=4 if _name == "h08_detour" else 5)(_frame_query(_columns))


@query("h12_target_fixed_speed")
def _(t):
    df = features.engineered(features.trainable(t.engine_trips))
    return df.select("trip_id", features.target_fixed_speed().alias("route_efficiency"))


@query("h13_target_bucket_speed")
def _(t):
    references = features.reference_speeds(t.frame.where("is_train"))
    return features.add_target_bucket_speed(t.frame.drop(features.TARGET), references).select(
        "trip_id", "speed_efficiency", "route_efficiency")


@query("h14_time_split")
def _(t):
    df = features.trainable(t.engine_trips)
    return features.time_split(df).select("trip_id", "is_train")


@query("h15_zones")
def _(t):
    """Whether zones are in range, and how many zones a start or end point has."""
    zones = model.apply_zones(t.frame, model.fit_zones(t.frame.where("is_train")))
    out = zones.select("trip_id", *model.ZONE_COLUMNS, *ENDS)
    for zone, place in model.ZONE_COLUMNS.items():
        of_point = zones.groupBy(*place).agg(F.count_distinct(zone).alias(f"{zone}_per_point"))
        out = out.join(of_point, place).withColumn(f"{zone}_valid", F.col(zone).between(0, model.ZONES - 1))
    return out.select("trip_id", *[f"{z}{x}" for z in model.ZONE_COLUMNS for x in ("_valid", "_per_point")])


@query("h15_zone_ids")
def _(t):
    return model.apply_zones(t.frame, model.fit_zones(t.frame.where("is_train"))).select("trip_id", *model.ZONE_COLUMNS)


@query("h16_target_encoding")
def _(t):
    rows = t.frame.where("is_train")
    overall = rows.agg(F.avg(features.TARGET)).scalar()
    return features.encode_vehicle(t.frame, features.vehicle_means(rows), overall).select("trip_id", "vehicle_id_encoded")


def _vectors(t: Fixture) -> DataFrame:
    return t.trained[0].vectors(t.frame)


@query("h17_one_hot")
def _(t):
    """The distance bucket that is set, if any, and whether zones set one flag at most."""
    from pyspark.ml.functions import vector_to_array
    labels = t.trained[0].encoder.stages[0].labelsArray[model.CATEGORICAL.index("distance_bucket")]
    flags = {c: vector_to_array(f"_h_{c}") for c in model.CATEGORICAL}
    names = F.array(*map(F.lit, labels))
    set_at = F.array_position(flags["distance_bucket"], F.lit(1.0)).cast("int")
    total = {c: F.aggregate(f, F.lit(0.0), lambda a, x: a + x) for c, f in flags.items()}
    return _vectors(t).select("trip_id", F.when(set_at > 0, F.element_at(names, set_at)).alias("level"), total["distance_bucket"].alias("flags_set"),
                              (total["zone_start_id"].isin(0.0, 1.0) & total["zone_end_id"].isin(0.0, 1.0)).alias("zones_valid"))


@query("h18_null_fill")
def _(t):
    names = ["Age_of_Truck_months", "Avg_Speed", "speed_std"]
    return features.fill_features(t.frame.select("trip_id", *names), names)


@query("h19_feature_vector")
def _(t):
    """Every numeric slot of the vector, and whether its width is that of the slots and the seen levels."""
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("features")
    numeric = [*features.NUMERIC_FEATURES["telemetry"], features.ENCODED_VEHICLE]
    levels = sum(len(x) for x in t.trained[0].encoder.stages[0].labelsArray)
    return _vectors(t).select("trip_id", (F.size(v) == len(numeric) + levels).alias("width_fits"),
                              *[v[i].alias(f"slot_{c.lower()}") for i, c in enumerate(numeric)])


@query("h20_scaled_features")
def _(t):
    from pyspark.ml.functions import vector_to_array
    scaler = t.trained[0].ridge.stages[0]
    v = vector_to_array("scaled")
    return scaler.transform(_vectors(t)).select("trip_id", v[0].alias("trip_distance_scaled"), v[2].alias("avg_speed_scaled"))


def _finite_predictions(df: DataFrame) -> DataFrame:
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < 10)
    return df.select("trip_id", "is_train", features.TARGET, finite.alias("prediction_finite"))


@query("h21_ridge")
def _(t):
    return _finite_predictions(t.trained[0].ridge.transform(_vectors(t)))


@query("h21_ridge_predictions")
def _(t):
    return t.trained[0].ridge.transform(_vectors(t)).select("trip_id", "is_train", features.TARGET, "prediction")


@query("h22_boosted_trees")
def _(t):
    return _finite_predictions(t.trained[0].trees.transform(_vectors(t)))


@query("h22_boosted_tree_predictions")
def _(t):
    return t.trained[0].trees.transform(_vectors(t)).select("trip_id", "is_train", features.TARGET, "prediction")


def _score_flags(scores: DataFrame) -> DataFrame:
    """Rows per model and split, and what must hold for scores of any model."""
    return scores.select("model", "split", "n", (F.col("mae") <= F.col("rmse") + 1e-12).alias("mae_below_rmse"),
                         (F.col("r2") <= 1).alias("r2_at_most_1"), ((F.col("split") == "test") | (F.col("r2") > 0)).alias("learnt"))


@query("h23_regression_metrics")
def _(t):
    return _score_flags(t.trained[1])


@query("h23_regression_scores")
def _(t):
    return t.trained[1]


@query("h23_trips_model")
def _(t):
    """Scores of the trips-only model, which has a target of its own."""
    return _score_flags(t.trained_on_trips[1])


@query("h23_trips_model_scores")
def _(t):
    return t.trained_on_trips[1]


@query("h24_feature_importance")
def _(t):
    """Families of the numeric inputs, and whether the importances of all inputs add up to 1."""
    names = model.feature_names(_vectors(t))
    table = model.feature_importance(t.trained[0], names)
    total = table.agg(F.sum("importance")).scalar()
    numeric = [*features.NUMERIC_FEATURES["telemetry"], features.ENCODED_VEHICLE]
    return table.where(F.col("feature").isin(numeric)).select(
        "feature", "is_telemetry", "is_geo", "is_time", (F.col("importance") >= 0).alias("not_negative"), (F.abs(total - 1) < 1e-6).alias("adds_up"))


@query("h24_importance_values")
def _(t):
    """Importances of all inputs, one-hot ones too."""
    return model.feature_importance(t.trained[0], model.feature_names(_vectors(t)))


@query("h25_model_comparison")
def _(t):
    """Whether the comparison names the better model, and its gains follow from the scores."""
    c = model.compare_models(t.trained[1])
    better = lambda test: F.when(test, "boosted_trees").otherwise("ridge")
    return c.select((F.col("best_by_mae") == better(F.col("trees_mae") < F.col("ridge_mae"))).alias("mae_named"),
                    (F.col("best_by_r2") == better(F.col("trees_r2") > F.col("ridge_r2"))).alias("r2_named"),
                    ((F.col("mae_gain_percent") > 0) == (F.col("trees_mae") < F.col("ridge_mae"))).alias("gain_follows"))


@query("h25_comparison_values")
def _(t):
    return model.compare_models(t.trained[1])


@query("h26_model_bundle")
def _(t):
    rounds = F.col("best_iteration").between(1, model.BOOSTING_ROUNDS["telemetry"])
    return t.trained[0].metadata.select("model_version", "feature_set", "global_mean", "epsilon", "stop_threshold_kmh", "overspeed_threshold_kmh",
                                        "train_size", "test_size", rounds.alias("rounds_valid"), (F.col("test_mae") < 1).alias("mae_valid"))


@query("h26_bundle_metadata")
def _(t):
    return t.trained[0].metadata


@query("h27_target_correlations", digits=6)
def _(t):
    return features.target_correlations(t.frame)


def _requests(t: Fixture) -> DataFrame:
    """Trips as scoring requests: the idle share in percent, some optional fields left out or zero."""
    e = F.col("trip_id")
    return t.frame.select(
        "trip_id", "vehicle_id", "timestamp_start", "lat_start", "lon_start", "lat_end", "lon_end", "Trip_Distance_km",
        F.when(e % 11 != 0, F.col("Trip_Duration_min")).otherwise(F.lit(0.0)).alias("Trip_Duration_min"),
        "Idle_Time_min", "Moving_Time_min", "Avg_Speed",
        (F.col("Idle_Percentage") * F.when(e % 13 == 0, 1000).otherwise(100)).alias("Idle_Percentage"),
        F.coalesce("Age_of_Truck_months", F.lit(0.0)).alias("Age_of_Truck_months"),
        F.when(e % 3 != 0, F.col("speed_mean")).alias("speed_mean"), F.when(e % 2 == 0, F.col("speed_median")).alias("speed_median"),
        F.when(e % 5 == 0, F.lit(0.0)).otherwise(F.col("speed_p25")).alias("speed_p25"), "speed_p75",
        F.when(e % 7 != 0, F.col("stop_count")).alias("stop_count"), "moving_event_count", "idle_event_count")


@query("h28_scoring_defaults")
def _(t):
    return features.fill_speed_defaults(features.with_optional_fields(_requests(t))).select(
        "trip_id", "speed_mean", "speed_median", "speed_p25", "speed_p75", "speed_p90", "speed_std", "speed_min", "speed_max", "speed_iqr", "speed_cv")


@query("h29_scoring_counts")
def _(t):
    valid = features.validate_requests(_requests(t)).where("rejected_fields = ''")
    return features.fill_count_defaults(features.with_optional_fields(valid)).select(
        "trip_id", "stop_count", "overspeed_count", "telemetry_rows", "idle_percentage_rows", "moving_percentage_rows", "stop_count_per_hour")


@query("h30_request_validation")
def _(t):
    return features.validate_requests(_requests(t)).select("trip_id", "rejected_fields")


@query("h31_batch_scoring")
def _(t):
    """Rejected fields as validated, and a score between 0 and 1 for exactly the valid requests."""
    score = F.col("predicted_route_efficiency")
    return model.score_requests(_requests(t), t.trained[0]).select(
        "trip_id", "vehicle_id", "rejected_fields", score.isNotNull().alias("scored"), F.coalesce(score.between(0, 1), F.lit(True)).alias("in_range"))


@query("h31_batch_scores")
def _(t):
    return model.score_requests(_requests(t), t.trained[0]).select(
        "trip_id", "vehicle_id", "rejected_fields", "predicted_route_efficiency", "model_version")
