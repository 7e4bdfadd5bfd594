"""Route efficiency per row, trip features, column classes, outlier clipping."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulmetrics.functions.geo import compass_bearing, great_circle_km, great_circle_m
from haulmetrics.functions.scalars import clip, is_true, ratio
from haulmetrics.operators.quantiles import HOT_ROWS, aggregate_with_quantiles, as_struct, global_quantiles
from haulmetrics.operators.timeline import BUCKET_SECONDS, Timeline, time_bucket

STATIONARY_MPS = 0.5
JUMP_MPS = 60.0
SPEED_SCALE_QUANTILE = 0.95
CLIP_QUANTILES = (0.005, 0.995)
TRIP_LINE = Timeline(("trip_id",), ("seq",))

# Allowed range per column before quantile clipping.
DOMAIN_CAPS = {
    "speed_mps": (0, 45),
    "implied_speed": (0, 60),
    "movement_speed": (0, 60),
    "time_delta": (0, 600),
    "dist_to_prev": (0, 10000),
    "age_of_truck_months": (0, 240),
    "trip_distance_km": (0, 5000),
    "trip_duration_min": (0, 1440),
    "idle_time_min": (0, 1440),
    "moving_time_min": (0, 1440),
}
# Columns never analysed.
DROP_COLUMNS = ["trip_id", "vehicle_id", "vehicle_id_trip", "number_plate", "vin", "license",
                "filename", "file_name", "file_path"]
# Columns left out of correlations.
EXCLUDED_COLUMNS = [
    "forward_progress", "speed_kmh", "speed_mps", "movement_speed", "implied_speed", "speed_ratio",
    "dist_to_prev", "time_delta", "bearing_track", "lat", "lon", "lat_prev", "lon_prev", "lat_start", "lon_start",
    "lat_end", "lon_end", "timestamp", "timestamp_start", "timestamp_end", "total_rows", "avg_speed"]
# Targets in order of preference, columns of one kind by name, rush hours.
TARGETS = ["route_eff", "idle_efficiency", "distance_efficiency", "time_efficiency"]
FALLBACK_TARGET = "route_eff_avg"
LEAKING_COLUMNS = ["route_eff_med", "route_eff_std", "route_eff_high_pct"]
GEO_NAMES = ["lat", "latitude", "lon", "longitude", "lat_prev", "lon_prev"]
ID_FRAGMENTS = ["id", "uuid", "vin", "key"]
PEAK_HOURS = [7, 8, 9, 17, 18, 19]


def _suffixed(trips: DataFrame, rows: DataFrame) -> DataFrame:
    return trips.withColumnsRenamed({c: c + "_trip" for c in trips.columns if c in rows.columns and c != "trip_id"})


def join_trips(rows: DataFrame, trips: DataFrame) -> DataFrame:
    """Rows left-joined to their trip; clashing trip columns get the suffix `_trip`."""
    return rows.join(_suffixed(trips, rows), "trip_id", "left")


def match_rate(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("row_count"),
                      F.avg(F.col("vehicle_id_trip").isNotNull().cast("int")).alias("match_rate"))


def enrich(merged: DataFrame, combined: DataFrame) -> DataFrame:
    """Left-join combined data by trip and time, by trip, or not at all, by the keys it has."""
    if "trip_id" not in combined.columns:
        return merged
    keys = ["trip_id", "timestamp"] if "timestamp" in combined.columns else ["trip_id"]
    clash = {c: c + "_combined" for c in combined.columns if c in merged.columns and c not in keys}
    return merged.join(combined.withColumnsRenamed(clash), keys, "left")


def track_features(rows: DataFrame, trips: DataFrame | None = None, width_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Speed, step, bearing and movement speed against the previous row of the trip.

    With `trips`, the columns of the trip come along as in `join_trips`, by way of the pieces of
    the trip's timeline, so the rows are not shuffled again.
    """
    cut = (rows.withColumn("seq", F.unix_micros("timestamp"))
           .withColumn("bucket", time_bucket(F.col("seq"), width_seconds)))
    df = TRIP_LINE.neighbours(cut, before=["seq", "lat", "lon", "speed_kmh"])
    here = (F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    df = df.withColumns({
        "speed_mps": F.col("speed_kmh") / F.lit(3.6), "speed_mps_prev": F.col("prev.speed_kmh") / F.lit(3.6),
        "first_of_trip": F.col("prev").isNull(), "dist_to_prev": great_circle_m(*here), "bearing_any": compass_bearing(*here),
        "time_delta": (F.col("seq") - F.col("prev.seq")) / F.lit(1e6)}).drop("prev")
    df = df.withColumn("implied_speed", ratio(F.col("dist_to_prev"), F.col("time_delta")))
    unreliable = is_true(F.col("implied_speed") > JUMP_MPS)
    if trips is not None:
        df = TRIP_LINE.attach(df, _suffixed(trips, rows))
    return df.withColumns({
        "bearing_track": F.when(~unreliable, F.col("bearing_any")), "movement_speed": F.col("implied_speed"),
        "speed_ratio": ratio(F.col("implied_speed"), F.col("speed_mps"))}).drop("bearing_any", "bucket")


def forward_progress() -> Column:
    """The smaller of reported and movement speed; 0 when stationary, unknown without a bearing."""
    reported, moved = F.col("speed_mps"), F.col("movement_speed")
    slower = F.when(reported.isNotNull(), F.least(reported, moved))
    return F.when(F.col("bearing_track").isNotNull(),
                  F.when(reported < STATIONARY_MPS, F.lit(0.0)).otherwise(slower))


def speed_scale(tracked: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """95th percentile of speed over all rows, as one row."""
    return global_quantiles(tracked.select("speed_mps"), {"speed_p95": ("speed_mps", SPEED_SCALE_QUANTILE)}, hot_rows)


def route_efficiency(tracked: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `forward_progress` and `route_eff`. `tracked` is read twice: pass the staged table."""
    scale = speed_scale(tracked, hot_rows).scalar()
    return (tracked.withColumn("forward_progress", forward_progress())
            .withColumn("route_eff", clip(ratio(F.col("forward_progress"), scale), 0, 1)))


def route_diagnostics(scored: DataFrame) -> DataFrame:
    speed, eff = F.col("speed_mps"), F.col("route_eff")
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(speed < STATIONARY_MPS).alias("stationary"), F.count_if(speed >= STATIONARY_MPS).alias("moving"),
        F.count_if(eff == 0).alias("zero_efficiency"), F.count_if(eff > 0.5).alias("above_half"),
        F.count_if(F.col("implied_speed") > JUMP_MPS).alias("unreliable"),
        F.count_if(eff.isNull()).alias("unknown"), F.avg(eff.isNull().cast("int")).alias("unknown_share"))


def aggregate_telemetry(scored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per trip. `idle_time_total` adds the trip value once per row, as its consumers expect.

    A trip's own measures are equal on all its rows; `max` gives their mean and, times the row count, their
    sum without rounding noise.
    """
    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))

    def once_per_row(c: str) -> Column:
        return F.coalesce(F.max(c), F.lit(0.0)) * F.count(c)

    eff, speed = F.col("route_eff"), F.col("speed_mps")
    moving = is_true(speed > STATIONARY_MPS)
    changed = F.col("first_of_trip") | (moving != is_true(F.col("speed_mps_prev") > STATIONARY_MPS))
    aggs = [
        F.min("timestamp").alias("trip_start"), F.max("timestamp").alias("trip_end"),
        first("lat").alias("lat_start"), last("lat").alias("lat_end"),
        first("lon").alias("lon_start"), last("lon").alias("lon_end"),
        F.avg(eff).alias("route_eff_avg"), F.stddev_samp(eff).alias("route_eff_std"),
        F.avg(is_true(eff > 0.5).cast("int")).alias("route_eff_high_pct"),
        F.avg(speed).alias("speed_avg"), F.stddev_samp(speed).alias("speed_std"), F.max(speed).alias("speed_max"),
        once_per_row("idle_time_min").alias("idle_time_total"), once_per_row("moving_time_min").alias("moving_time_total"),
        F.max("idle_percentage").alias("idle_percentage"), F.max("idle_efficiency").alias("idle_efficiency_mean"),
        first("trip_distance_km").alias("trip_distance_km"), first("trip_duration_min").alias("trip_duration_min"),
        F.max("distance_efficiency").alias("distance_efficiency_mean"),
        F.max("time_efficiency").alias("time_efficiency_mean"),
        F.max("signal_reliability").alias("signal_reliability"),
        F.count("speed_kmh").alias("n_telemetry_points"),
        (F.count_if(changed) / F.lit(2.0)).alias("n_stops")]
    return aggregate_with_quantiles(scored, ["trip_id"], aggs, {
        "route_eff_med": ("route_eff", 0.5), "speed_p10": ("speed_mps", 0.1), "speed_p90": ("speed_mps", 0.9)}, hot_rows)


def add_trip_features(trips: DataFrame) -> DataFrame:
    """Directness, stop rate, idle ratio, variability and calendar features."""
    km, start = F.col("trip_distance_km"), F.col("trip_start")
    return (trips.withColumn("great_circle_km", great_circle_km(
                F.col("lat_start"), F.col("lon_start"), F.col("lat_end"), F.col("lon_end")))
            .withColumn("route_directness", clip(ratio(F.col("great_circle_km"), km), 0, 1))
            .withColumn("stops_per_km", ratio(F.col("n_stops"), km))
            .withColumn("idle_ratio", ratio(F.col("idle_time_total"), F.col("idle_time_total") + F.col("moving_time_total")))
            .withColumn("speed_cv", ratio(F.col("speed_std"), F.col("speed_avg")))
            .withColumn("hour_of_day", F.hour(start).cast("bigint"))
            .withColumn("day_of_week", F.weekday(start).cast("bigint"))
            .withColumn("is_weekend", F.col("day_of_week").isin(5, 6).cast("bigint"))
            .withColumn("is_peak_hour", F.col("hour_of_day").isin(PEAK_HOURS).cast("bigint"))
            .withColumn("km_per_hour", ratio(km, F.col("trip_duration_min") / 60)))


def trip_features(scored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return add_trip_features(aggregate_telemetry(scored, hot_rows))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: Spark type, distinct non-NULL values, rows.

    Values are counted as (column, value) pairs: one narrow shuffle for all columns.
    """
    def text(f: T.StructField) -> Column:
        plain = F.col(f.name) + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        return plain.cast("string")

    cells = df.select(F.posexplode(F.array(*[text(f) for f in df.schema.fields])).alias("pos", "value"))
    distinct = cells.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    lines = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(_kind(f.dataType)).alias("kind")) for f in df.schema.fields])
    return (distinct.groupBy("pos").agg(F.sum("n").alias("row_count"), F.count("value").alias("distinct_values"))
            .select("row_count", lines[F.col("pos")]["name"].alias("column_name"),
                    lines[F.col("pos")]["kind"].alias("kind"), "distinct_values"))


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "number" if isinstance(dtype, T.NumericType) else "text"


def classify_columns(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row per column with its analysis class."""
    name = F.lower("column_name")
    distinct_share = ratio(F.col("distinct_values"), F.col("row_count"))
    id_name = F.lit(False)
    for fragment in ID_FRAGMENTS:
        id_name = id_name | name.contains(fragment)
    chosen = F.lit(None).cast("string")
    for column, kind in (overrides or {}).items():
        chosen = F.when(F.col("column_name") == column, kind).otherwise(chosen)
    rule = (F.when(F.col("kind") == "datetime", "datetime")
            .when(name.isin(GEO_NAMES), "geospatial")
            .when(F.col("kind") == "boolean", "categorical")
            .when((distinct_share > 0.9) | (id_name & (distinct_share > 0.5)), "id_like")
            .when((F.col("kind") == "number") & ((F.col("distinct_values") > 10) | id_name), "numeric")
            .otherwise("categorical"))
    return column_profile(df).select("column_name", "distinct_values", F.coalesce(chosen, rule).alias("column_class"))


def columns_of_class(df: DataFrame, wanted: str, overrides: dict[str, str] | None = None) -> list[str]:
    """Names of one class in table order: a schema-level decision from one row per column."""
    found = {r.column_name for r in classify_columns(df, overrides).where(F.col("column_class") == wanted).collect()}
    return [c for c in df.columns if c in found]


def clip_outliers(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Clamp every numeric column but ids to its domain range, then to its 0.5/99.5 percentiles."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in DROP_COLUMNS]
    capped = df.withColumns({c: clip(F.col(c), *DOMAIN_CAPS[c]) for c in numeric if c in DOMAIN_CAPS})
    low, high = CLIP_QUANTILES
    wanted = {f"{side}_{c}": (c, p) for c in numeric for side, p in (("_low", low), ("_high", high))}
    limits = as_struct(global_quantiles(capped.select(*numeric), wanted, hot_rows))
    clamped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_limits._low_{c}"), F.least(
        F.col(f"_limits._high_{c}"), F.col(c).cast("double")))) for c in numeric}
    return capped.withColumn("_limits", limits).withColumns(clamped).select(*df.columns)


def choose_target(columns: list[str]) -> str | None:
    for target in TARGETS:
        if target in columns:
            return target
    return FALLBACK_TARGET if FALLBACK_TARGET in columns else None


def feature_candidates(numeric: list[str], target: str, keep_leaking: bool = True) -> list[str]:
    """Numeric columns fit for ranking. `keep_leaking=False` also drops other statistics of the target."""
    out = [c for c in numeric if c not in EXCLUDED_COLUMNS and c not in DROP_COLUMNS and c != target]
    return out if keep_leaking else [c for c in out if c not in LEAKING_COLUMNS]


def analysis_roles(df: DataFrame, keep_leaking: bool = True) -> DataFrame:
    """One row per column: dropped, target, excluded, feature or other."""
    name = F.col("column_name")
    left_out = EXCLUDED_COLUMNS if keep_leaking else [*EXCLUDED_COLUMNS, *LEAKING_COLUMNS]
    role = (F.when(name.isin(DROP_COLUMNS), "dropped").when(name == choose_target(df.columns), "target")
            .when(name.isin(left_out), "excluded").when(F.col("column_class") == "numeric", "feature").otherwise("other"))
    return classify_columns(df).select("column_name", "column_class", role.alias("role"))
