"""Ping-level cleaning: smoothing, step distances, odometer/GPS fusion, labels."""

from pyspark.sql import Column, DataFrame, functions as F

from haulmetrics.functions.geo import great_circle_km
from haulmetrics.functions.scalars import clip, is_true, middle_of_three, ratio, total
from haulmetrics.operators.normalize import time_order
from haulmetrics.operators.quantiles import HOT_ROWS, aggregate_with_quantiles
from haulmetrics.operators.timeline import BUCKET_SECONDS, Timeline, time_bucket

TELEPORT_KMH = 140
ODOMETER_JUMP_KM, ODOMETER_JUMP_SECONDS = 50, 60
CALIBRATION_KM, CALIBRATION_KMH = (0.01, 5.0), 120
SCALE_RANGE = (0.8, 1.2)
SPEED_LIMIT_KMH = 120
TRIP_GAP_MINUTES = 15
VEHICLE_LINE = Timeline(("vehicle_id",), ("seq",))
STEP_COLUMNS = [
    "lat_prev", "lon_prev", "time_prev", "time_delta_hours", "time_delta_min", "gps_step_raw", "speed_smoothed", "odo_step_km",
    "starts_trip", "first_ping", "starts_ignition", "ignitions_inside", "to_next_on_sec", "implied_speed_kmh", "invalid_odo_step", "gps_step_km", "odo_gps_ratio"]

CLEAN_COLUMNS = [
    "timestamp_utc", "vehicle_id", "engine_on", "speed_kmh", "speed_smoothed", "odometer_km", "lat", "lon",
    "gps_ok", "gps_step_km", "time_delta_hours", "time_delta_min", "odo_step_km", "invalid_odo_step",
    "scale_factor", "fused_step_km", "distance_missing", "implied_speed_kmh", "flagged_over120",
    "speeding_over120", "exclude_from_metrics", "trip_id", "trip_key", "is_idle", "is_moving"]


def on_vehicle_line(df: DataFrame, width_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Add the sort key `seq` and its time bucket."""
    seq = time_order(F.col("ts"))
    return df.withColumns({"seq": seq, "bucket": time_bucket(seq, width_seconds)})


def smoothed_speed() -> Column:
    """Centred median over three pings of a vehicle. Expects `prev` and `next` speeds."""
    return middle_of_three(F.col("prev.speed_kmh"), F.col("speed_kmh"), F.col("next.speed_kmh"))


def lag_features() -> dict[str, Column]:
    """Previous place and time, hours since, and great-circle step."""
    hours = (F.unix_micros("ts") - F.unix_micros("prev.ts")) / F.lit(1e6) / 3600
    return {"lat_prev": F.col("prev.lat"), "lon_prev": F.col("prev.lon"), "time_prev": F.col("prev.ts"),
            "time_delta_hours": hours, "time_delta_min": hours * 60,
            "gps_step_raw": great_circle_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))}


def implied_speed(step_km: Column, hours: Column) -> Column:
    return F.when(hours > 0, step_km / hours)


def valid_gps_step(step_km: Column, implied: Column, gps_ok: Column) -> Column:
    """The step, or NULL after a teleport or on a bad fix."""
    return F.when(~is_true(implied > TELEPORT_KMH) & is_true(gps_ok), step_km)


def invalid_odometer(step_km: Column, hours: Column) -> Column:
    jump = (step_km > ODOMETER_JUMP_KM) & (hours < F.lit(ODOMETER_JUMP_SECONDS / 3600))
    return is_true(step_km < 0) | is_true(jump)


def calibration_ratio() -> Column:
    """GPS over odometer distance on segments both can be trusted on, else NULL."""
    low, high = CALIBRATION_KM
    trusted = (F.col("gps_ok") & F.col("gps_step_km").isNotNull() & F.col("odo_step_km").between(low, high)
               & ~F.col("invalid_odo_step") & (F.col("implied_speed_kmh") <= CALIBRATION_KMH))
    return F.when(trusted, F.col("gps_step_km") / F.col("odo_step_km"))


def hybrid_trip_start() -> Column:
    """Engine off -> on, or a silence of 15 minutes or more. No previous ping counts as off."""
    ignition = ~is_true(F.col("prev.engine_on")) & F.col("engine_on")
    silence = (F.unix_micros("ts") - F.unix_micros("prev.ts")) / F.lit(1e6) / 60 >= TRIP_GAP_MINUTES
    return is_true(ignition) | is_true(silence)


def ignition_columns() -> dict[str, Column]:
    """Whether the engine was just switched on, and seconds to the next ping if its engine is on."""
    gap = (F.unix_micros("next.ts") - F.unix_micros("ts")) / F.lit(1e6)
    return {"starts_ignition": F.col("engine_on") & ~is_true(F.col("prev.engine_on")),
            "to_next_on_sec": F.when(is_true(F.col("next.engine_on")), gap)}


def point_steps(pings: DataFrame, width_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Everything about a ping that needs only its neighbours in time, for both kinds of trips."""
    df = VEHICLE_LINE.neighbours(
        on_vehicle_line(pings, width_seconds),
        before=["ts", "lat", "lon", "odometer_km", "engine_on", "speed_kmh"], after=["ts", "engine_on", "speed_kmh"])
    df = df.withColumns({
        **lag_features(), **ignition_columns(), "speed_smoothed": smoothed_speed(), "odo_step_km": F.col("odometer_km") - F.col("prev.odometer_km"),
        "starts_trip": hybrid_trip_start(), "first_ping": F.col("prev").isNull()}).drop("prev", "next")
    # the rows lie in pieces here, so the count costs no shuffle of its own
    df = df.withColumn("ignitions_inside", VEHICLE_LINE.running_inside(F.col("starts_ignition").cast("int")))
    df = df.withColumns({
        "implied_speed_kmh": implied_speed(F.col("gps_step_raw"), F.col("time_delta_hours")),
        "invalid_odo_step": invalid_odometer(F.col("odo_step_km"), F.col("time_delta_hours"))})
    df = df.withColumn("gps_step_km", valid_gps_step(F.col("gps_step_raw"), F.col("implied_speed_kmh"), F.col("gps_ok")))
    return df.withColumn("odo_gps_ratio", calibration_ratio())


def scale_factors(steps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Clipped median calibration ratio per vehicle that has one."""
    medians = aggregate_with_quantiles(
        steps.where(F.col("odo_gps_ratio").isNotNull()).select("vehicle_id", "odo_gps_ratio"),
        ["vehicle_id"], [], {"median_ratio": ("odo_gps_ratio", 0.5)}, hot_rows)
    return medians.select("vehicle_id", clip(F.col("median_ratio"), *SCALE_RANGE).alias("scale"))


def fuse_distance(steps: DataFrame) -> DataFrame:
    """Scaled odometer step, else GPS step, else 0; and whether neither source was usable.

    Expects the vehicle's `scale`; NULL means 1.
    """
    odometer_ok = F.col("odo_step_km").isNotNull() & ~F.col("invalid_odo_step") & (F.col("odo_step_km") >= 0)
    scale = F.coalesce("scale", F.lit(1.0))
    fused = (F.when(odometer_ok, F.col("odo_step_km") * scale).when(F.col("gps_step_km").isNotNull(), F.col("gps_step_km"))
             .otherwise(F.lit(0.0)))
    no_source = F.col("gps_step_km").isNull() & (F.col("odo_step_km").isNull() | F.col("invalid_odo_step"))
    return steps.withColumns({
        "scale_factor": scale, "from_odometer": odometer_ok, "from_gps": ~odometer_ok & F.col("gps_step_km").isNotNull(),
        "fused_step_km": fused, "distance_missing": no_source & (fused == 0)}).drop("scale")


def label_speeding(df: DataFrame) -> DataFrame:
    fast = is_true(F.col("speed_smoothed") > SPEED_LIMIT_KMH)
    good = is_true(F.col("gps_ok"))
    return df.withColumns({"flagged_over120": ~good & fast, "speeding_over120": good & fast, "exclude_from_metrics": ~good & fast})


def label_motion(df: DataFrame) -> DataFrame:
    """Idle and moving by smoothed speed, with the engine on."""
    return df.withColumns({"is_idle": F.col("engine_on") & is_true(F.col("speed_smoothed") < 1),
                           "is_moving": F.col("engine_on") & is_true(F.col("speed_smoothed") >= 1)})


def number_trips(steps: DataFrame, legacy: bool = False, per_vehicle: DataFrame | None = None) -> DataFrame:
    """Add `trip_id` (running number per vehicle) and `trip_key`, and the columns of `per_vehicle`.

    With `legacy`, the first ping never opens a trip, so numbering starts at 0.
    """
    starts = F.col("starts_trip") & ~F.col("first_ping") if legacy else F.col("starts_trip")
    df = VEHICLE_LINE.running(steps, {"trip_id": starts.cast("int")}, per_vehicle)
    return df.withColumn("trip_key", F.concat_ws("_", "vehicle_id", F.col("trip_id").cast("string")))


def clean_points(steps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fully labelled pings. Reads `steps` several times: pass the staged table."""
    df = fuse_distance(number_trips(steps, per_vehicle=scale_factors(steps, hot_rows)))
    return label_motion(label_speeding(df)).withColumnRenamed("ts", "timestamp_utc")


def clean_output(points: DataFrame) -> DataFrame:
    """The 25 columns of the cleaned-point file."""
    return points.select(*CLEAN_COLUMNS)


def quality_counters(points: DataFrame) -> DataFrame:
    """Data-quality counts and distance totals, as one row."""
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.count("gps_step_raw").alias("gps_steps"),
        F.count_if(F.col("implied_speed_kmh") > TELEPORT_KMH).alias("teleports"),
        F.count_if(~is_true(F.col("gps_ok"))).alias("bad_fixes"),
        F.count("gps_step_km").alias("valid_gps_steps"),
        F.count("odo_step_km").alias("odometer_steps"),
        F.count_if("invalid_odo_step").alias("invalid_odometer_steps"),
        F.count("odo_gps_ratio").alias("calibration_segments"),
        F.count_if("from_odometer").alias("from_odometer"),
        F.count_if("from_gps").alias("from_gps"),
        F.count_if("distance_missing").alias("distance_missing"),
        F.count_if("speeding_over120").alias("speeding"),
        F.count_if("flagged_over120").alias("flagged"),
        F.count_if("exclude_from_metrics").alias("excluded"),
        F.count_if("is_idle").alias("idle_points"),
        F.count_if("is_moving").alias("moving_points"),
        total(F.col("fused_step_km")).alias("fused_km"),
        ratio(F.sum("fused_step_km"), F.count("fused_step_km")).alias("mean_step_km"))
