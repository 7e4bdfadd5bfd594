"""Training and scoring features of trips, and the efficiency target."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from haulmetrics.functions.geo import great_circle_km, signed_bearing
from haulmetrics.functions.scalars import clip, is_true
from haulmetrics.operators.quantiles import HOT_ROWS, aggregate_with_quantiles, as_struct
from haulmetrics.operators.timeline import Timeline, time_bucket

EPSILON = 1e-6
STOP_KMH, OVERSPEED_KMH = 3.0, 90.0
TARGET_SPEED_KMH = 60
TRAIN_SHARE = 0.8
TARGET = "route_efficiency"
TIE_BUCKET_IDS = 1_000_000

# Right-closed upper ends of the distance buckets and their labels.
DISTANCE_BUCKETS = [(10, "0-10km"), (50, "10-50km"), (200, "50-200km"), (None, "200+km")]

TRIP_NUMERIC = ["Trip_Distance_km", "Trip_Duration_min", "Avg_Speed", "Idle_Time_min", "Moving_Time_min", "Idle_Percentage"]
PLACE_NUMERIC = ["bearing", "delta_lat", "delta_lon", "lat_start", "lon_start", "lat_end", "lon_end"]
TIME_NUMERIC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
TELEMETRY_NUMERIC = [
    "speed_mean", "speed_median", "speed_p25", "speed_p75", "speed_p90", "speed_std", "speed_iqr", "speed_cv",
    "stop_count", "stop_count_per_100km", "stop_count_per_hour",
    "overspeed_count", "overspeed_count_per_100km", "overspeed_count_per_hour",
    "idle_event_count", "idle_percentage_rows", "idle_events_per_100km",
    "moving_event_count", "moving_percentage_rows"]
# Numeric model inputs, in order, of the telemetry model and of the trips-only model.
NUMERIC_FEATURES = {
    "telemetry": [*TRIP_NUMERIC, "haversine_km", *PLACE_NUMERIC, *TIME_NUMERIC, "Age_of_Truck_months", *TELEMETRY_NUMERIC],
    "trips": [*TRIP_NUMERIC, "haversine_km", "detour_ratio", *PLACE_NUMERIC, *TIME_NUMERIC,
              "idle_ratio", "moving_ratio", "idle_per_km", "Age_of_Truck_months"],
}
ENCODED_VEHICLE = "vehicle_id_encoded"


def telemetry_aggregates(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Speed profile, stops, overspeeding and idle/moving counts per trip; unknown is 0."""
    speed = F.col("speed_kmh")
    out = aggregate_with_quantiles(rows, ["trip_id"], [
        F.avg(speed).alias("speed_mean"), F.stddev_samp(speed).alias("speed_std"),
        F.min(speed).alias("speed_min"), F.max(speed).alias("speed_max"),
        F.count_if(speed < STOP_KMH).alias("stop_count"), F.count(F.lit(1)).alias("telemetry_rows"),
        F.count_if(speed > OVERSPEED_KMH).alias("overspeed_count"),
        F.count_if("is_idle").alias("idle_event_count"), F.avg(F.col("is_idle").cast("int")).alias("idle_percentage_rows"),
        F.count_if("is_moving").alias("moving_event_count"), F.avg(F.col("is_moving").cast("int")).alias("moving_percentage_rows"),
    ], {"speed_median": ("speed_kmh", 0.5), "speed_p25": ("speed_kmh", 0.25), "speed_p75": ("speed_kmh", 0.75),
        "speed_p90": ("speed_kmh", 0.9)}, hot_rows)
    return (out.withColumn("speed_iqr", F.col("speed_p75") - F.col("speed_p25"))
            .withColumn("speed_cv", F.col("speed_std") / (F.col("speed_mean") + EPSILON)).na.fill(0))


def join_telemetry(trips: DataFrame, telemetry: DataFrame) -> DataFrame:
    return trips.join(telemetry, "trip_id", "left")


def add_rates(df: DataFrame) -> DataFrame:
    """Event counts per 100 km and per hour."""
    per_100km = F.col("Trip_Distance_km") / 100 + EPSILON
    per_hour = F.col("Trip_Duration_min") / 60 + EPSILON
    return (df.withColumn("stop_count_per_100km", F.col("stop_count") / per_100km)
            .withColumn("overspeed_count_per_100km", F.col("overspeed_count") / per_100km)
            .withColumn("idle_events_per_100km", F.col("idle_event_count") / per_100km)
            .withColumn("stop_count_per_hour", F.col("stop_count") / per_hour)
            .withColumn("overspeed_count_per_hour", F.col("overspeed_count") / per_hour))


def trainable(df: DataFrame) -> DataFrame:
    """Trips with positive distance and duration, no QA flag and all four coordinates."""
    return df.where(~F.col("QA_zero_duration") & ~F.col("QA_negative_distance")
                    & (F.col("Trip_Duration_min") > 0) & (F.col("Trip_Distance_km") > 0)
                    & F.col("lat_start").isNotNull() & F.col("lon_start").isNotNull()
                    & F.col("lat_end").isNotNull() & F.col("lon_end").isNotNull())


def add_places(df: DataFrame) -> DataFrame:
    ends = (F.col("lat_start"), F.col("lon_start"), F.col("lat_end"), F.col("lon_end"))
    return (df.withColumn("haversine_km", great_circle_km(*ends)).withColumn("bearing", signed_bearing(*ends))
            .withColumn("delta_lat", F.col("lat_end") - F.col("lat_start"))
            .withColumn("delta_lon", F.col("lon_end") - F.col("lon_start")))


def add_detour(df: DataFrame) -> DataFrame:
    km, direct = F.col("Trip_Distance_km"), F.col("haversine_km")
    return (df.withColumn("detour_ratio", km / (direct + EPSILON))
            .withColumn("directness_efficiency", clip(direct / (km + EPSILON), 0, 1)))


def add_cyclical_time(df: DataFrame) -> DataFrame:
    """Hour and weekday on the circle. A weekday of Monday is 0."""
    def angle(x: Column, period: int) -> Column:
        return F.lit(2 * math.pi) * x / period

    hour, day = F.col("hour_of_day"), F.col("day_of_week")
    return (df.withColumn("hour_of_day", F.hour("timestamp_start").cast("bigint"))
            .withColumn("day_of_week", F.weekday("timestamp_start").cast("bigint"))
            .withColumn("hour_sin", F.sin(angle(hour, 24))).withColumn("hour_cos", F.cos(angle(hour, 24)))
            .withColumn("dow_sin", F.sin(angle(day, 7))).withColumn("dow_cos", F.cos(angle(day, 7))))


def add_ratios(df: DataFrame) -> DataFrame:
    return (df.withColumn("idle_ratio", F.col("Idle_Time_min") / (F.col("Trip_Duration_min") + EPSILON))
            .withColumn("moving_ratio", F.col("Moving_Time_min") / (F.col("Trip_Duration_min") + EPSILON))
            .withColumn("idle_per_km", F.col("Idle_Time_min") / (F.col("Trip_Distance_km") + EPSILON)))


def distance_bucket(km: Column) -> Column:
    """Right-closed bucket label; NULL at 0 or below."""
    out = F.when(km <= 0, F.lit(None).cast("string"))
    for upper, label in DISTANCE_BUCKETS:
        out = out.when(km <= upper if upper else km.isNotNull(), label)
    return out


def target_fixed_speed() -> Column:
    """Half directness, 0.3 idle, 0.2 average speed against 60 km/h."""
    speed = clip(F.col("Avg_Speed") / TARGET_SPEED_KMH, 0, 1)
    return 0.5 * F.col("directness_efficiency") + 0.3 * (1 - F.col("idle_ratio")) + 0.2 * speed


def reference_speeds(train: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median average speed per distance bucket (four rows at most)."""
    return aggregate_with_quantiles(train.where(F.col("distance_bucket").isNotNull()).select("distance_bucket", "Avg_Speed"),
                                    ["distance_bucket"], [], {"reference_speed": ("Avg_Speed", 0.5)}, hot_rows)


def add_target_bucket_speed(df: DataFrame, references: DataFrame) -> DataFrame:
    """Half directness, 0.3 idle, 0.2 average speed against the bucket's reference speed."""
    own = F.col("Avg_Speed")
    speed = clip(own / (F.coalesce(F.col("reference_speed"), own) + EPSILON), 0, 1)
    return (df.join(F.broadcast(references), "distance_bucket", "left").withColumn("speed_efficiency", speed)
            .withColumn(TARGET, 0.5 * F.col("directness_efficiency") + 0.3 * (1 - F.col("idle_ratio"))
                        + 0.2 * F.col("speed_efficiency")).drop("reference_speed"))


def bucket_speed_frame(frame: DataFrame) -> DataFrame:
    """A model frame whose target is the bucket-speed one, with reference speeds of its training rows."""
    return add_target_bucket_speed(frame.drop(TARGET, "speed_efficiency"), reference_speeds(frame.where("is_train")))


def time_split(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Add `is_train`: the first `share` of trips by start time, equal times by trip id.

    Times are counted before they are walked, in time buckets; only the ties at the cut are
    looked at one by one, in id buckets. Nothing is ordered in one task.
    """
    timed = df.withColumn("seq", F.unix_micros("timestamp_start"))
    wanted = df.agg(F.floor(F.count(F.lit(1)) * F.lit(share))).scalar()
    counts = (timed.groupBy("seq").agg(F.count(F.lit(1)).alias("c"))
              .withColumn("bucket", time_bucket(F.col("seq"))))
    walked = Timeline((), ("seq",)).running(counts, {"upto": F.col("c")})
    cut = as_struct(walked.withColumn("wanted", wanted).where(F.col("upto") >= F.col("wanted")).agg(
        F.min("seq").alias("seq"), F.min_by(F.col("wanted") - F.col("upto") + F.col("c"), "seq").alias("of_ties")))
    ties = (timed.select("seq", "trip_id").withColumn("_cut", cut).where(F.col("seq") == F.col("_cut.seq"))
            .withColumn("bucket", F.floor(F.col("trip_id") / F.lit(TIE_BUCKET_IDS))))
    placed = Timeline((), ("trip_id",)).running(ties, {"place": F.lit(1)})
    last = placed.where(F.col("place") <= F.col("_cut.of_ties")).agg(F.max("trip_id")).scalar()
    return (timed.withColumn("_cut", cut)
            .withColumn("is_train", (F.col("seq") < F.col("_cut.seq"))
                        | ((F.col("seq") == F.col("_cut.seq")) & is_true(F.col("trip_id") <= last)))
            .drop("_cut", "seq"))


def vehicle_means(train: DataFrame) -> DataFrame:
    return train.groupBy("vehicle_id").agg(F.avg(TARGET).alias("vehicle_mean"))


def encode_vehicle(df: DataFrame, means: DataFrame, overall: Column) -> DataFrame:
    """Vehicle as its mean training target; an unseen vehicle gets the overall mean."""
    return (df.join(means, "vehicle_id", "left")
            .withColumn(ENCODED_VEHICLE, F.coalesce("vehicle_mean", overall)).drop("vehicle_mean"))


def fill_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0, columns)


def target_correlations(df: DataFrame) -> DataFrame:
    return df.agg(*[F.corr(TARGET, c).alias(f"corr_{c.lower()}")
                    for c in ("Distance_Efficiency", "Time_Efficiency", "Idle_Efficiency")])


def engineered(df: DataFrame) -> DataFrame:
    """All features a trip has by itself."""
    df = add_ratios(add_cyclical_time(add_detour(add_places(df))))
    return df.withColumn("distance_bucket", distance_bucket(F.col("Trip_Distance_km")))


def model_frame(trips: DataFrame, rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Trainable trips with telemetry, features, fixed-speed target and split."""
    joined = add_rates(join_telemetry(trips, telemetry_aggregates(rows, hot_rows)))
    return time_split(engineered(trainable(joined)).withColumn(TARGET, target_fixed_speed()))


# ---- scoring requests -----------------------------------------------------------------------

REQUIRED = ["vehicle_id", "timestamp_start", "lat_start", "lon_start", "lat_end", "lon_end", "Trip_Distance_km",
            "Trip_Duration_min", "Idle_Time_min", "Moving_Time_min", "Avg_Speed", "Idle_Percentage", "Age_of_Truck_months"]
OPTIONAL_SPEEDS = ["speed_mean", "speed_median", "speed_p25", "speed_p75", "speed_p90", "speed_std"]
OPTIONAL_COUNTS = ["stop_count", "overspeed_count", "idle_event_count", "moving_event_count"]

# Lowest and highest value allowed per field; distance and duration must exceed 0.
FIELD_RANGES = {
    "lat_start": (-90, 90), "lon_start": (-180, 180), "lat_end": (-90, 90), "lon_end": (-180, 180),
    "Trip_Distance_km": (0, None), "Trip_Duration_min": (0, None), "Idle_Time_min": (0, None),
    "Moving_Time_min": (0, None), "Avg_Speed": (0, None), "Idle_Percentage": (0, 100), "Age_of_Truck_months": (0, None)}
ABOVE_ZERO = ("Trip_Distance_km", "Trip_Duration_min")
# Default of a missing speed statistic as a multiple of the mean.
SPEED_DEFAULTS = {"speed_median": 1.0, "speed_p25": 0.8, "speed_p75": 1.2, "speed_p90": 1.4, "speed_std": 0.2}


def with_optional_fields(df: DataFrame) -> DataFrame:
    """Add absent optional request fields as NULL."""
    return df.withColumns({**{c: F.lit(None).cast("double") for c in OPTIONAL_SPEEDS if c not in df.columns},
                           **{c: F.lit(None).cast("bigint") for c in OPTIONAL_COUNTS if c not in df.columns}})


def validate_requests(df: DataFrame) -> DataFrame:
    """Add `rejected_fields`: required fields that are missing, NaN or out of range."""
    checks = []
    for c in REQUIRED:
        ok = F.col(c).isNotNull()
        low, high = FIELD_RANGES.get(c, (None, None))
        if c in FIELD_RANGES:
            ok = ok & ~F.isnan(F.col(c).cast("double"))
        if low is not None:
            ok = ok & ((F.col(c) > low) if c in ABOVE_ZERO else (F.col(c) >= low))
        if high is not None:
            ok = ok & (F.col(c) <= high)
        checks.append(F.when(~is_true(ok), F.lit(c)))
    return df.withColumn("rejected_fields", F.concat_ws(",", *checks))


def fill_speed_defaults(df: DataFrame) -> DataFrame:
    """Missing speed statistics from the mean, or all of them from the trip's average speed.

    A supplied 0 counts as missing, except for the mean itself.
    """
    given = F.col("speed_mean").isNotNull()
    base = F.coalesce("speed_mean", "Avg_Speed")
    filled = {c: F.coalesce(F.when(given, F.nullif(F.col(c), F.lit(0.0))), base * share if share != 1.0 else base)
              for c, share in SPEED_DEFAULTS.items()}
    out = df.withColumns({**filled, "speed_mean": base})
    return (out.withColumn("speed_min", F.col("speed_p25") * 0.5).withColumn("speed_max", F.col("speed_p90") * 1.2)
            .withColumn("speed_iqr", F.col("speed_p75") - F.col("speed_p25"))
            .withColumn("speed_cv", F.col("speed_std") / (F.col("speed_mean") + EPSILON)))


def fill_count_defaults(df: DataFrame) -> DataFrame:
    """Missing counts are 0; row shares over stops plus moving events."""
    out = df.na.fill(0, OPTIONAL_COUNTS)
    rows = F.greatest(F.col("stop_count") + F.col("moving_event_count"), F.lit(1))
    return add_rates(out.withColumn("telemetry_rows", rows.cast("bigint"))
                     .withColumn("idle_percentage_rows", F.col("idle_event_count") / (F.col("telemetry_rows") + EPSILON))
                     .withColumn("moving_percentage_rows", F.col("moving_event_count") / (F.col("telemetry_rows") + EPSILON)))


def scoring_features(requests: DataFrame) -> DataFrame:
    """Model inputs of valid requests."""
    return engineered(fill_count_defaults(fill_speed_defaults(with_optional_fields(requests))))
