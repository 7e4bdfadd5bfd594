"""Trips from engine on to engine off, numbered across the fleet, with efficiency scores."""

from pyspark.sql import Column, DataFrame, functions as F

from haulmetrics.functions.geo import great_circle_km
from haulmetrics.functions.scalars import clip, is_true, ratio, seconds, total
from haulmetrics.operators.points import STEP_COLUMNS, VEHICLE_LINE, on_vehicle_line
from haulmetrics.operators.quantiles import HOT_ROWS, as_struct, global_quantiles
from haulmetrics.operators.timeline import BUCKET_SECONDS, Timeline
from haulmetrics.plans.staging import stage

GAP_CAP_SECONDS = 300
IDLE_KMH = 1.0
BASELINE_KMH = 80
AGE_WINDOW_DAYS = 60
NAME_CHARACTERS = 3

TRIP_COLUMNS = [
    "vehicle_id", "trip_id", "timestamp_start", "timestamp_end", "lat_start", "lon_start", "lat_end", "lon_end",
    "Trip_Distance_km", "Trip_Duration_min", "Avg_Speed", "Idle_Time_min", "Moving_Time_min", "Idle_Percentage",
    "Distance_Efficiency", "Time_Efficiency", "Idle_Efficiency", "Signal_Reliability", "Age_of_Truck_months",
    "total_rows", "QA_negative_distance", "QA_zero_duration"]
ROW_COLUMNS = ["vehicle_id", "trip_id", "timestamp", "lat", "lon", "speed_kmh", "engine_on", "odometer_km",
               "is_idle", "is_moving", "gps_valid"]


def vehicle_offsets(trips_started: DataFrame) -> DataFrame:
    """First free trip number of each vehicle, vehicles taken in name order.

    A vehicle uses as many numbers as it has trips plus one. The running total over vehicles is
    cut by the first characters in which names differ, so no task sees the whole vehicle list.
    """
    ends = as_struct(trips_started.agg(F.min("vehicle_id").alias("low"), F.max("vehicle_id").alias("high")))
    # what the first and the last name in order share, all names share
    places = F.sequence(F.lit(1), F.greatest(F.length("_ends.low"), F.lit(1)))
    differs = F.filter(places, lambda i: ~F.substr(F.col("_ends.low"), F.lit(1), i).eqNullSafe(F.substr(F.col("_ends.high"), F.lit(1), i)))
    start = F.coalesce(F.try_element_at(differs, F.lit(1)), F.length("_ends.low") + 1)
    named = (trips_started.withColumn("_ends", ends)
             .withColumn("bucket", F.substr("vehicle_id", start, F.lit(NAME_CHARACTERS))).drop("_ends"))
    fleet = Timeline((), ("vehicle_id",))
    used = F.col("trips") + 1
    return (fleet.running(named, {"upto": used})
            .select("vehicle_id", (F.col("upto") - used).cast("bigint").alias("offset")))


def engine_on_rows(steps: DataFrame) -> DataFrame:
    """Pings with the engine on, with fleet-wide `trip_id`, capped seconds to the next ping of the trip,
    and idle/moving flags on the raw speed.

    Engine-on pings of a trip are consecutive, so the next ping belongs to the trip exactly if its engine
    is on. `steps` is read several times, a few columns each: pass the staged table.
    """
    df = steps.drop(*[c for c in STEP_COLUMNS if c not in ("starts_ignition", "ignitions_inside", "to_next_on_sec")])
    started = df.groupBy("vehicle_id").agg(F.count_if("starts_ignition").alias("trips"))
    df = VEHICLE_LINE.running(df, {"_number": F.col("starts_ignition").cast("int")}, vehicle_offsets(started),
                              {"_number": "ignitions_inside"}).where("engine_on")
    return (df.withColumns({
                "trip_id": (F.col("offset") + F.col("_number")).cast("bigint"),
                "delta_t_sec": F.coalesce(clip(F.col("to_next_on_sec"), 0, GAP_CAP_SECONDS), F.lit(0.0)),
                "is_idle": is_true(F.col("speed_kmh") <= IDLE_KMH), "is_moving": is_true(F.col("speed_kmh") > IDLE_KMH)})
            .withColumnsRenamed({"ts": "timestamp", "gps_ok": "gps_valid"}).drop("starts_ignition", "ignitions_inside", "to_next_on_sec", "_number", "offset"))


def row_output(rows: DataFrame) -> DataFrame:
    """The 11 columns of the row file."""
    return rows.select(*ROW_COLUMNS)


def aggregate_trips(rows: DataFrame) -> DataFrame:
    """One row per trip; first and last values skip NULLs."""
    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))

    return rows.groupBy("vehicle_id", "trip_id").agg(
        F.min("timestamp").alias("timestamp_start"), F.max("timestamp").alias("timestamp_end"),
        first("lat").alias("lat_start"), last("lat").alias("lat_end"),
        first("lon").alias("lon_start"), last("lon").alias("lon_end"),
        first("odometer_km").alias("odometer_start"), last("odometer_km").alias("odometer_end"),
        F.sum("delta_t_sec").alias("total_time_sec"), F.avg("speed_kmh").alias("avg_speed_raw"),
        F.count_if("gps_valid").alias("gps_valid_count"),
        (total(F.when(F.col("is_idle"), F.col("delta_t_sec"))) / 60).alias("Idle_Time_min"),
        (total(F.when(F.col("is_moving"), F.col("delta_t_sec"))) / 60).alias("Moving_Time_min"),
        F.count(F.lit(1)).alias("total_rows"))


def add_distance_duration(trips: DataFrame) -> DataFrame:
    """Odometer distance (negative is unknown), minutes, km/h."""
    km = F.col("odometer_end") - F.col("odometer_start")
    return (trips.withColumn("Trip_Distance_km", F.when(km >= 0, km))
            .withColumn("Trip_Duration_min", (seconds(F.col("timestamp_end")) - seconds(F.col("timestamp_start"))) / 60)
            .withColumn("Avg_Speed", ratio(F.col("Trip_Distance_km"), F.col("Trip_Duration_min") / 60)))


def add_efficiencies(trips: DataFrame) -> DataFrame:
    """Idle share and the four scores. Scores stay unknown when their denominator is 0."""
    direct = great_circle_km(F.col("lat_start"), F.col("lon_start"), F.col("lat_end"), F.col("lon_end"))
    idle = F.coalesce(ratio(F.col("Idle_Time_min"), F.col("Trip_Duration_min")), F.lit(0.0))
    return (trips.withColumn("Idle_Percentage", clip(idle, 0, 1))
            .withColumn("Optimal_Distance_km", direct)
            .withColumn("Distance_Efficiency", clip(ratio(F.col("Optimal_Distance_km"), F.col("Trip_Distance_km")), 0, 1.5))
            .withColumn("Time_Efficiency", clip(ratio(F.col("Optimal_Distance_km") / BASELINE_KMH,
                                                      F.col("Trip_Duration_min") / 60), 0, 2.0))
            .withColumn("Idle_Efficiency", 1 - F.col("Idle_Percentage"))
            .withColumn("Signal_Reliability", ratio(F.col("gps_valid_count"), F.col("total_rows"))))


def truck_ages(pings: DataFrame, window_days: int = AGE_WINDOW_DAYS) -> DataFrame:
    """Months in service per vehicle: highest odometer over the monthly distance of its last days.

    First and last readings are taken per vehicle and day, which meets on the map side, and are written to the shared folder,
    as they are read twice. Single pings are looked at again only for the one day of each vehicle that the start of its window cuts.
    """
    known = F.when(F.col("odometer_km").isNotNull(), F.col("ts"))
    ends = [F.max_by("odometer_km", known).alias("_last"), F.min_by("odometer_km", known).alias("_first")]
    day = F.to_date("ts").alias("day")
    daily = stage(pings.groupBy("vehicle_id", day).agg(*ends, F.max("ts").alias("_ts"), F.max("odometer_km").alias("_odometer")), "vehicle-days")
    latest = daily.groupBy("vehicle_id").agg(F.max("_ts").alias("_latest"), F.max("_odometer").alias("_odometer"))
    cuts = latest.select("vehicle_id", (F.col("_latest") - F.expr(f"INTERVAL {window_days} DAYS")).alias("_cut")).withColumn("day", F.to_date("_cut"))
    whole = daily.join(cuts.select("vehicle_id", F.col("day").alias("_day")), "vehicle_id").where(F.col("day") > F.col("_day"))
    part = (pings.select("vehicle_id", "ts", "odometer_km", day).join(cuts, ["vehicle_id", "day"])
            .where(F.col("ts") >= F.col("_cut")).groupBy("vehicle_id", "day").agg(*ends))
    km = F.col("_last") - F.col("_first")
    driven = (whole.select("vehicle_id", km.alias("km")).unionByName(part.select("vehicle_id", km.alias("km")))
              .where(F.col("km") >= 0).groupBy("vehicle_id").agg(F.sum("km").alias("_km")))
    months = F.when(F.col("_km") > 0, F.col("_odometer") / (F.col("_km") * F.lit(30.0 / window_days)))
    return latest.join(driven, "vehicle_id", "left").select("vehicle_id", months.alias("Age_of_Truck_months"))


def add_qa_flags(trips: DataFrame) -> DataFrame:
    return (trips.withColumn("QA_negative_distance", F.col("Trip_Distance_km").isNull())
            .withColumn("QA_zero_duration", F.col("Trip_Duration_min") <= 0))


def trip_output(trips: DataFrame) -> DataFrame:
    """The 22 columns of the trip file."""
    return trips.select(*TRIP_COLUMNS)


def trips_table(rows: DataFrame, pings: DataFrame, width_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Trips with scores, age and QA flags, from engine-on rows and all pings."""
    scored = add_efficiencies(add_distance_duration(aggregate_trips(rows)))
    return add_qa_flags(scored.join(truck_ages(pings), "vehicle_id", "left"))


def qa_report(trips: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quality report over the trip table, as one row."""
    tails = as_struct(global_quantiles(
        trips.select("Avg_Speed"), {"p01": ("Avg_Speed", 0.01), "p99": ("Avg_Speed", 0.99)}, hot_rows))
    duration = F.col("Trip_Duration_min")
    drift = ratio(F.abs(F.col("Idle_Time_min") + F.col("Moving_Time_min") - duration), duration) * 100
    low, high = F.col("_tails.p01"), F.col("_tails.p99")
    return trips.withColumn("_tails", tails).agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(F.col("Trip_Distance_km").isNull()).alias("without_distance"),
        (F.avg(F.col("Trip_Distance_km").isNull().cast("int")) * 100).alias("without_distance_percent"),
        F.max(low).alias("speed_p01"), F.max(high).alias("speed_p99"),
        F.count_if(F.col("Avg_Speed") > high).alias("trips_above_p99"),
        F.count_if(F.col("Avg_Speed") < low).alias("trips_below_p01"),
        F.count_if(F.col("Idle_Percentage") > 0.5).alias("mostly_idle"),
        (F.avg((F.col("Idle_Percentage") > 0.5).cast("int")) * 100).alias("mostly_idle_percent"),
        F.count_if(drift < 10).alias("consistent_trips"),
        F.avg("Distance_Efficiency").alias("mean_distance_efficiency"),
        F.avg("Time_Efficiency").alias("mean_time_efficiency"),
        F.avg("Idle_Efficiency").alias("mean_idle_efficiency"),
        F.avg("Signal_Reliability").alias("mean_signal_reliability"))


def vehicle_summary(trips: DataFrame) -> DataFrame:
    return trips.groupBy("vehicle_id").agg(
        F.count("trip_id").alias("num_trips"), total(F.col("Trip_Distance_km")).alias("total_distance"),
        F.max("Age_of_Truck_months").alias("Age_of_Truck_months"))


def fleet_means(vehicles: DataFrame) -> DataFrame:
    return vehicles.agg(F.count(F.lit(1)).alias("vehicles"), F.avg("num_trips").alias("mean_trips"),
                        F.avg("total_distance").alias("mean_distance"),
                        F.count("Age_of_Truck_months").alias("vehicles_with_age"))
