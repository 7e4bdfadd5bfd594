"""Trips cut by ignition or silence, and what is rolled up from them."""

from pyspark.sql import Column, DataFrame, functions as F

from haulmetrics.functions.scalars import ratio, seconds, total

LOCAL_ZONE = "Asia/Kuala_Lumpur"
MIN_TRIP_MINUTES, MIN_TRIP_KM = 5, 1


def _per_hour(km: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, km / (minutes / 60)).otherwise(F.lit(0.0))


def _share_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def aggregate_trips(points: DataFrame) -> DataFrame:
    """One row per (vehicle, trip) with a non-excluded ping; event counts cover all pings.

    One grouping with conditional aggregates instead of several groupings joined together.
    """
    use = ~F.col("exclude_from_metrics")

    def when_used(x: Column, also: Column | None = None) -> Column:
        return F.when(use if also is None else use & also, x)

    trips = points.groupBy("vehicle_id", "trip_id").agg(
        F.min(when_used(F.col("timestamp_utc"))).alias("Trip_Start_UTC"),
        F.max(when_used(F.col("timestamp_utc"))).alias("Trip_End_UTC"),
        total(when_used(F.col("fused_step_km"))).alias("Trip_Distance_km"),
        total(when_used(F.col("time_delta_min"), F.col("is_idle"))).alias("Idle_Time_min"),
        total(when_used(F.col("time_delta_min"), F.col("is_moving"))).alias("Moving_Time_min"),
        F.count_if("speeding_over120").alias("Speeding_Count"),
        F.count_if("flagged_over120").alias("Flagged_Count"),
        F.count_if(use).alias("_used"))
    return add_trip_kpis(trips.where(F.col("_used") > 0).drop("_used"))


def add_trip_kpis(trips: DataFrame) -> DataFrame:
    duration = (seconds(F.col("Trip_End_UTC")) - seconds(F.col("Trip_Start_UTC"))) / 60
    return (trips.withColumn("Trip_Duration_min", duration)
            .withColumn("Avg_Speed_kmh", _per_hour(F.col("Trip_Distance_km"), F.col("Trip_Duration_min")))
            .withColumn("Idle_Percentage", _share_percent(F.col("Idle_Time_min"), F.col("Trip_Duration_min")))
            .withColumn("trip_key", F.concat_ws("_", "vehicle_id", F.col("trip_id").cast("string"))))


def valid_trips(trips: DataFrame) -> DataFrame:
    return trips.where((F.col("Trip_Duration_min") >= MIN_TRIP_MINUTES) & (F.col("Trip_Distance_km") >= MIN_TRIP_KM))


def add_local_date(trips: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    local = F.from_utc_timestamp("Trip_Start_UTC", zone)
    return trips.withColumn("Trip_Start_MYT", local).withColumn("date_myt", F.to_date(local))


def trips_table(points: DataFrame) -> DataFrame:
    """Valid trips with their local date."""
    return add_local_date(valid_trips(aggregate_trips(points)))


def aggregate_days(trips: DataFrame) -> DataFrame:
    days = trips.groupBy("vehicle_id", "date_myt").agg(
        F.sum("Trip_Distance_km").alias("Total_Distance_km"),
        F.sum("Trip_Duration_min").alias("Total_Duration_min"),
        F.sum("Idle_Time_min").alias("Total_Idle_min"),
        F.sum("Moving_Time_min").alias("Total_Moving_min"),
        F.count("trip_id").alias("Trip_Count"),
        F.sum("Speeding_Count").alias("Speeding_Count"),
        F.sum("Flagged_Count").alias("Flagged_Count"))
    return (days.withColumn("Daily_Avg_Speed_kmh", _per_hour(F.col("Total_Distance_km"), F.col("Total_Duration_min")))
            .withColumn("Daily_Idle_Percentage", _share_percent(F.col("Total_Idle_min"), F.col("Total_Duration_min"))))


def distance_consistency(points: DataFrame, trips: DataFrame) -> DataFrame:
    """Distance in valid trips against distance in all usable pings, as one row."""
    of_points = points.where(~F.col("exclude_from_metrics")).agg(total(F.col("fused_step_km")).alias("km"))
    both = trips.agg(total(F.col("Trip_Distance_km")).alias("trip_km")).withColumn("fused_km", of_points.scalar())
    gap = F.abs(F.col("trip_km") - F.col("fused_km"))
    return both.select("trip_km", "fused_km", gap.alias("diff_km"), (ratio(gap, F.col("fused_km")) * 100).alias("diff_percent"))


def needs_review() -> Column:
    return (F.col("Avg_Speed_kmh") > 90) | (F.col("Idle_Percentage") > 80)


def sanity_bands(trips: DataFrame) -> DataFrame:
    speed, idle = F.col("Avg_Speed_kmh"), F.col("Idle_Percentage")
    typical_speed, typical_idle = speed.between(20, 90), idle.between(0, 60)
    return trips.agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(typical_speed).alias("speed_20_90"),
        (F.avg(typical_speed.cast("int")) * 100).alias("speed_20_90_percent"),
        F.count_if(speed < 20).alias("speed_below_20"),
        F.count_if(speed > 90).alias("speed_above_90"),
        F.count_if(typical_idle).alias("idle_0_60"),
        (F.avg(typical_idle.cast("int")) * 100).alias("idle_0_60_percent"),
        F.count_if(idle > 60).alias("idle_above_60"),
        F.count_if(idle > 80).alias("idle_above_80"),
        F.count_if(needs_review()).alias("to_review"))


def suspect_trips(trips: DataFrame) -> DataFrame:
    return trips.where(needs_review()).select(
        "vehicle_id", "trip_id", "Trip_Distance_km", "Trip_Duration_min", "Avg_Speed_kmh", "Idle_Percentage")


def trips_per_vehicle(points: DataFrame) -> DataFrame:
    return points.groupBy("vehicle_id").agg(F.count_distinct("trip_id").alias("trips"))


def pipeline_summary(points: DataFrame, trips: DataFrame, days: DataFrame) -> DataFrame:
    """Fleet-level means of trips and vehicle-days, as one row."""
    vehicles = points.agg(F.count_distinct("vehicle_id")).scalar()
    of_days = days.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("Trip_Count").alias("trips"),
                                F.avg("Total_Distance_km").alias("km"),
                                F.avg("Total_Duration_min").alias("minutes"))).scalar()
    out = trips.agg(F.count(F.lit(1)).alias("valid_trips"),
                    F.avg("Trip_Duration_min").alias("mean_duration_min"),
                    F.avg("Trip_Distance_km").alias("mean_distance_km"),
                    F.avg("Avg_Speed_kmh").alias("mean_avg_speed_kmh"),
                    F.avg("Idle_Percentage").alias("mean_idle_percentage"))
    out = out.withColumn("vehicles", vehicles).withColumn("_d", of_days)
    return out.select("*", ratio(F.col("valid_trips"), F.col("vehicles")).alias("trips_per_vehicle"),
                      F.col("_d.n").alias("vehicle_days"), F.col("_d.trips").alias("mean_trips_per_day"),
                      F.col("_d.km").alias("mean_km_per_day"),
                      F.col("_d.minutes").alias("mean_minutes_per_day")).drop("_d")
