"""The dashboard's questions, answered for all vehicles at once."""

from pyspark.sql import Column, DataFrame, functions as F

from haulmetrics.functions.scalars import round_half_even, total
from haulmetrics.operators.points import VEHICLE_LINE
from haulmetrics.operators.stats import RANK_BUCKET_ROWS, with_value_buckets
from haulmetrics.operators.timeline import BUCKET_SECONDS, Timeline, time_bucket

TRACK_DEGREES, IDLE_TRACK_DEGREES = 0.005, 0.001
LITRES_PER_100_KM, PRICE_PER_LITRE = 35, 2.89
# First and last degree of each sector.
SECTORS = {"north": (1, 90), "east": (91, 180), "south": (181, 270), "west": (271, 360)}
MAP_BOX = {"lat": (1, 7), "lon": (100, 119)}


def steady(x: Column) -> Column:
    """A sum or mean to a millionth, so that the order of adding up cannot decide a later rounding."""
    return F.round(x, 6)


def speed_by_day_of_month(trips: DataFrame) -> DataFrame:
    return (trips.groupBy(F.date_format("timestamp_start", "dd").alias("time"))
            .agg(round_half_even(steady(F.avg("Avg_Speed")), 2).alias("value")))


def driver_ranking(days: DataFrame) -> DataFrame:
    """Vehicles by total moving minutes, ranked from 0; equal times go by vehicle name.

    Times are compared to a millionth of a minute, so the order of a sum cannot break a tie.
    """
    moved = (days.groupBy(F.col("vehicle_id").alias("vehicle")).agg(F.sum("Total_Moving_min").alias("time"))
             .withColumn("fall", -F.round("time", 6)))
    cut = with_value_buckets(moved, ["fall"], RANK_BUCKET_ROWS)
    ranked = Timeline((), ("fall", "vehicle"), "_b_fall").running(cut, {"position": F.lit(1)})
    return ranked.select((F.col("position") - 1).alias("rank"), "vehicle", "time")


def sector(degree: Column) -> Column:
    """Compass sector. Degrees between two sectors belong to none."""
    out = F.lit(None).cast("string")
    for name, (first, last) in SECTORS.items():
        out = F.when(degree.between(first, last), name).otherwise(out)
    return out


def direction_breakdown(pings: DataFrame, degree: str = "direction") -> DataFrame:
    """Pings per sector; a sector without pings has NULL."""
    seen = pings.where(F.col(degree) != 0).groupBy(sector(F.col(degree)).alias("position")).agg(F.count("ts").alias("data"))
    frame = pings.sparkSession.createDataFrame([(s,) for s in SECTORS], "position string")
    return frame.join(F.broadcast(seen), "position", "left")


def vehicle_list(days: DataFrame) -> DataFrame:
    return days.select("vehicle_id").distinct()


def thinned_track(pings: DataFrame, degrees: float, time: str = "ts",
                  width_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Distinct points of each vehicle in order of first sight; kept if first or more than
    `degrees` in either axis from the distinct point before."""
    points = (pings.groupBy("vehicle_id", "lat", "lon").agg(F.min(F.unix_micros(time)).alias("seq"))
              .withColumn("bucket", time_bucket(F.col("seq"), width_seconds)))
    df = VEHICLE_LINE.neighbours(points, before=["lat", "lon"])
    far = (F.abs(F.col("lat") - F.col("prev.lat")) > degrees) | (F.abs(F.col("lon") - F.col("prev.lon")) > degrees)
    return df.where(F.col("prev").isNull() | far).select("vehicle_id", "seq", "lat", "lon")


def vehicle_stats(days: DataFrame) -> DataFrame:
    """Distance, fuel, cost, mean driven distance per day and idle minutes per vehicle."""
    sums = days.groupBy("vehicle_id").agg(
        round_half_even(steady(total(F.col("Total_Distance_km"))), 2).alias("month_total_distance"),
        round_half_even(steady(F.avg(F.when(F.col("Total_Distance_km") != 0, F.col("Total_Distance_km")))), 2).alias("day_total_distance_avg"),
        round_half_even(steady(total(F.when(F.col("Total_Idle_min") != 0, F.col("Total_Idle_min")))), 0).alias("total_idle_min"))
    litres = round_half_even(steady(LITRES_PER_100_KM * (F.col("month_total_distance") / 100)), 2)
    return (sums.withColumn("fuel_liters", litres)
            .withColumn("total_wasted", round_half_even(steady(F.col("fuel_liters") * F.lit(PRICE_PER_LITRE)), 2)))


def next_trip_features(trips: DataFrame) -> DataFrame:
    """Last trip with non-zero coordinates and the mean of the trip measures, per vehicle."""
    usable = trips.where(" AND ".join(f"NOT coalesce({c} = 0, false)" for c in ("lat_start", "lat_end", "lon_start", "lon_end")))
    last = ["timestamp_start", "lat_start", "lon_start", "lat_end", "lon_end"]
    means = ["Trip_Distance_km", "Trip_Duration_min", "Idle_Time_min", "Moving_Time_min", "Avg_Speed",
             "Idle_Percentage", "Age_of_Truck_months"]
    return usable.groupBy("vehicle_id").agg(*[F.max_by(c, "trip_id").alias(c) for c in last],
                                            *[F.avg(c).alias(c) for c in means])


def in_map_box(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").between(*MAP_BOX["lat"]) & F.col("lon").between(*MAP_BOX["lon"]))


def efficiency_percent(prediction: Column) -> Column:
    """Percent with two places, ties up."""
    return F.floor(prediction * 100 * 100 + 0.5) / F.lit(100.0)
