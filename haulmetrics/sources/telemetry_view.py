"""Telemetry derived from the `events` table, so the driver's tables can stand in for pings."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulmetrics.operators.timeline import BUCKET_SECONDS, Timeline
from haulmetrics.plans.staging import stage_dense

EPOCH = 1704067200


def all_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a ping; `first_at_second` marks the one kept per vehicle and second.

    Pings are written to the shared folder once, with what each piece of a vehicle's line adds up to by itself.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    vehicle = F.floor(F.col("user_id") / F.lit(15.0)).cast("int").cast("string")
    engine_off = (F.col("event_type") == "error") & (F.col("k") < 50)
    read = events.select("event_id", "event_type", "value", k.alias("k"),
                         F.concat(F.lit("VH"), F.lpad(vehicle, 4, "0")).alias("vehicle_id"),
                         (EPOCH + F.floor((micros / F.lit(1e6) - EPOCH) / F.lit(10.0))).cast("bigint").alias("s"))
    pings = read.select(
        "event_id", "k", "vehicle_id", "s", (~engine_off).alias("engine_on"),
        (~((F.col("event_type") == "signup") & (F.col("k") < 25))).alias("gps_ok"),
        F.when((F.col("event_type") == "view") | engine_off, F.lit(0.0)).otherwise(F.least("value", F.lit(135.0))).alias("speed_kmh"),
        F.floor(F.col("s") / F.lit(BUCKET_SECONDS)).cast("bigint").alias("bucket"))
    line = Timeline(("vehicle_id",), ("s", "event_id"))
    pings = line.neighbours(pings, before=["s"])
    gap = F.col("s") - F.col("prev.s")
    pings = pings.withColumn("step_m", F.floor(
        F.coalesce(F.least(gap, F.lit(900)), F.lit(0)) * F.col("speed_kmh") / F.lit(3.6)).cast("bigint"))

    def heading(forward: int, back: int):
        turn = F.col("k") % 4
        return (F.when(turn == forward, F.col("step_m")).when(turn == back, -F.col("step_m"))
                .otherwise(F.lit(0)))

    totals = {"odo": F.col("step_m"), "ym": heading(0, 2), "xm": heading(1, 3)}
    inside = {n: f"{n}_inside" for n in totals}
    # written before the totals are carried on, so that events are parsed, shuffled and ordered once for rows and pieces
    pings = stage_dense(pings.select("*", F.coalesce(gap != 0, F.lit(True)).alias("first_at_second"),
                                     *[line.running_inside(x).alias(inside[n]) for n, x in totals.items()]).drop("prev"), "every_ping")
    pings = line.running(pings, totals, inside=inside)
    km = 50000 + F.col("odo") / F.lit(1000.0)
    return pings.select(
        "vehicle_id", "s", F.timestamp_seconds("s").alias("ts"), "event_id", "k", "engine_on", "gps_ok", "speed_kmh",
        F.when(F.col("k") == 98, None).when(F.col("k") == 97, km - 5).otherwise(km).alias("odometer_km"),
        (F.lit(3.1) + F.col("ym") / F.lit(111195.0) + F.when(F.col("k") == 96, 1.0).otherwise(0.0)).alias("lat"),
        (F.lit(101.6) + F.col("xm") / F.lit(111195.0)).alias("lon"),
        ((F.col("k") * 37 + F.col("event_id")) % 361).cast("bigint").alias("direction"),
        F.col("k").cast("double").alias("fuel_level"),
        "first_at_second")


def one_per_second(all_pings: DataFrame) -> DataFrame:
    """One ping per vehicle and second."""
    return all_pings.where("first_at_second").drop("first_at_second")


def raw_text(all_pings: DataFrame) -> DataFrame:
    """The pings as a raw file would hold them: text columns, some of it unparsable or empty."""
    e = F.col("event_id")
    on = F.element_at(F.array(*map(F.lit, ("True", "ON", "1"))), (e % 3 + 1).cast("int"))
    off = F.element_at(F.array(*map(F.lit, ("False", "OFF", "0"))), (e % 3 + 1).cast("int"))
    return all_pings.select(
        F.when(e % 97 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
        F.when(e % 89 != 0, F.col("vehicle_id")).alias("CarNumberPlate"),
        F.col("lat").cast("string").alias("Latitude"),
        F.col("lon").cast("string").alias("Longitude"),
        F.when(e % 83 == 0, "n/a").otherwise(F.col("speed_kmh").cast("string")).alias("Speed"),
        F.when(e % 79 != 0, F.when(F.col("engine_on"), on).otherwise(off)).alias("EngineStatus"),
        F.col("odometer_km").cast("string").alias("Odometer"),
        F.when(F.col("k") == 95, "").otherwise(F.col("k").cast("string")).alias("FuelLevelPercentage"),
        F.when(e % 73 != 0, F.when(F.col("gps_ok"), "True").otherwise("False")).alias("GPSLocated"),
        F.col("direction").cast("string").alias("Direction"),
        F.when(F.col("k") >= 60, F.concat(F.lit("n"), F.col("k").cast("string"))).alias("Note"),
        e.alias("row_id"))
