"""From raw text columns to typed pings."""

from pyspark.sql import Column, DataFrame, functions as F

from haulmetrics.functions.scalars import truthy
from haulmetrics.operators.quantiles import missing_nan

# Canonical name of each raw column.
RAW_TO_CANONICAL = {
    "Timestamp": "timestamp",
    "CarNumberPlate": "vehicle_id",
    "Latitude": "lat",
    "Longitude": "lon",
    "Speed": "speed_kmh",
    "EngineStatus": "engine_on",
    "Odometer": "odometer_km",
    "FuelLevelPercentage": "fuel_level",
    "GPSLocated": "gps_valid",
}

# Canonical name, text fragments that select it, fragments that rule it out.
ALIAS_RULES = [
    ("timestamp_utc", [("time",), ("date",)], ()),
    ("vehicle_id", [("plate",), ("vehicle",), ("asset",)], ()),
    ("engine_on", [("engine",), ("ignition",)], ()),
    ("speed_kmh", [("speed",)], ()),
    ("odometer_km", [("odometer",), ("odo",)], ()),
    ("lat", [("lat",)], ("lon",)),
    ("lon", [("lon",), ("lng",)], ()),
    ("gps_ok", [("gps", "locat")], ()),
]
ENGINE_TOKENS = ("TRUE", "1", "ON")
GPS_TOKENS = ("TRUE", "1")
NUMERIC = ["speed_kmh", "odometer_km", "lat", "lon", "fuel_level"]
LAST = 9223372036854775807
REQUIRED = ("timestamp", "vehicle_id")
# Time formats beside ISO 8601; the month comes before the day.
TIME_FORMATS = ["yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
                "d MMM yyyy H:mm:ss", "d-MMM-yyyy H:mm:ss", "d MMM yyyy", "yyyyMMddHHmmss"]


def canonical_name(column: str) -> str | None:
    """First alias rule that fits a column name, in any case."""
    low = column.lower()
    for name, choices, unless in ALIAS_RULES:
        if any(all(part in low for part in choice) for choice in choices) and not any(u in low for u in unless):
            return name
    return None


def rename_by_alias(df: DataFrame) -> DataFrame:
    """Rename every column an alias rule fits. Two columns under one name are an error."""
    found = {c: canonical_name(c) for c in df.columns}
    renames = {c: n for c, n in found.items() if n}
    repeated = {n for n in renames.values() if list(renames.values()).count(n) > 1}
    if repeated:
        raise ValueError(f"several columns map to {sorted(repeated)}: {renames}")
    return df.withColumnsRenamed(renames)


def rename_by_map(df: DataFrame) -> DataFrame:
    """The canonical columns only; an absent source column is NULL."""
    return df.select(*[(F.col(raw) if raw in df.columns else F.lit(None).cast("string")).alias(name)
                       for raw, name in RAW_TO_CANONICAL.items()])


def canonical_columns(df: DataFrame) -> dict[str, str]:
    """Source column of each canonical one: the usual raw name if it is there, else the first column an alias rule fits."""
    own = {"timestamp_utc": "timestamp", "gps_ok": "gps_valid"}
    found = {canonical: raw for raw, canonical in RAW_TO_CANONICAL.items() if raw in df.columns}
    for column in df.columns:
        name = canonical_name(column)
        if name is not None and column not in found.values():
            found.setdefault(own.get(name, name), column)
    return found


def to_canonical(df: DataFrame) -> DataFrame:
    """The canonical columns only; an absent one is NULL, an absent time or vehicle is an error."""
    found = canonical_columns(df)
    absent = [c for c in REQUIRED if c not in found]
    if absent:
        raise ValueError(f"no column for {absent} among {df.columns}")
    return df.select(*[(F.col(f"`{found[c]}`") if c in found else F.lit(None).cast("string")).alias(c) for c in RAW_TO_CANONICAL.values()])


def parse_time(text: Column) -> Column:
    """Timestamp, or NULL when unparsable. Text without an offset is in the session zone (UTC)."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(F.trim(text.cast("string")), F.lit(f)) for f in TIME_FORMATS])


def parse_number(text: Column) -> Column:
    """Number, or NULL when unparsable or "NaN"."""
    return missing_nan(F.trim(text.cast("string")).try_cast("double"))


def python_truth(text: Column) -> Column:
    """Flag as a blanket cast reads it: any text, even "False", and a missing value are true."""
    return F.coalesce(text != "", F.lit(True))


def engine_flag(text: Column) -> Column:
    return truthy(text, ENGINE_TOKENS)


def gps_flag(text: Column) -> Column:
    return truthy(text, GPS_TOKENS)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def normalize(raw: DataFrame) -> DataFrame:
    """Typed pings with timestamp and vehicle present."""
    df = to_canonical(raw)
    typed = df.select(parse_time(F.col("timestamp")).alias("ts"), F.col("vehicle_id").cast("string"),
                      engine_flag(F.col("engine_on")).alias("engine_on"), gps_flag(F.col("gps_valid")).alias("gps_ok"),
                      *[parse_number(F.col(c)).alias(c) for c in NUMERIC])
    return require(typed, ["ts", "vehicle_id"])


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per `keys`, the one with the smallest `order` (a number).

    An aggregation, not a window: copies of a hot key meet on the map side.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest]).select(*df.columns)


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def valid_coordinates(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def non_negative_speed(df: DataFrame, column: str = "speed") -> DataFrame:
    return df.where(F.col(column) >= 0) if column in df.columns else df


def dataset_profile(df: DataFrame, time: str = "ts", vehicle: str = "vehicle_id") -> DataFrame:
    """Rows, time range and number of vehicles, as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(time).alias("first_time"),
                  F.max(time).alias("last_time"), F.count_distinct(vehicle).alias("vehicles"))


def time_order(ts: Column) -> Column:
    """Sort key of a timestamp in microseconds; a missing time sorts last."""
    return F.coalesce(F.unix_micros(ts), F.lit(LAST))
