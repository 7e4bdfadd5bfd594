"""Session settings the jobs rely on."""

import math

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions that keep each near 128 MB if all input is shuffled; AQE merges small ones."""
    return max(200, math.ceil(input_bytes / SHUFFLE_PARTITION_BYTES))


def build_session(master: str | None = None, input_bytes: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings above, sized to the input; `extra` keys use `_` for `.`."""
    if input_bytes is not None:
        extra.setdefault("spark_sql_shuffle_partitions", str(shuffle_partitions(input_bytes)))
    builder = SparkSession.builder.appName("haulmetrics")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
