"""Times the headline queries from the data folder on; prints one JSON line.

The queries run in pipeline order, as one job would: the first query that needs a table pays for
building it, from the data folder on, and later ones read it. Two queries run once beforehand,
untimed and with their tables dropped, so that the times do not measure the JVM's start.

With `BENCH_JOBS=1` there is more, which does not count in `value`: `cold` has some queries again, each from the data
folder on with nothing shared; `jobs` has the parts of the end-to-end job that no query covers: CSV files to one
table, training both models, and scoring a batch.
"""

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from haulmetrics.operators import features, model
from haulmetrics.plans import catalog, pipeline
from haulmetrics.session import build_session

HEADLINES = [
    "c18_quality_counters",      # pings -> steps -> cleaned points
    "d10_vehicle_day_kpis",      # ... -> trips -> vehicle-days
    "g02_driver_ranking",        # ... -> ranking
    "e16_trip_table",            # pings -> ignition trips with scores
    "f06_trip_telemetry",        # ... -> route efficiency -> trip telemetry
    "f12_outlier_clipping",
    "f15_feature_ranking",
    "f17_spearman_matrix",
    "f24_kruskal_wallis",
    "g05_thinned_track",
    "h12_target_fixed_speed",
    "h14_time_split",
]
COLD = ["c18_quality_counters", "d10_vehicle_day_kpis", "e16_trip_table"]


def jobs_and_cold(spark, folder: str, timed, run) -> dict:
    tables = catalog.fixture(spark, folder)
    scratch = tempfile.mkdtemp(prefix="haulmetrics-bench-")
    tables.raw.write.option("header", True).csv(f"{scratch}/raw")
    jobs = {"combine_csv": timed(lambda: pipeline.combine(spark, f"{scratch}/raw", scratch)),
            "train_both_models": timed(lambda: tables.trained)}
    requests = tables.frame.select("trip_id", *features.REQUIRED).na.fill(0, ["Age_of_Truck_months"])
    jobs["score_batch"] = timed(lambda: model.score_requests(requests, tables.trained[0]).write.format("noop").mode("overwrite").save())
    test = tables.trained[1].where("split = 'test'").select("model", F.round("mae", 4).alias("mae"), F.round("r2", 4).alias("r2")).collect()

    cold = {}
    for name in COLD:
        catalog.forget()
        cold[name] = run(name)
    return {"cold": cold, "jobs": jobs, "models": {r.model: {"mae": r.mae, "r2": r.r2} for r in test}}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
                          spark_driver_memory="16g", spark_log_level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    def run(name: str) -> float:
        return timed(lambda: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())

    for name in ("g02_driver_ranking", "f15_feature_ranking"):
        run(name)
    catalog.forget()
    times = {name: run(name) for name in HEADLINES}

    more = jobs_and_cold(spark, folder, timed, run) if os.environ.get("BENCH_JOBS") else {}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], **more}))
    spark.stop()


if __name__ == "__main__":
    main()
