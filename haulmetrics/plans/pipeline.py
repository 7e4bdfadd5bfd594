"""End-to-end jobs: raw vehicle files to tables, reports and models; trips to predictions."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulmetrics.operators import normalize, route, stats, trips_hybrid
from haulmetrics.operators.model import Bundle, score_requests, train
from haulmetrics.operators.points import clean_output
from haulmetrics.operators.trips_ignition import row_output, trip_output
from haulmetrics.plans.staging import stage
from haulmetrics.plans.tables import Tables
from haulmetrics.sources.files import drop_repeated_rows, drop_sparse_columns, read_clustered, read_mixed_csvs, read_vehicle_csvs, write_clustered


def combine(spark: SparkSession, folder: str, out: str, mixed_headers: bool = True) -> DataFrame:
    """All vehicle files as one table without sparse columns and repeated rows.

    Set `mixed_headers=False` when all files share the usual header: it saves a pass over the text. The text is
    parsed once; what decides on columns and repeats reads the parsed table.
    """
    raw = read_mixed_csvs(spark, folder) if mixed_headers else read_vehicle_csvs(spark, folder)
    drop_repeated_rows(drop_sparse_columns(stage(raw, "parsed"))).write.parquet(f"{out}/combined")
    return spark.read.parquet(f"{out}/combined")


def pings_from(combined: DataFrame) -> DataFrame:
    """Typed pings, one per vehicle and time. Equal times keep the row with the smallest content hash."""
    typed = normalize.normalize(combined)
    keyed = typed.withColumn("_order", F.xxhash64(*typed.columns))
    return normalize.first_per_key(keyed, ["vehicle_id", "ts"], "_order").drop("_order")


def run(spark: SparkSession, folder: str, out: str, mixed_headers: bool = True) -> Tables:
    """Raw files to every table and report under `out`. `out` must not lie inside `folder`.

    Cleaned pings and engine rows are laid out by vehicle and time; `vehicle_rows` reads some vehicles of them.
    """
    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    def clustered(df: DataFrame, name: str, time: str) -> None:
        write_clustered(df, f"{out}/{name}", "vehicle_id", [time])

    tables = Tables(pings_from(combine(spark, folder, out, mixed_headers)), save)
    clustered(clean_output(tables.points), "combined_data_cleaned_pass1", "timestamp_utc")
    save(trip_output(tables.engine_trips), "trip_file")
    clustered(row_output(tables.engine_rows), "row_file", "timestamp")
    save(trips_hybrid.pipeline_summary(tables.points, tables.trips, tables.days), "pipeline_summary")
    report(tables, save)
    return tables


def vehicle_rows(spark: SparkSession, out: str, name: str, vehicles: list[str]) -> DataFrame:
    """Rows of some vehicles from one of the tables that `run` lays out by vehicle."""
    return read_clustered(spark, f"{out}/{name}", "vehicle_id", vehicles)


def report(tables: Tables, save, most_features: int | None = None, most_categories: int | None = None) -> None:
    """The statistical summaries of the trip analysis, over all features and categories unless limits are given."""
    df, names = tables.analysis, tables.numeric_features
    categories = [c for c in route.columns_of_class(tables.trip_features, "categorical") if c not in route.DROP_COLUMNS]
    target = route.choose_target(df.columns)
    ranking = save(stats.feature_ranking(df, "trip_id", names, target), "feature_rankings")
    save(stats.correlation_summary(df, "trip_id", names, target, most=most_features), "correlations")
    save(stats.kruskal_wallis(df, categories, target, k=most_categories), "kruskal")
    save(stats.temporal_summary(df, target), "temporal")
    by_strength = [r.feature for r in ranking.orderBy(F.desc("abs_spearman"), "feature").select("feature").collect()]
    save(stats.describe(df, by_strength[:most_features]), "numeric_summary")
    save(stats.insights(ranking), "actionable_insights")


def train_job(tables: Tables, out: str, feature_set: str = "telemetry") -> DataFrame:
    """Fit both models, save the bundle under `out`, return their scores."""
    bundle, scores = train(tables.frame, feature_set)
    bundle.save(out)
    return scores


def score_job(spark: SparkSession, requests: DataFrame, bundle_folder: str) -> DataFrame:
    return score_requests(requests, Bundle.load(spark, bundle_folder))
