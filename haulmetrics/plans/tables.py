"""The tables of the analysis, each built from the ones before it and written once."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from haulmetrics.operators import features, model, points, route, trips_hybrid, trips_ignition
from haulmetrics.operators.normalize import snake_case, valid_coordinates
from haulmetrics.operators.timeline import BUCKET_SECONDS
from haulmetrics.plans.staging import fresh_path, stage_dense

Save = Callable[[DataFrame, str], DataFrame]


class Tables:
    """Lazily built tables over a `pings` table of one row per vehicle and time.

    Each table that several others read is saved once by `save` (default: Parquet in the shared
    folder), so later jobs scan columns of a file instead of repeating shuffles, and a lost
    executor costs one stage.
    """

    def __init__(self, pings: DataFrame, save: Save = stage_dense, width_seconds: int = BUCKET_SECONDS):
        self._source, self._save, self._width = pings, save, width_seconds
        self.spark: SparkSession = pings.sparkSession

    @cached_property
    def pings(self) -> DataFrame:
        return self._save(self._source, "pings")

    @cached_property
    def steps(self) -> DataFrame:
        return self._save(points.point_steps(self.pings, self._width), "point_steps")

    @cached_property
    def points(self) -> DataFrame:
        return self._save(points.clean_points(self.steps), "points_clean")

    @cached_property
    def all_trips(self) -> DataFrame:
        return trips_hybrid.aggregate_trips(self.points)

    @cached_property
    def trips(self) -> DataFrame:
        return self._save(trips_hybrid.add_local_date(trips_hybrid.valid_trips(self.all_trips)), "trips_hybrid")

    @cached_property
    def days(self) -> DataFrame:
        return self._save(trips_hybrid.aggregate_days(self.trips), "vehicle_day")

    @cached_property
    def engine_rows(self) -> DataFrame:
        return self._save(trips_ignition.engine_on_rows(self.steps), "rows_ignition")

    @cached_property
    def engine_trips(self) -> DataFrame:
        return self._save(trips_ignition.trips_table(self.engine_rows, self.pings, self._width), "trips_ignition")

    @cached_property
    def located_rows(self) -> DataFrame:
        return valid_coordinates(trips_ignition.row_output(self.engine_rows))

    @cached_property
    def trip_columns(self) -> DataFrame:
        return snake_case(trips_ignition.trip_output(self.engine_trips))

    @cached_property
    def merged(self) -> DataFrame:
        """Rows with valid coordinates joined to their trip, in lower case."""
        return route.join_trips(self.located_rows, self.trip_columns)

    @cached_property
    def tracked(self) -> DataFrame:
        return self._save(route.track_features(self.located_rows, self.trip_columns, self._width), "rows_tracked")

    @cached_property
    def scored(self) -> DataFrame:
        return route.route_efficiency(self.tracked)

    @cached_property
    def trip_features(self) -> DataFrame:
        return self._save(route.trip_features(self.scored), "trip_features")

    @cached_property
    def analysis(self) -> DataFrame:
        """Trip features with outliers clipped: the input of all statistics."""
        return self._save(route.clip_outliers(self.trip_features), "trip_analysis")

    @cached_property
    def numeric_features(self) -> list[str]:
        numeric = route.columns_of_class(self.trip_features, "numeric")
        return route.feature_candidates(numeric, route.choose_target(self.trip_features.columns))

    @cached_property
    def frame(self) -> DataFrame:
        return self._save(features.model_frame(self.engine_trips, self.engine_rows), "model_frame")

    @cached_property
    def trained_on_trips(self) -> tuple[model.Bundle, DataFrame]:
        """The trips-only model and its scores."""
        return model.train(self.frame, "trips")

    @cached_property
    def trained(self) -> tuple[model.Bundle, DataFrame]:
        """Both models fit, saved and loaded back, with their scores."""
        bundle, scores = model.train(self.frame)
        folder = fresh_path(self.spark, "bundle")
        bundle.save(folder)
        return model.Bundle.load(self.spark, folder), scores
