"""Queries that return an operator's whole result, beside those that SQL checks in part."""

import os

import pytest
from pyspark.sql import functions as F

from haulmetrics.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver data not present")


def test_slow_rows_are_enriched_too(spark):
    got = catalog.QUERIES["f02_enrichment_all_rows"](spark, FOLDER)
    own = catalog.fixture(spark, FOLDER).engine_rows.select("trip_id", F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("timestamp"), F.round("fuel_level", 5).alias("fuel"))
    rows = got.join(own, ["trip_id", "timestamp"], "left").collect()
    assert got.count() == len(rows) == catalog.fixture(spark, FOLDER).merged.count()
    assert any(r.speed_kmh is not None and r.speed_kmh <= 60 for r in rows)
    assert all(r.speed_kmh_combined == r.speed_kmh for r in rows)
    assert all(r.fuel_level == r.fuel or abs(r.fuel_level - r.fuel) < 2e-5 for r in rows)


def test_sample_is_whole(spark):
    table = catalog.fixture(spark, FOLDER).engine_rows
    got = catalog.QUERIES["f25_sample_rows"](spark, FOLDER)
    assert got.count() == min(table.count(), 20_000) == got.distinct().count()
    assert got.join(table, ["event_id"], "left_anti").count() == 0


def test_zones_predictions_and_scores_are_whole(spark):
    frame, run = catalog.fixture(spark, FOLDER).frame, lambda name: catalog.QUERIES[name](spark, FOLDER)
    trips = {r.trip_id for r in frame.collect()}
    assert {r.trip_id for r in run("h15_zone_ids").filter("zone_start_id IS NOT NULL").collect()} <= trips
    mae = {(r.model, r.split): r.mae for r in run("h23_regression_scores").collect()}
    for name, part in (("h21_ridge_predictions", "ridge"), ("h22_boosted_tree_predictions", "tree")):
        rows = run(name).collect()
        assert {r.trip_id for r in rows} == trips
        errors = [abs(r.prediction - r[2]) for r in rows if not r.is_train and r[2] is not None]
        (said,) = [v for (m, split), v in mae.items() if part in m and split == "test"]
        assert sum(errors) / len(errors) == pytest.approx(said, abs=1e-4)
    assert len(run("h23_trips_model_scores").collect()) == len(mae)
    best = run("h25_comparison_values").first()
    assert best.trees_mae == pytest.approx([v for (m, s), v in mae.items() if "tree" in m and s == "test"][0], abs=1e-4)


def test_importances_bundle_and_requests_are_whole(spark):
    run = lambda name: catalog.QUERIES[name](spark, FOLDER)
    values = run("h24_importance_values").collect()
    assert len(values) > run("h24_feature_importance").count()
    assert sum(r.importance for r in values) == pytest.approx(1, abs=1e-3)
    assert {"numeric_features", "test_mae", "best_iteration"} <= set(run("h26_bundle_metadata").columns)
    scores = run("h31_batch_scores").collect()
    assert len(scores) == run("h30_request_validation").count()
    assert all((r.predicted_route_efficiency is None) == bool(r.rejected_fields) for r in scores)
