"""Raw files to tables, reports, a model and scores."""

import os

from haulmetrics.plans import pipeline
from haulmetrics.plans.tables import Tables
from haulmetrics.sources.files import read_clustered


def write_vehicle(folder, plate, start):
    lines = ["Timestamp,Latitude,Longitude,Speed,EngineStatus,Odometer,FuelLevelPercentage,GPSLocated,Direction,Empty"]
    odometer = 1000.0
    for i in range(400):
        on, speed = i % 23 > 3, float((i * 7 + start) % 80)
        odometer += speed / 60 if on else 0
        minute = i + (i // 40) * 20
        lines.append(f"2025-01-{1 + minute // 1440:02d} {minute % 1440 // 60:02d}:{minute % 60:02d}:00,{3 + i * 0.001 * (1 + start % 3):.5f},{101 + i * 0.0007:.5f},"
                     f"{speed},{'True' if on else 'False'},{odometer:.3f},50,{'True' if i % 19 else 'False'},{i % 361},")
    lines += lines[5:8]  # repeated rows
    (folder / f"{plate}.csv").write_text("\n".join(lines) + "\n")


def test_files_to_predictions(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    for n, plate in enumerate(("ABA 0048", "BCD 12", "XYZ9")):
        write_vehicle(raw, plate, n)
    tables = pipeline.run(spark, str(raw), out, mixed_headers=True)
    assert "Empty" not in spark.read.parquet(f"{out}/combined").columns
    assert tables.pings.count() == 1200
    assert {r.vehicle_id for r in tables.days.select("vehicle_id").distinct().collect()} == {"ABA0048", "BCD12", "XYZ9"}
    assert len(read_clustered(spark, f"{out}/combined_data_cleaned_pass1", "vehicle_id").columns) == 25
    for name in ("combined_data_cleaned_pass1", "row_file"):
        one = pipeline.vehicle_rows(spark, out, name, ["BCD12"])
        assert one.count() == read_clustered(spark, f"{out}/{name}", "vehicle_id").filter("vehicle_id = 'BCD12'").count() > 0
    assert len(spark.read.parquet(f"{out}/trip_file").columns) == 22
    assert len(read_clustered(spark, f"{out}/row_file", "vehicle_id").columns) == 11
    for name in ("feature_rankings", "correlations", "kruskal", "temporal", "numeric_summary", "actionable_insights", "pipeline_summary"):
        assert os.path.isdir(f"{out}/{name}"), name
    bundle = str(tmp_path / "bundle")
    scores = pipeline.train_job(tables, bundle)
    assert scores.count() == 4
    wanted = ["trip_id", *pipeline_required()]
    requests = tables.frame.na.fill(0, ["Age_of_Truck_months"]).select(*wanted)
    scored = pipeline.score_job(spark, requests, bundle).collect()
    assert len(scored) == tables.frame.count()
    assert all(0 <= r.predicted_route_efficiency <= 1 for r in scored if not r.rejected_fields)


def pipeline_required():
    from haulmetrics.operators.features import REQUIRED
    return REQUIRED


def test_tables_of_the_analysis_are_written_densely(spark):
    rows = spark.range(50).select("id")
    saved = Tables(rows).pings
    assert [r.id for r in saved.orderBy("id").collect()] == list(range(50))
    assert all(f.endswith(".zstd.parquet") for f in saved.inputFiles())
