"""Readers, sinks and normalisation on small hand-written files."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haulmetrics.operators import normalize as nz
from haulmetrics.sources import files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "ABA 0048.csv").write_text("Timestamp,Speed,Note\n2025-01-01 00:00:00,10,x\n2025-01-01 00:01:00,,y\n")
    (tmp_path / "BCD12.csv").write_text("Speed,Timestamp\n7,2025-01-01 00:00:05\n")
    return str(tmp_path)


def test_mixed_headers_unite_by_name(spark, folder):
    df = files.read_mixed_csvs(spark, folder)
    rows = {(r.CarNumberPlate, r.Speed, r.Note) for r in df.collect()}
    assert rows == {("ABA0048", "10", "x"), ("ABA0048", None, "y"), ("BCD12", "7", None)}


def test_one_header_scan(spark, tmp_path):
    (tmp_path / "A 1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "B2.csv").write_text("a,b\n3,4\n")
    df = files.read_vehicle_csvs(spark, str(tmp_path), ["a", "b"])
    assert {tuple(r) for r in df.collect()} == {("1", "2", "A1"), ("3", "4", "B2")}


def test_sparse_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "x", "b")], "i int, s string, t string")
    assert files.drop_sparse_columns(df).columns == ["i", "t"]
    assert files.drop_repeated_rows(df).count() == 2
    assert tuple(files.repeat_counts(df).first()) == (3, 2, 1)
    assert {r.column_name: (r.missing_count, r.missing_percentage) for r in files.missing_profile(df).collect()}["s"] == (2, 66.67)


def test_half_missing_column_stays(spark):
    df = spark.createDataFrame([(None,), (1,)], "i int")
    assert files.drop_sparse_columns(df).columns == ["i"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "2025-01-01", 1.5), ("b", "2025-01-02", 2.5)], "v string, day string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    files.write_parquet(df, str(tmp_path / "p"), ["day"])
    assert sorted(d for d in os.listdir(tmp_path / "p") if d.startswith("day=")) == ["day=2025-01-01", "day=2025-01-02"]


@pytest.mark.parametrize("name,want", [
    ("Timestamp", "timestamp_utc"), ("event_date", "timestamp_utc"), ("CarNumberPlate", "vehicle_id"), ("EngineStatus", "engine_on"),
    ("Speed", "speed_kmh"), ("Odometer", "odometer_km"), ("Latitude", "lat"), ("Longitude", "lon"), ("lng", "lon"),
    ("GPSLocated", "gps_ok"), ("FuelLevel", None), ("Direction", None), ("ignition_time", "timestamp_utc")])
def test_alias_rules(name, want):
    assert nz.canonical_name(name) == want


def test_typed_values(spark):
    df = spark.createDataFrame([("False", "ON", "abc", "2025-01-01T08:00:00Z"), (None, "", "1.5", "bad"), ("true", "1", None, None)],
                               "a string, b string, n string, t string")
    got = df.select(nz.gps_flag(F.col("a")), nz.engine_flag(F.col("b")), nz.parse_number(F.col("n")), F.unix_seconds(nz.parse_time(F.col("t"))),
                    nz.python_truth(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(False, True, None, 1735718400, True), (False, False, 1.5, None, True), (True, True, None, None, True)]


def test_normalize_drops_incomplete_and_keeps_absent_columns(spark):
    raw = spark.createDataFrame([("2025-01-01 00:00:00", "A", "12.5", "ON"), ("bad", "A", "1", "ON"), ("2025-01-01 00:00:00", None, "1", "ON")],
                                "Timestamp string, CarNumberPlate string, Speed string, EngineStatus string")
    row, = nz.normalize(raw).collect()
    assert (row.vehicle_id, row.speed_kmh, row.engine_on, row.gps_ok, row.odometer_km) == ("A", 12.5, True, False, None)


def test_first_per_key_keeps_nulls_of_the_first_row(spark):
    df = spark.createDataFrame([("a", 1, 2, None), ("a", 1, 3, 5.0), ("a", 2, 1, 7.0)], "v string, s int, e int, x double")
    assert {tuple(r) for r in nz.first_per_key(df, ["v", "s"], "e").collect()} == {("a", 1, 2, None), ("a", 2, 1, 7.0)}


def test_filters_and_names(spark):
    df = spark.createDataFrame([(91.0, 0.0, 1.0), (None, 0.0, 1.0), (90.0, -180.0, -1.0)], "lat double, lon double, speed double")
    assert nz.valid_coordinates(df).count() == 1
    assert nz.non_negative_speed(df).count() == 2
    assert nz.non_negative_speed(df, "other").count() == 3
    assert nz.snake_case(df.withColumnRenamed("lat", "Trip Start Lat")).columns[0] == "trip_start_lat"


def write(folder, name, text):
    (folder / name).write_text(text)


def test_headers_keep_their_places(spark, tmp_path):
    write(tmp_path, "A1.csv", ",Timestamp,Speed,Speed\n0,2025-01-01 00:00:00,10,11\n1,2025-01-01 00:01:00,12,13\n")
    write(tmp_path, "V[1].csv", '"Timestamp","Speed, km/h"\n2025-01-01 00:02:00,"7"\n')
    write(tmp_path, "V1.csv", "Timestamp\n2025-01-01 00:03:00\n")
    got = {(r.CarNumberPlate, r.Timestamp[-5:], r.Speed, r["Speed.1"], r["Speed, km/h"]) for r in files.read_mixed_csvs(spark, str(tmp_path)).collect()}
    assert got == {("A1", "00:00", "10", "11", None), ("A1", "01:00", "12", "13", None), ("V[1]", "02:00", None, None, "7"), ("V1", "03:00", None, None, None)}


def test_many_headers_in_one_scan(spark, tmp_path):
    for i in range(40):
        write(tmp_path, f"V {i}.csv", f"Timestamp,x{i},Speed\n{i},a{i},{i * 2}\n")
    df = files.read_mixed_csvs(spark, str(tmp_path))
    assert df.columns[:3] == ["Timestamp", "x0", "Speed"] and len(df.columns) == 43
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("csv") == 1
    for r in df.collect():
        i = int(r.Timestamp)
        assert r.CarNumberPlate == f"V{i}" and r.Speed == str(i * 2) and r[f"x{i}"] == f"a{i}"
        assert sum(r[f"x{k}"] is not None for k in range(40)) == 1


def test_headers_of_odd_files(spark, tmp_path):
    write(tmp_path, "A.csv", "\n  \nTime,Speed,CarNumberPlate\n1,2,other\n3\n4,5,6,7\n")
    write(tmp_path, "B.csv", "\ufeffspeed,TIME\n8,9\n")
    write(tmp_path, "C.csv", "")
    write(tmp_path, "D.csv", "Time,Speed\n")
    df = files.read_mixed_csvs(spark, str(tmp_path))
    assert [c.lower() for c in df.columns] == ["time", "speed", "carnumberplate"]
    assert {tuple(r) for r in df.collect()} == {("1", "2", "A"), ("3", None, "A"), ("4", "5", "A"), ("9", "8", "B")}


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_mixed_csvs(spark, str(tmp_path))


def test_files_beyond_the_broadcast_limit(spark, folder, monkeypatch):
    whole = sorted(map(str, files.read_mixed_csvs(spark, folder).collect()))
    monkeypatch.setattr(files, "FILES_TO_BROADCAST", 0)
    assert sorted(map(str, files.read_mixed_csvs(spark, folder).collect())) == whole


def test_only_the_beginning_is_read_for_headers(spark, tmp_path):
    write(tmp_path, "A.csv", "a,b\n" + "1,2\n" * 100_000)
    write(tmp_path, "B.csv", "b\n" + "2\n" * 100_000)
    headers = {r.path.rsplit("/", 1)[1]: r.header for r in files.file_headers(spark, str(tmp_path)).collect()}
    assert headers == {"A.csv": "a,b", "B.csv": "b"}

    def lines():
        yield pa.RecordBatch.from_pydict({"path": ["p"] * 3, "start": [0] * 3, "value": [" ", "a,b", "1,2"]})
        raise AssertionError("read on")
    assert [b.to_pylist() for b in files._first_line(lines())] == [[{"path": "p", "value": "a,b"}]]


def test_header_names():
    assert files.header_names('\ufeffa,"b,c",,A, d \r\n') == ["a", "b,c", "_unnamed_2", "A.1", "d"]


def test_signs_for_missing_values(spark, tmp_path):
    write(tmp_path, "A.csv", "x,y\nNA,1\nNaN,1\nnull,1\n,1\nx,1\n")
    df = files.read_mixed_csvs(spark, str(tmp_path))
    assert {r.column_name: r.missing_count for r in files.missing_profile(df).collect()} == {"x": 4, "y": 0, "CarNumberPlate": 0}
    assert "x" not in files.drop_sparse_columns(df).columns


@pytest.mark.parametrize("text", ["2025-01-02 10:00:00", "2025-01-02T10:00:00Z", "01/02/2025 10:00", "1/2/2025 10:00:00", "2025/01/02 10:00", "2 Jan 2025 10:00:00"])
def test_time_formats(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.unix_seconds(nz.parse_time(F.col("t")))).first()[0] == 1735812000


def test_nan_text_is_missing(spark):
    df = spark.createDataFrame([("NaN",), ("nan",), ("1e2",)], "t string")
    assert [r[0] for r in df.select(nz.parse_number(F.col("t"))).collect()] == [None, None, 100.0]


def test_pings_through_alias_names(spark):
    raw = spark.createDataFrame([("2025-01-01 00:00:00", "A", "12.5", "ON", "1")], "Time string, Plate string, SpeedKmh string, Ignition string, gps_located string")
    row, = nz.normalize(raw).collect()
    assert (row.vehicle_id, row.speed_kmh, row.engine_on, row.gps_ok) == ("A", 12.5, True, True)
    with pytest.raises(ValueError, match="vehicle_id"):
        nz.normalize(raw.drop("Plate"))


@pytest.mark.parametrize("most", [0, 10])
def test_repeated_rows_by_fingerprint(spark, monkeypatch, most):
    """Same rows as a plain distinct, with gaps that would hash alike, signed zeros, NaN and names that clash."""
    monkeypatch.setattr(files, "REPEATS_TO_BROADCAST", most)
    nan = float("nan")
    rows = [("a", None, 0.0, 1), (None, "a", 0.0, 1), ("a", None, -0.0, 1), ("b", "b", nan, None), ("b", "b", nan, None), ("b", "b", None, None),
            (None, None, None, None), (None, None, None, None), ("", None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, n double, count int").repartition(4)
    show = lambda x: sorted(str(tuple(r)).replace("-0.0", "0.0") for r in x.collect())
    assert show(files.drop_repeated_rows(df)) == show(df.dropDuplicates())
    assert files.drop_repeated_rows(df.limit(0)).count() == 0
    listed = df.selectExpr("array(a) AS a", "count")
    assert files.drop_repeated_rows(listed).count() == listed.distinct().count()


def test_clustered_tables_are_read_by_vehicle(spark, tmp_path):
    """A third of the rows are one vehicle's; reading another one opens its folder only."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('v', id % 50)) AS vehicle_id", "timestamp_seconds(id) AS ts", "id AS n")
    folder = str(tmp_path / "t")
    files.write_clustered(df.repartition(7), folder, "vehicle_id", ["ts"], groups=16)
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(files.read_clustered(spark, folder, "vehicle_id")) == rows(df)
    some = files.read_clustered(spark, folder, "vehicle_id", ["v7", "hot"], groups=16)
    assert rows(some) == rows(df.where("vehicle_id IN ('v7', 'hot')"))
    plan = files.read_clustered(spark, folder, "vehicle_id", ["v7"], groups=16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*vehicle_group#\d+ (=|IN)", plan) and "PushedFilters: [" in plan
    assert files.read_clustered(spark, folder, "vehicle_id", ["no such"], groups=16).count() == 0
