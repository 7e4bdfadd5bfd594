"""Vehicle CSV files in, tables out."""

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from haulmetrics.functions.scalars import ratio, round_half_even
from haulmetrics.plans.staging import fresh_path, stage

# The raw file's columns.
RAW_COLUMNS = ["Timestamp", "Latitude", "Longitude", "Speed", "EngineStatus", "Odometer",
               "FuelLevelPercentage", "GPSLocated", "Direction"]
SPARSE_PERCENT = 50
REPEATS_TO_BROADCAST = 1_000_000  # fingerprints of 16 bytes
FILES_TO_BROADCAST = 100_000  # a path and some places each
ONE_FILE_BYTES = 1 << 32  # with this as a file's opening cost, a partition takes one file
HEADER_BATCH_ROWS = 16
# Cell texts that mean "missing".
MISSING_TOKENS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                  "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", ""]
UNNAMED = "_unnamed_"
GROUP_COLUMN, VEHICLE_GROUPS = "vehicle_group", 64


def text_schema(columns: list[str]) -> T.StructType:
    """All columns as text, so a bad value becomes NULL in normalisation and not a failed read."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def plate_from_file_name(name: Column) -> Column:
    """Plate of a vehicle file. Spark reports file names percent-encoded."""
    return F.regexp_replace(F.regexp_replace(F.url_decode(name), r"\.csv", ""), " ", "")


def read_vehicle_csvs(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All `*.csv` of a folder that share one header, with the plate taken from the file name.

    A file whose header differs fails the read; see `read_mixed_csvs`.
    """
    rows = (spark.read.schema(text_schema(columns or RAW_COLUMNS))
            .option("header", True).option("enforceSchema", False)
            .option("pathGlobFilter", "*.csv").csv(folder))
    return _with_plate(rows)


def present(text: Column) -> Column:
    """The text, or NULL if it is one of the usual signs for a missing value."""
    return F.when(~text.isin(MISSING_TOKENS), text)


def _with_plate(rows: DataFrame) -> DataFrame:
    """Add the plate, in place of a column of that name. Signs for missing values become NULL, columns without a name go."""
    others = [c for c in rows.columns if c != "CarNumberPlate" and not c.startswith(UNNAMED)]
    return rows.select(*[present(F.col(f"`{c}`")).alias(c) for c in others],
                       plate_from_file_name(F.col("_metadata.file_name")).alias("CarNumberPlate"))


def header_names(line: str) -> list[str]:
    """A name per cell of a header line: an empty cell gets a generated name, a repeated one a number.

    The names are applied by position, so none may be left out.
    """
    names: list[str] = []
    for i, cell in enumerate(next(csv.reader([line.removeprefix("\ufeff").rstrip("\r\n")]), [])):
        name = cell.strip() or f"{UNNAMED}{i}"
        taken = {n.lower() for n in names}
        plain, k = name, 0
        while name.lower() in taken:
            k += 1
            name = f"{plain}.{k}"
        names.append(name)
    return names


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line that is not blank, of a partition that holds the beginning of one file. The rest is not read."""
    for batch in batches:
        if batch.num_rows and batch["start"][0].as_py() > 0:
            return
        for at, line in enumerate(batch["value"].to_pylist()):
            if line.strip():
                yield batch.slice(at, 1).select(["path", "value"])
                return


def file_headers(spark: SparkSession, folder: str) -> DataFrame:
    """`path, header` of all `*.csv` of a folder that have a line. A task opens one file and stops behind its header.

    The session's own settings would put many files in a partition, so the files are listed by a session beside it.
    """
    beside = spark.newSession()
    for name, value in {"spark.sql.files.openCostInBytes": ONE_FILE_BYTES, "spark.sql.files.maxPartitionBytes": ONE_FILE_BYTES,
                        "spark.sql.execution.arrow.maxRecordsPerBatch": HEADER_BATCH_ROWS}.items():
        beside.conf.set(name, str(value))
    lines = beside.read.option("pathGlobFilter", "*.csv").text(folder)
    first = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    target = fresh_path(spark, "file-headers")
    first.mapInArrow(_first_line, "path string, value string").withColumnRenamed("value", "header").write.parquet(target)
    return spark.read.parquet(target)


def read_mixed_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """All `*.csv` of a folder by column name; a column a file lacks is NULL in its rows.

    Files are parsed in one scan, by position. Each meets the places of its header's columns, from which the united
    columns are taken. Names that differ in case only are one column. The driver holds the different header lines, and no file names.
    """
    headers = file_headers(spark, folder)
    lines = [row.header for row in headers.select("header").distinct().orderBy("header").toLocalIterator()]
    if not lines:
        raise FileNotFoundError(f"no csv files in {folder}")
    names = {line: [name.lower() for name in header_names(line)] for line in lines}
    united = {name.lower(): name for line in reversed(lines) for name in reversed(header_names(line)) if not name.startswith(UNNAMED)}
    order = list(dict.fromkeys(name for line in lines for name in names[line] if name in united and name != "carnumberplate"))
    place = {line: {name: i for i, name in enumerate(its)} for line, its in names.items()}
    places = spark.createDataFrame([(line, [place[line].get(name, -1) for name in order]) for line in lines], "header string, places array<int>")
    of_file = headers.join(F.broadcast(places), "header").select("path", "places")
    if headers.count() <= FILES_TO_BROADCAST:
        of_file = F.broadcast(of_file)
    cells = [f"_c{i}" for i in range(max(map(len, names.values())))]
    rows = (spark.read.schema(text_schema(cells)).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
            .select(F.array(*cells).alias("cells"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name")))
    return rows.join(of_file, "path").select(
        *[present(F.get("cells", F.get("places", F.lit(k)))).alias(united[name]) for k, name in enumerate(order)],
        plate_from_file_name(F.col("file_name")).alias("CarNumberPlate"))


def stack_rows(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the union of their columns."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def missing_profile(df: DataFrame) -> DataFrame:
    """One row per column: NULL count and NULL percentage (half-even, two places)."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    lines = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("missing_count"))
                      for i, c in enumerate(df.columns)])
    percent = round_half_even(ratio(F.col("missing_count"), F.col("_rows")) * 100, 2)
    return (counted.select("_rows", F.inline(lines))
            .select("column_name", "missing_count", percent.alias("missing_percentage")))


def drop_sparse_columns(df: DataFrame, percent: float = SPARSE_PERCENT) -> DataFrame:
    """Drop columns with more than `percent` of NULLs; decided from one row per column."""
    sparse = missing_profile(df).where(F.col("missing_percentage") > percent).select("column_name").collect()
    return df.drop(*[r.column_name for r in sparse])


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Drop fully equal rows. What is shuffled is a 128-bit fingerprint of each row, and the whole rows of fingerprints seen twice.

    Rows of equal fingerprints are still compared as a whole, so a collision loses nothing. Where too many fingerprints are seen
    twice to send them to every task, and for columns that have no plain text, whole rows are aggregated at once.
    """
    plain = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not all(isinstance(f.dataType, plain) for f in df.schema.fields):
        return df.dropDuplicates()
    marked = df.withColumn("_row_mark", _row_mark(df))
    repeated = stage(marked.groupBy("_row_mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row_mark"), "repeated-rows")
    if repeated.count() > REPEATS_TO_BROADCAST:
        return df.dropDuplicates()
    here = F.broadcast(repeated)
    return (marked.join(here, "_row_mark", "left_anti").drop("_row_mark")
            .unionByName(marked.join(here, "_row_mark", "left_semi").drop("_row_mark").dropDuplicates()))


def _row_mark(df: DataFrame) -> Column:
    """A fingerprint of 128 bits: equal for equal rows, a missing value being unlike any other."""
    columns = [F.col(f"`{f.name}`") + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    gaps = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return F.struct(F.xxhash64(F.lit(1), gaps, *columns).alias("a"), F.xxhash64(F.lit(2), *columns, gaps).alias("b"))


def repeat_counts(df: DataFrame) -> DataFrame:
    """Row counts before and after `drop_repeated_rows`, as one row."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum("_copies"), F.lit(0)).cast("bigint").alias("rows_before"),
                      F.count(F.lit(1)).alias("rows_after"),
                      F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("rows_removed"))


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.option("header", True).csv(folder)


def write_parquet(df: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """Parquet with an optional partition column (a date or vehicle group, never a raw id)."""
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(folder)


def vehicle_group(vehicle: Column, groups: int = VEHICLE_GROUPS) -> Column:
    """The folder a vehicle's rows are in; the number of folders does not grow with the fleet."""
    return F.pmod(F.xxhash64(vehicle.cast("string")), F.lit(groups)).cast("int")


def write_clustered(df: DataFrame, folder: str, key: str, order: list[str], groups: int = VEHICLE_GROUPS) -> None:
    """Parquet in a folder per vehicle group, each file holding a range of vehicles and times in order.

    Ranges follow from a sample of the rows, so a vehicle with a third of them spreads over many files.
    """
    by = [GROUP_COLUMN, key, *order]
    grouped = df.withColumn(GROUP_COLUMN, vehicle_group(F.col(key), groups))
    grouped.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(GROUP_COLUMN).parquet(folder)


def read_clustered(spark: SparkSession, folder: str, key: str, vehicles: list[str] | None = None, groups: int = VEHICLE_GROUPS) -> DataFrame:
    """A table written by `write_clustered`, or the rows of some vehicles, for which only their folders and ranges are read."""
    rows = spark.read.parquet(folder)
    if vehicles is not None:
        rows = rows.where(F.col(GROUP_COLUMN).isin(*[vehicle_group(F.lit(v), groups) for v in vehicles]) & F.col(key).isin(*vehicles))
    return rows.drop(GROUP_COLUMN)
