"""Line dedup: later copies of repeated line runs are deleted, found by prefix doubling over line-ID sequences.

Each document is a sequence of line IDs (blank lines left out), so no run crosses a document. Round by round the
suffixes get a name for their first 1, 2, 4, ... lines, made of the names of the two halves; equal names are one
interval of the suffix array, whose members share that prefix, and suffixes alone in their interval leave. The
rounds stop at `min_lines`: a maximal repeated run of that length or more is the union of the `min_lines`-blocks
inside it, so deeper order cannot change what is deleted. A block is a later copy if its interval holds an
earlier one (by id, text hash, line). Runs of one line count from `min_words` words on, which the first round tells.

Intervals are counted with map-side sums, and members meet their interval's first in a join that Spark splits when
one interval is large; no interval, however common its line, is gathered in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmetrics.plans.staging import stage

MIN_LINES = 2
MIN_WORDS = 10
WORD = "[^\\x20\\x09-\\x0D]++"


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """Indexes of the lines that are not blank."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.element_at(lines, i + 1).rlike("[^\\x20\\x09-\\x0D]"))


def suffixes(docs: DataFrame) -> DataFrame:
    """`doc_id, text_key, at, name, n_words`: a row per line that is not blank, `at` its number among those."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), _lines(F.col("text")).alias("lines"))
    filled = F.filter("lines", lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = lines.select("doc_id", "text_key", F.posexplode(filled).alias("at", "line"))
    return rows.select("doc_id", "text_key", "at", F.xxhash64("line").alias("name"),
                       (F.regexp_count("line", F.lit(WORD))).alias("n_words"))


def _place() -> Column:
    return F.struct("doc_id", "text_key", "at")


def repeated(named: DataFrame) -> DataFrame:
    """The suffixes that share their name, with the `first` place of it."""
    intervals = named.groupBy("name").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).filter("first < last")
    # written, so that the join reads two plain exchanges, which Spark can split where a name is common
    return named.join(stage(intervals.drop("last"), "line-intervals"), "name")


def later_blocks(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc_id, text_key, at, n_lines`: blocks of lines that occur earlier, overlapping ones too."""
    if min_lines < 1:
        raise ValueError("min_lines is at least 1")
    depth, found = 1, None
    active = stage(repeated(suffixes(docs)), "line-suffixes")
    later = lambda df, n: df.filter(_place() > F.col("first")).select("doc_id", "text_key", "at", F.lit(n).alias("n_lines"))
    if min_lines > 1:
        found = later(active.filter(F.col("n_words") >= min_words), 1)
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        document = Window.partitionBy("doc_id", "text_key").orderBy("at").rangeBetween(step, step)
        pairs = active.withColumn("_next", F.first("name").over(document)).filter("_next IS NOT NULL")
        depth += step
        active = repeated(pairs.select("doc_id", "text_key", "at", F.xxhash64("name", "_next").alias("name")))
        if depth < min_lines:
            active = stage(active, "line-suffixes")
    blocks = later(active, min_lines)
    return blocks if found is None else blocks.unionByName(found)


def cut(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`row` (all columns of `docs`), `n_lines` (not blank), `n_removed`, `n_runs` (stretches removed), `kept_text`.

    Blank lines stay. Null and empty texts have no lines and stay as they are (`kept_text` null for null). Rows with the
    same id and text are one document: they are cut alike and are no copies of each other. A null id is the
    earliest. Rows that lose nothing keep their text byte for byte; an empty table gives an empty result.
    """
    places = later_blocks(docs, min_lines, min_words).select(
        "doc_id", "text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n_lines") - 1)).alias("at"))
    removed = places.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("_removed"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = rows.withColumn("_id", F.col("row.doc_id")).withColumn("_key", text_key(F.col("row.text")))
    joined = keyed.join(removed, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left")
    lines = _lines(F.col("row.text"))
    prepared = joined.select("row", F.coalesce("_removed", F.array().cast("array<int>")).alias("_removed"), lines.alias("_lines"))
    indexed = prepared.withColumn("_filled", _filled(F.col("_lines")))
    gone = F.transform("_removed", lambda at: F.element_at(F.col("_filled"), at + 1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    text = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("_lines"), i + 1)), "\n")
    return indexed.select(
        "row", F.size("_filled").alias("n_lines"), F.size("_removed").alias("n_removed"),
        F.size(F.array_except("_removed", F.transform("_removed", lambda at: at + 1))).alias("n_runs"),
        F.when(F.size("_removed") > 0, text).otherwise(F.col("row.text")).alias("kept_text"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with later copies of runs deleted from `text`; rows of which no line is left go, rows that had none stay.

    Other columns stay as they are, but for a `n_chars` column, which follows the text.
    """
    kept = cut(docs, min_lines, min_words).filter("n_removed < n_lines OR n_lines = 0")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars"))
    return kept.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
