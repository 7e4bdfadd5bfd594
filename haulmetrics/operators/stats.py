"""Statistics over the trip table."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulmetrics.functions.scalars import ratio
from haulmetrics.functions.tails import chi_square_tail, student_two_sided
from haulmetrics.operators.pair_sums import correlations
from haulmetrics.operators.quantiles import HOT_ROWS, aggregate_with_quantiles, as_struct, value_range
from haulmetrics.operators.timeline import Timeline

RANK_BUCKET_ROWS = 1_000_000
MIN_PAIRS = 10
HISTOGRAM_BINS = 50
GRID = 30
TOP_CATEGORIES, INSIGHT_FEATURES = 20, 10
PROFILE_PERCENTS = [10, 25, 50, 75, 90, 95, 99]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Category, finding and action of each recommendation.
INSIGHTS = {
    "idle": ("Idle Management", "High idle time correlates with lower efficiency",
             "Optimize routes, schedules, and driver behavior to minimize stops"),
    "speed": ("Speed Management", "Speed variability impacts efficiency",
              "Driver coaching, cruise control, route optimization"),
    "time": ("Scheduling", "Peak hours reduce efficiency", "Time-shift operations and use dynamic routing"),
    "route": ("Route Planning", "Indirect routes reduce efficiency",
              "Improve routing algorithms and map data quality"),
    "signal": ("Data Quality", "GPS signal issues affect measurement", "Hardware maintenance and data filtering"),
}


def _long(df: DataFrame, keep: list[str], values: dict[str, Column], name: str = "name") -> DataFrame:
    """One row per (row, named value), NULL values left out."""
    cells = F.array(*[F.struct(F.lit(n).alias(name), v.cast("double").alias("value")) for n, v in values.items()])
    return df.select(*keep, F.inline(cells)).where(F.col("value").isNotNull())


# ---- ranks ----------------------------------------------------------------------------------

def with_value_buckets(df: DataFrame, columns: list[str], bucket_rows: int) -> DataFrame:
    """Add `_b_<column>`: the index of a range of neighbouring values, finer the more rows there are.

    The range follows from the value's distance to the column's least value, on a logarithmic scale, so it
    needs no sketch and nothing of the column on the driver. Ranges only steer parallelism; the ranks are
    exact for any.
    """
    pieces = math.ceil(df.count() / bucket_rows)
    if pieces <= 1:
        return df.withColumns({f"_b_{c}": F.lit(0) for c in columns})
    per_factor = 1 << min(30, (pieces - 1).bit_length())
    least = as_struct(df.agg(*[F.min(F.when(F.col(c) > float("-inf"), F.col(c).cast("double"))).alias(c) for c in columns]))
    out = df.withColumn("_least", least)
    above = {c: value_range(F.greatest(F.col(c) - F.col(f"_least.{c}"), F.lit(0.0)), per_factor) for c in columns}
    return out.withColumns({f"_b_{c}": F.when(F.col(c) == float("-inf"), F.lit(-1)).otherwise(above[c]) for c in columns}).drop("_least")


def average_ranks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add the average rank within `keys` to a table of distinct values.

    `counts` has one row per `keys`, `bucket` and `value`, with the number of `ties`. Values are
    counted before ranking, so ties cost one row; the running count is cut by value range, so
    no task holds a whole column.
    """
    walked = Timeline(tuple(keys), ("value",)).running(counts, {"upto": F.col("ties")})
    return walked.withColumn("rank", F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2).drop("upto")


# ---- correlation ----------------------------------------------------------------------------

def _columns_of(pairs: list[tuple[str, str]]) -> list[str]:
    return list(dict.fromkeys(c for p in pairs for c in p))


def _doubles(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _table(rows: list[list[int]]) -> Column:
    """A small literal table of integer lists, indexed by position."""
    lists = [f"array({', '.join(map(str, r))})" if r else "cast(array() AS array<int>)" for r in rows]
    return F.expr(f"array({', '.join(lists)})")


def _named(found: DataFrame, columns: list[str], places: list[tuple[int, int]], name: str) -> DataFrame:
    """Pairs that have a row complete for them, by column name."""
    x, y = (F.array(*[F.lit(columns[p[k]]) for p in places])[F.col("pair")] for k in (0, 1))
    return found.select(x.alias("x"), y.alias("y"), "n", F.col("r").alias(name))


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Linear correlation of each pair over the rows complete for it, from one scan."""
    columns = _columns_of(pairs)
    places = [(columns.index(x), columns.index(y)) for x, y in pairs]
    return _named(correlations(df.select(_doubles(columns).alias("v")), len(columns), places), columns, places, "pearson_r")


def _complete_counts(df: DataFrame, columns: list[str]) -> dict[tuple[int, int], int]:
    """Rows in which columns i and j are both present, from the few patterns of gaps."""
    present = F.concat(*[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in columns])
    patterns = df.groupBy(present.alias("present")).agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1)))

    def has(i: str) -> Column:
        return F.substring("present", F.col(i) + 1, F.lit(1)) == "1"

    both = (patterns.select("present", "n", at.alias("i")).where(has("i")).select("present", "n", "i", at.alias("j")).where(has("j"))
            .groupBy("i", "j").agg(F.sum("n").alias("n")))
    return {(r.i, r.j): r.n for r in both.collect()}


def spearman_pairs(df: DataFrame, row_id: str, pairs: list[tuple[str, str]],
                   bucket_rows: int = RANK_BUCKET_ROWS) -> DataFrame:
    """Pearson correlation of average ranks, ranked within the rows complete for the pair.

    A column is ranked once over its own rows, and again only within the rows of a partner
    that has gaps of its own; partners with equal gaps share that ranking.
    """
    columns = _columns_of(pairs)
    size = len(columns)
    together = _complete_counts(df, columns)

    def count(i: int, j: int) -> int:
        return together.get((i, j), 0)

    def context(i: int, j: int) -> int:
        """Column whose rows column i is ranked in when paired with j."""
        if count(i, i) == count(i, j):
            return i
        return next(c for c in range(size) if count(c, c) == count(j, j) == count(c, j))

    lookups, contexts = [], [set() for _ in columns]
    for x, y in pairs:
        i, j = columns.index(x), columns.index(y)
        ci, cj = context(i, j), context(j, i)
        contexts[i].add(ci)
        contexts[j].add(cj)
        lookups.append((i, j, i * size + ci, j * size + cj))

    cut = with_value_buckets(df.select(row_id, *[F.col(c).cast("double").alias(c) for c in columns]), columns, bucket_rows)
    wanted = _table([sorted(c) for c in contexts])
    cells = (cut.select(row_id, _doubles(columns).alias("v"), F.array(*[F.col(f"_b_{c}") for c in columns]).alias("b"))
             .select(row_id, "v", "b", F.posexplode("v").alias("i", "value")).where(F.col("value").isNotNull())
             .select(row_id, "v", "i", "value", F.col("b")[F.col("i")].alias("bucket"), F.explode(wanted[F.col("i")]).alias("within"))
             .where(F.col("v")[F.col("within")].isNotNull()).drop("v"))
    counts = cells.groupBy("i", "within", "bucket", "value").agg(F.count(F.lit(1)).alias("ties"))
    ranks = average_ranks(counts, ["i", "within"]).select("i", "within", "bucket", "value", "rank")
    # A row has at most one entry per column and context.
    entry = F.struct((F.col("i") * size + F.col("within")).alias("k"), "rank")
    # The file behind the cells says nothing of their number, nor do the counts of that of the ranks: neither side is broadcast.
    by_row = (cells.join(ranks.hint("merge"), ["i", "within", "bucket", "value"]).groupBy(row_id)
              .agg(F.map_from_entries(F.collect_list(entry)).alias("ranks")))
    keys = sorted({k for *_, kx, ky in lookups for k in (kx, ky)})
    wide = by_row.select(F.array(*[F.try_element_at("ranks", F.lit(k)) for k in keys]).alias("v"))
    found = correlations(wide, len(keys), [(keys.index(kx), keys.index(ky)) for *_, kx, ky in lookups])
    return _named(found, columns, [(i, j) for i, j, *_ in lookups], "spearman_r")


def feature_ranking(df: DataFrame, row_id: str, features: list[str], target: str,
                    bucket_rows: int = RANK_BUCKET_ROWS) -> DataFrame:
    """Features by strength of rank correlation with the target, over pairwise-complete rows."""
    pairs = [(f, target) for f in features]
    both = pearson_pairs(df, pairs).join(spearman_pairs(df, row_id, pairs, bucket_rows).drop("n"), ["x", "y"])
    return (both.where(F.col("n") > MIN_PAIRS)
            .select(F.col("x").alias("feature"), "n", "spearman_r", "pearson_r",
                    F.abs("spearman_r").alias("abs_spearman"), F.abs("pearson_r").alias("abs_pearson"))
            .orderBy(F.desc("abs_spearman"), "feature"))


def _all_pairs(features: list[str], target: str) -> list[tuple[str, str]]:
    names = [*features, target]
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


def _full_matrix(pairs: DataFrame, names: list[str], value: str) -> DataFrame:
    """Both triangles and the diagonal, one row per cell."""
    own = F.explode(F.array(*map(F.lit, names))).alias("x")
    diagonal = pairs.sparkSession.range(1).select(own).select("x", F.col("x").alias("y"), F.lit(1.0).alias(value))
    both = F.array(F.struct("x", "y", value), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), value))
    return pairs.select(F.inline(both)).unionByName(diagonal)


def pearson_matrix(df: DataFrame, features: list[str], target: str, most: int | None = None) -> DataFrame:
    """Correlations among the target and all features, or the first `most` of them."""
    pairs = pearson_pairs(df, _all_pairs(features[:most], target))
    return _full_matrix(pairs, [*features[:most], target], "pearson_r")


def spearman_matrix(df: DataFrame, row_id: str, features: list[str], target: str,
                    bucket_rows: int = RANK_BUCKET_ROWS, most: int | None = None) -> DataFrame:
    pairs = spearman_pairs(df, row_id, _all_pairs(features[:most], target), bucket_rows)
    return _full_matrix(pairs, [*features[:most], target], "spearman_r")


def correlation_summary(df: DataFrame, row_id: str, features: list[str], target: str,
                        bucket_rows: int = RANK_BUCKET_ROWS, most: int | None = None) -> DataFrame:
    """The target's column of both matrices, by strength of the linear correlation."""
    pairs = [(f, target) for f in features[:most]]
    both = pearson_pairs(df, pairs).join(spearman_pairs(df, row_id, pairs, bucket_rows).drop("n"), ["x", "y"])
    own = df.sparkSession.range(1).select(
        F.lit(target).alias("feature"), F.lit(1.0).alias("pearson_r"), F.lit(1.0).alias("spearman_r"))
    return (both.select(F.col("x").alias("feature"), "pearson_r", "spearman_r").unionByName(own)
            .orderBy(F.desc(F.abs("pearson_r")), "feature"))


def correlation_tests(ranking: DataFrame) -> DataFrame:
    """t statistic and two-sided p-value of each coefficient of a feature ranking."""
    def t(r: Column) -> Column:
        return r * F.sqrt(ratio(F.col("n") - 2, 1 - r * r))

    out = ranking.select("feature", "n", "pearson_r", "spearman_r", t(F.col("pearson_r")).alias("pearson_t"),
                         t(F.col("spearman_r")).alias("spearman_t"))
    freedom = (F.col("n") - 2).cast("double")
    return (out.withColumn("pearson_p", student_two_sided("pearson_t", freedom))
            .withColumn("spearman_p", student_two_sided("spearman_t", freedom)))


# ---- distributions --------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over the value range, empty bins included; the last bin is closed."""
    x = F.col(column).cast("double")
    span = as_struct(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    flat = F.col("_s.lo") == F.col("_s.hi")
    lo = F.when(flat, F.col("_s.lo") - 0.5).otherwise(F.col("_s.lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_s.hi") - F.col("_s.lo")) / bins
    counted = (df.where(x.isNotNull()).withColumn("_s", span)
               .groupBy(F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("bigint").alias("bin"))
               .agg(F.count(F.lit(1)).alias("rows_in_bin")))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("_s", span)
    return frame.join(counted, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("rows_in_bin", F.lit(0)).alias("row_count"))


def value_counts(df: DataFrame, column: str, k: int = TOP_CATEGORIES) -> DataFrame:
    """The k most frequent values, and how many distinct values there are."""
    distinct = df.agg(F.count_distinct(column)).scalar()
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    top = counts.orderBy(F.desc("row_count"), column).limit(k)
    return top.withColumn("distinct_values", distinct)


def grid_counts(df: DataFrame, x: str, y: str, grid: int = GRID) -> DataFrame:
    """Occupied cells of a square grid over two columns, with counts."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = as_struct(rows.agg(*[f(c).cast("double").alias(f"{n}_{s}") for c, s in ((x, "x"), (y, "y"))
                                for f, n in ((F.min, "lo"), (F.max, "hi"))]))

    def cell(c: str, s: str) -> Column:
        share = ratio(F.col(c) - F.col(f"_s.lo_{s}"), F.col(f"_s.hi_{s}") - F.col(f"_s.lo_{s}"))
        return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * grid), F.lit(grid - 1)).cast("bigint")

    return (rows.withColumn("_s", span).groupBy(cell(x, "x").alias("x_cell"), cell(y, "y").alias("y_cell"))
            .agg(F.count(F.lit(1)).alias("row_count")))


def linear_trend(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Least-squares line of the target on each feature."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("vx")) for f in features])
    rows = df.select(F.col(target).cast("double").alias("vy"), F.inline(cells)).where(
        F.col("vx").isNotNull() & F.col("vy").isNotNull())
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("vy", "vx").alias("slope"),
                                       F.regr_intercept("vy", "vx").alias("intercept"))


def top_category_rows(df: DataFrame, category: str, target: str, k: int | None = None) -> DataFrame:
    """(category, target) rows of all categories, or of the k most frequent ones (k rows are broadcast)."""
    rows = df.select(F.col(category).cast("string").alias("category"), F.col(target).cast("double").alias("value")).dropna()
    if k is None:
        return rows
    top = (rows.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), "category").limit(k).select("category"))
    return rows.join(F.broadcast(top), "category", "left_semi")


def box_statistics(df: DataFrame, category: str, target: str, hot_rows: int = HOT_ROWS, k: int | None = None) -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 IQR) per category, or per each of the k most frequent."""
    rows = top_category_rows(df, category, target, k)
    boxes = aggregate_with_quantiles(rows, ["category"], [F.count(F.lit(1)).alias("n")], {
        "q1": ("value", 0.25), "median": ("value", 0.5), "q3": ("value", 0.75)}, hot_rows)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    # One row per category on the box side; Spark broadcasts it if it is small.
    whiskers = (rows.join(boxes, "category").groupBy("category").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("outliers")))
    return boxes.join(whiskers, "category")


def kruskal_wallis(df: DataFrame, categories: list[str], target: str,
                   bucket_rows: int = RANK_BUCKET_ROWS, k: int | None = None) -> DataFrame:
    """Tie-corrected H, degrees of freedom and p-value per categorical feature with two groups or more.

    All categories take part, or the k most frequent of each feature; that list then has a fixed size, and
    the row numbering behind it is cut to size before the shuffle.
    """
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in categories])
    cut = with_value_buckets(df.select(F.col(target).cast("double").alias("value"), *categories), ["value"], bucket_rows)
    cells = (cut.select("value", F.col("_b_value").alias("bucket"), F.inline(named))
             .where(F.col("value").isNotNull() & F.col("category").isNotNull()))
    if k is not None:
        order = Window.partitionBy("feature").orderBy(F.desc("n"), "category")
        top = (cells.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= k).select("feature", "category"))
        cells = cells.join(F.broadcast(top), ["feature", "category"], "left_semi")
    counts = cells.groupBy("feature", "bucket", "value", "category").agg(F.count(F.lit(1)).alias("c"))
    ranks = average_ranks(counts.groupBy("feature", "bucket", "value").agg(F.sum("c").alias("ties")), ["feature"])
    t = F.col("ties").cast("double")
    ties = ranks.groupBy("feature").agg(F.sum(t * t * t - t).alias("tie_loss"))
    groups = (counts.join(ranks, ["feature", "bucket", "value"]).groupBy("feature", "category")
              .agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum")))
    tests = (groups.groupBy("feature").agg(
                F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("groups"),
                F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("squares"))
             .where(F.col("groups") >= 2).join(ties, "feature"))
    n = F.col("n")
    h = ratio(12 / (n * (n + 1)) * F.col("squares") - 3 * (n + 1), 1 - F.col("tie_loss") / (n * n * n - n))
    return (tests.select("feature", h.alias("kw_statistic"), (F.col("groups") - 1).alias("degrees_of_freedom"))
            .withColumn("kw_pvalue", chi_square_tail("kw_statistic", F.col("degrees_of_freedom").cast("double")))
            .orderBy("kw_pvalue", "feature"))


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of fixed size: the rows with the smallest MD5 of key and seed, ties by key.

    Only rows under a cutoff that leaves a few more than wanted are put in order. Where it leaves too few (many rows share a
    key), it is raised.
    """
    total = df.count()
    place = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    share = (rows + 6 * math.sqrt(rows) + 10) / max(total, 1)
    while share < 1:
        under = df.where(place <= f"{int(share * 2 ** 64):016x}")
        if under.count() >= rows:
            return under.orderBy(place, key).limit(rows)
        share *= 4
    return df.orderBy(place, key).limit(rows)


def map_points(trips: DataFrame, target: str) -> DataFrame:
    """Start and end point of every trip with its score, incomplete ones left out."""
    def ends(kind: str) -> Column:
        return F.struct(F.col(f"lat_{kind}").alias("lat"), F.col(f"lon_{kind}").alias("lon"),
                        F.col(target).alias("route_eff"), F.lit(kind).alias("type"))

    return trips.select(F.inline(F.array(ends("start"), ends("end")))).dropna()


def temporal_summary(df: DataFrame, target: str, hot_rows: int = HOT_ROWS, weekdays: bool = True) -> DataFrame:
    """Target statistics by hour of day and by weekday, under a grouping label."""
    day = F.element_at(F.array(*map(F.lit, DAY_NAMES)), (F.col("day_of_week") + 1).cast("int"))
    groups = [F.struct(F.lit("hour_of_day").alias("grouping"), F.col("hour_of_day").cast("string").alias("group_value"))]
    if weekdays:
        groups.append(F.struct(F.lit("day_of_week").alias("grouping"), day.alias("group_value")))
    rows = df.select(F.col(target).alias("value"), F.inline(F.array(*groups)))
    return aggregate_with_quantiles(
        rows, ["grouping", "group_value"],
        [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")],
        {"median": ("value", 0.5)}, hot_rows)


def percentile_profile(df: DataFrame, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Percentiles of each column, one row per column."""
    rows = _long(df, [], {c: F.col(c) for c in columns}, "column_name")
    return aggregate_with_quantiles(rows, ["column_name"], [],
                                    {f"p{p}": ("value", p / 100) for p in PROFILE_PERCENTS}, hot_rows)


def describe(df: DataFrame, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, mean, deviation, range and quartiles, one row per column."""
    rows = _long(df, [], {c: F.col(c) for c in columns}, "column_name")
    return aggregate_with_quantiles(
        rows, ["column_name"],
        [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
         F.min("value").alias("min_value"), F.max("value").alias("max_value")],
        {"q25": ("value", 0.25), "q50": ("value", 0.5), "q75": ("value", 0.75)}, hot_rows)


def insights(ranking: DataFrame, strongest: int = INSIGHT_FEATURES) -> DataFrame:
    """Recommendations set off by the strongest features of a ranking."""
    name = F.lower("feature")
    fires = {
        "idle": name.contains("idle") | name.contains("stops"),
        "speed": name.contains("speed") & ~F.col("feature").isin("speed_kmh", "speed_mps", "movement_speed",
                                                                 "implied_speed", "speed_ratio", "avg_speed"),
        "time": F.col("feature").isin("is_peak_hour", "hour_of_day"),
        "route": (F.col("feature") == "route_directness") & (F.col("spearman_r") > 0),
        "signal": F.col("feature") == "signal_reliability",
    }
    top = ranking.orderBy(F.desc("abs_spearman"), "feature").limit(strongest)
    hits = top.agg(*[F.count_if(rule).alias(k) for k, rule in fires.items()])
    lines = F.array(*[F.struct(F.col(k).alias("hits"), *[F.lit(text).alias(c) for c, text in zip(
        ("category", "finding", "action"), INSIGHTS[k])]) for k in fires])
    return hits.select(F.inline(lines)).where(F.col("hits") > 0).drop("hits")
