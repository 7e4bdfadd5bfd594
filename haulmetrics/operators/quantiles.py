"""Exact linear-interpolated quantiles, per group or global, that survive hot groups.

The built-in `percentile` keeps every distinct value of a group in one task. That is right for the many
small groups; a group above `hot_rows` rows, and a whole table, is answered from counts of value ranges instead:
values are counted, counts are added up by range (a function of the value alone, fine and coarse), the
coarse range that holds a wanted rank is found, then the fine one in it, then the value in that. Both ways give the
same result at every size. NaN counts as missing, like NULL.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulmetrics.plans.staging import stage

HOT_ROWS = 200_000
HOT_GROUPS_TO_BROADCAST = 100_000
FINE, COARSE = 2 ** 20, 2 ** 8  # ranges per factor e


def missing_nan(value: Column) -> Column:
    """A double, or NULL for NaN."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def value_range(value: Column, per_factor: int) -> Column:
    """Index of a range of neighbouring doubles; never decreases with the value. Java's logarithm is monotonic."""
    size = F.least(F.abs(value), F.lit(1.7976931348623157e308))
    step = F.floor(F.ln(size) * F.lit(float(per_factor))).cast("bigint") + F.lit(800 * per_factor)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * step)


def aggregate_with_quantiles(df: DataFrame, keys: list[str], aggs: list[Column],
                             quantiles: dict[str, tuple[str, float]],
                             hot_rows: int = HOT_ROWS) -> DataFrame:
    """`keys`, `aggs`, and one column per `quantiles` entry `{name: (column, p)}`.

    Group keys must not be NULL. The input is read twice: once for group sizes and `aggs`, which are written to the
    shared folder, and once for the values. Where a group is hot, the second pass writes the values' counts, and every further
    step reads these.
    """
    if not quantiles:
        return df.groupBy(*keys).agg(*aggs)
    if not keys and not aggs:
        groups, hot = None, df.count() > hot_rows
    else:
        groups = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggs), "groups")
        hot = groups.agg(F.max("_rows")).first()[0]
        hot = hot is not None and hot > hot_rows
    if not hot:
        picked = _small_groups(df, keys, quantiles)
    else:
        counts = stage(_counts(df, keys, quantiles), "value-counts")
        picked = _by_ranges(counts, keys, quantiles) if groups is None else _by_size(counts, groups, keys, quantiles, hot_rows)
    if groups is None:
        return picked
    if not keys:
        return groups.drop("_rows").withColumn("_q", as_struct(picked)).select("*", "_q.*").drop("_q")
    return groups.drop("_rows").join(picked, keys, "left")


def _by_column(quantiles: dict[str, tuple[str, float]]) -> dict[str, list[tuple[str, float]]]:
    out: dict[str, list[tuple[str, float]]] = {}
    for name, (c, p) in quantiles.items():
        out.setdefault(c, []).append((name, p))
    return out


def _small_groups(df: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    exact, picks = [], {}
    for i, (c, wanted) in enumerate(_by_column(quantiles).items()):
        exact.append(F.percentile(missing_nan(F.col(c)), F.array(*[F.lit(p) for _, p in wanted])).alias(f"_q{i}"))
        picks.update({name: F.col(f"_q{i}")[j].alias(name) for j, (name, _) in enumerate(wanted)})
    return df.groupBy(*keys).agg(*exact).select(*keys, *[picks[name] for name in quantiles])


def _counts(df: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """Rows of each group, column and value, with the value's ranges. Equal values meet on the map side."""
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), missing_nan(F.col(c)).alias("_v")) for i, c in enumerate(_by_column(quantiles))])
    return (df.select(*keys, F.inline(cells)).where(F.col("_v").isNotNull())
            .groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_fine", value_range(F.col("_v"), FINE)).withColumn("_coarse", value_range(F.col("_v"), COARSE)))


def _by_size(counts: DataFrame, groups: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]], hot_rows: int) -> DataFrame:
    """Quantiles of small groups from their counts with the built-in `percentile`, of hot ones from ranges."""
    if not keys:
        return _by_ranges(counts, keys, quantiles)
    hot = groups.where(F.col("_rows") > hot_rows).select(*keys)
    if hot.count() <= HOT_GROUPS_TO_BROADCAST:
        hot = F.broadcast(hot)
    wanted = F.array(*[F.lit(float(p)) for p in sorted({p for _, p in quantiles.values()})])
    place = {p: i for i, p in enumerate(sorted({p for _, p in quantiles.values()}))}
    column = {c: i for i, c in enumerate(_by_column(quantiles))}
    each = counts.join(hot, keys, "left_anti").groupBy(*keys, "_c").agg(F.percentile("_v", wanted, F.col("_n")).alias("_q"))
    cold = each.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == column[c], F.col("_q")[place[p]])).alias(name) for name, (c, p) in quantiles.items()])
    return cold.unionByName(_by_ranges(counts.join(hot, keys, "left_semi"), keys, quantiles))


def _by_ranges(counts: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """`keys` (of groups that have a value) and the quantiles, from counts of values.

    What is gathered per group and column is one row per coarse range; per coarse range that holds a rank, one row per fine
    range in it; per fine range that holds one, its distinct values.
    """
    by_column = _by_column(quantiles)
    fine = counts.groupBy(*keys, "_c", "_coarse", "_fine").agg(F.sum("_n").alias("_n"))
    coarse = fine.groupBy(*keys, "_c", "_coarse").agg(F.sum("_n").alias("_n"))

    column = Window.partitionBy(*keys, "_c")
    targets = F.array(*[F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(p).alias("_p")) for name, p in wanted])
                        for wanted in by_column.values()])
    total = coarse.withColumn("_total", F.sum("_n").over(column)).withColumn(
        "_upto", F.sum("_n").over(column.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = (total.select("*", F.inline(targets[F.col("_c")])).withColumn("_rank", F.col("_p") * (F.col("_total") - 1))
              .select("*", F.posexplode(F.array(F.floor("_rank"), F.ceil("_rank"))).alias("_side", "_place")))
    inside = (F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_n") <= F.col("_place"))
    wanted = [*keys, "_c", "_name", "_side"]

    def narrower(picked: DataFrame, table: DataFrame, on: list[str], by: str) -> DataFrame:
        """Of the rows of `table` in the picked ranges, those that hold the place, in the order of `by`."""
        left = picked.where(inside).select(*wanted, "_rank", (F.col("_place") - (F.col("_upto") - F.col("_n"))).alias("_place"), *on[len(keys) + 1:])
        walk = Window.partitionBy(*wanted).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return table.join(left, on).withColumn("_upto", F.sum("_n").over(walk))

    in_fine = narrower(ranked, fine, [*keys, "_c", "_coarse"], "_fine")
    in_value = narrower(in_fine, counts.drop("_coarse"), [*keys, "_c", "_fine"], "_v").where(inside)
    sides = in_value.groupBy(*keys, "_name").agg(
        F.max("_rank").alias("_rank"), *[F.max(F.when(F.col("_side") == k, F.col("_v"))).alias(s) for k, s in enumerate(("_left", "_right"))])
    value = F.when(F.col("_left") == F.col("_right"), F.col("_left")).otherwise(
        (F.ceil("_rank") - F.col("_rank")) * F.col("_left") + (F.col("_rank") - F.floor("_rank")) * F.col("_right"))
    return (sides.withColumn("_value", value).groupBy(*keys)
            .agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in quantiles]))


def as_struct(one_row: DataFrame) -> Column:
    """A one-row table as a scalar subquery holding a struct of its columns."""
    return one_row.select(F.struct("*")).scalar()


def global_quantiles(df: DataFrame, quantiles: dict[str, tuple[str, float]],
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row with exact quantiles over the whole table."""
    return aggregate_with_quantiles(df, [], [], quantiles, hot_rows)
