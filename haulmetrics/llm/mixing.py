"""Mixing sources to target weights: repetition rates per source, then copies per document.

`targets` fills the sources by weight up to a cap ("water filling"); `copies` gives each document
floor(rate) copies plus one hash-seeded Bernoulli copy with the fraction as its probability;
`mix` emits the documents themselves, once per copy.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def text_size(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`(source, source_size)` rows to `(source, source_size, target)`.

    Sources in code-point order, null last, take the weights in turn and share `share` times the total;
    no target exceeds `cap` times its source, and what is cut off is shared again by weight. The level at
    which the water stands is found from running sums over the sources in order of cap / weight, so the
    table needed whole has one row per source. Sources without words get 0. An empty table stays empty.
    """
    if share > cap:
        raise ValueError("the sources cannot hold the share")
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_rank") % len(weights) + 1)
    ranked = (
        sizes.withColumn("_rank", (F.row_number().over(order) - 1).cast("int"))
        .withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_fill", F.col("_limit") / F.col("_weight"))
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("_fill", "_rank")
    earlier = Window.orderBy("_fill", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("_fill", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    # the level if all sources before this one are full and the rest are not; it holds at the first source
    # it does not overflow, and later ones show a lower level
    full = F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.sum("_weight").over(upto) + F.col("_weight")
    level = (total - full) / open_weight
    capped = ranked.withColumn("_level", level)
    final = F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(everything)
    return capped.withColumn("_final", final).select(
        "source", "source_size",
        F.least(F.col("_limit"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_limit"))).alias("target"))


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that follows from the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 12))


def copies(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
           cap: float = CAP, seed: str = "mix") -> DataFrame:
    """`docs` with `size`, `source_size`, `target` and `copies` (columns of these names are replaced).

    A null text has size 0, a null source is a source of its own, rows with equal keys draw alike,
    an empty table stays empty. Sizes are summed with map-side partial sums, and the few rows per source
    travel to the documents, so a source with a third of all rows is not gathered anywhere.
    """
    kept = docs.drop("size", "source_size", "target", "copies")
    sized = kept.withColumn("size", text_size(F.col("text")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    rates = sources.select(F.col("source").alias("_source"), "source_size", "target")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (chance(F.col(key), seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed documents: the columns of `docs`, each row `copies` times."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key, "text", "source")
    counted = copies(packed, key, **options).filter("copies > 0")
    return counted.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
