"""Connected components by alternating large and small stars, all in joins and aggregations."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from haulmetrics.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """`(a, b)` edges between longs to `(node, component)`, the least node of each component; nodes without edge are left out.

    A round makes every node point to the least one it knows of; edges become stars in a logarithmic number of rounds.
    Each round is written, and so is the result, which plans that use it several times scan.
    """
    edges = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.withColumnRenamed("m", "b"))
        # what says whether a round changed anything is added up while the round is written
        facts = Observation("edges")
        edges = stage(small.filter("a != b").distinct().observe(facts, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        now = facts.get
        if now == seen:
            break
        seen = now
    return stage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
