"""Correlations from matrices of sums against exact arithmetic, pair by pair."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from haulmetrics.operators import pair_sums, stats


def table(spark, rows, parts=3):
    return spark.createDataFrame([(r,) for r in rows], "v array<double>").repartition(parts)


def brute(rows, i, j):
    """Number of complete rows and their correlation: None where a side does not vary, NaN where a value is not finite."""
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    if not all(math.isfinite(v) for p in both for v in p):
        return len(both), math.nan
    if any(len({p[k] for p in both}) < 2 for k in (0, 1)):
        return len(both), None
    x, y = ([Fraction(p[k]) for p in both] for k in (0, 1))
    mx, my = sum(x) / len(x), sum(y) / len(y)
    sxx, syy, sxy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y), sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))
    return len(both), float(sxy) / math.sqrt(float(sxx)) / math.sqrt(float(syy))


def check(spark, rows, size):
    pairs = list(itertools.permutations(range(size), 2))
    got = {r.pair: (r.n, r.r) for r in pair_sums.correlations(table(spark, rows), size, pairs).collect()}
    for k, (i, j) in enumerate(pairs):
        (n, r), (many, want) = got.get(k, (0, None)), brute(rows, i, j)
        assert n == many
        if want is None or math.isnan(want):
            assert (r is None) if want is None else math.isnan(r), ((i, j), r)
        else:
            assert r == pytest.approx(want, abs=1e-7), (i, j)


@pytest.mark.parametrize("batch_rows", [7, 4096])
def test_gaps_and_large_means(spark, monkeypatch, batch_rows):
    monkeypatch.setattr(pair_sums, "BATCH_ROWS", batch_rows)
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        a = rng.gauss(0, 1)
        row = [a, a + rng.gauss(0, 0.3), 1e9 + a, 0.1, rng.choice([1.0, 2.0, 3.0]), 1e-9 * a, rng.gauss(5, 100)]
        rows.append([None if rng.random() < 0.2 else x for x in row])
    check(spark, rows, 7)


def test_constant_within_the_pairs_rows_only(spark):
    rows = [[0.1, 1.0 * k, None] for k in range(20)] + [[0.7 * k, None, 2.0 * k] for k in range(20)] + [[0.1, 3.0, None]] * 5
    check(spark, rows, 3)


def test_odd_values_and_empty_tables(spark):
    check(spark, [[1.0, 2.0, float("nan")], [2.0, 1.0, 4.0], [3.0, None, 5.0], [4.0, 4.0, None]], 3)
    check(spark, [[1.0, float("inf"), None], [2.0, 1.0, 4.0], [3.0, 2.5, 5.0]], 3)
    check(spark, [[None, None], [1.0, None]], 2)
    assert pair_sums.correlations(table(spark, []), 2, [(0, 1)]).count() == 0


def test_one_scan_and_one_small_exchange(spark, tmp_path):
    columns = [f"c{k}" for k in range(31)]
    spark.range(200).select(*[(F.col("id") * (k + 1) % 17).cast("double").alias(c) for k, c in enumerate(columns)]).write.parquet(str(tmp_path / "t"))
    found = stats.pearson_matrix(spark.read.parquet(str(tmp_path / "t")), columns[1:], columns[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("Exchange") == plan.count("MapInArrow") == 1
    assert found.count() == 31 * 31
