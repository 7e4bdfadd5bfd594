"""Correlations of many column pairs from one scan.

A task adds up its rows as matrices: for all columns together, how often two of them are both present, and the means, squared
deviations and products of deviations over exactly these rows. So a row is read once however many pairs there are, and each
task gives one small row per pair. These rows are merged pair by pair with the formula for joining two sets of
deviations, which does not lose digits where means are large.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_ROWS = 4_096
ROUNDING = 1e-14
STATE = ("n", "mx", "my", "sxx", "syy", "sxy")
STATE_SCHEMA = "pair int, n long, mx double, my double, sxx double, syy double, sxy double, spoiled boolean"


def _deviations(values: np.ndarray, present: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """`STATE` of each pair of columns over these rows; missing values are 0 in `values`."""
    weight = present.astype(np.float64)
    # around a value of the column, so that a column that does not vary has deviations of exactly 0
    centre = np.sort(np.where(present, values, np.inf), axis=0)[np.minimum(present.sum(0) // 2, len(values) - 1), np.arange(values.shape[1])] if len(values) else np.zeros(values.shape[1])
    centre = np.where(np.isfinite(centre), centre, 0.0)
    shifted = np.where(present, values - centre, 0.0)
    n = (weight.T @ weight)[left, right]
    sums, squares, products = shifted.T @ weight, (shifted ** 2).T @ weight, (shifted.T @ shifted)[left, right]
    some = np.maximum(n, 1)
    x, y = sums[left, right] / some, sums[right, left] / some
    return [n, centre[left] + x, centre[right] + y, _left_over(squares[left, right], n * x * x), _left_over(squares[right, left], n * y * y), products - n * x * y]


def _left_over(squares: np.ndarray, of_mean: np.ndarray) -> np.ndarray:
    """Squared deviations from the mean; what is no more than rounding is 0."""
    out = squares - of_mean
    return np.where(out > 1e-13 * squares, out, 0.0)


def _joined(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """`STATE` of the rows of both."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy, share = b[1] - a[1], b[2] - a[2], a[0] * b[0] / some
    return [n, np.where(a[0] > 0, a[1] + dx * b[0] / some, b[1]), np.where(a[0] > 0, a[2] + dy * b[0] / some, b[2]), a[3] + b[3] + dx * dx * share, a[4] + b[4] + dy * dy * share, a[5] + b[5] + dx * dy * share]


def _task_states(size: int, pairs: list[tuple[int, int]]):
    left, right = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, spoiled = [np.zeros(len(pairs)) for _ in STATE], np.zeros(len(pairs), dtype=bool)
        for whole in batches:
            for first in range(0, len(whole), BATCH_ROWS):
                cells = whole["v"].slice(first, BATCH_ROWS).flatten()
                values = cells.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
                present = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size)
                odd = ~np.isfinite(values)
                if odd.any():
                    spoiled |= ((odd.astype(np.float64).T @ present) > 0)[left, right] | ((odd.astype(np.float64).T @ present) > 0)[right, left]
                    values = np.where(odd, 0.0, values)
                state = _joined(state, _deviations(values, present, left, right))
        met = np.flatnonzero(state[0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(state[0][met].astype(np.int64)), *[pa.array(s[met]) for s in state[1:]],
                                          pa.array(spoiled[met])], names=["pair", *STATE, "spoiled"])
    return run


def _merged(states: Column) -> Column:
    """One state of an array of them, in the order of the array."""
    def join(a: Column, b: Column) -> Column:
        n = a.n + b.n
        share, dx, dy = a.n * b.n / n, b.mx - a.mx, b.my - a.my
        return F.struct(n.alias("n"), (a.mx + dx * b.n / n).alias("mx"), (a.my + dy * b.n / n).alias("my"), (a.sxx + b.sxx + dx * dx * share).alias("sxx"),
                        (a.syy + b.syy + dy * dy * share).alias("syy"), (a.sxy + b.sxy + dx * dy * share).alias("sxy"))
    return F.aggregate(F.slice(states, 2, F.size(states)), F.element_at(states, 1), join)


def correlations(rows: DataFrame, size: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """`pair, n, r`: number of rows in which both columns of a pair are present, and their correlation over these.

    `rows` has an array `v` of `size` doubles, null where a value is missing; `pairs` are places in it. A pair without
    such a row is left out; where one side does not vary, r is null; where a value is not finite, NaN.
    """
    states = rows.select("v").mapInArrow(_task_states(size, pairs), STATE_SCHEMA)
    # a row per task and pair; sorted, so that the result does not depend on who came first
    found = states.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct(*STATE))).alias("_all"), F.max("spoiled").alias("_spoiled"))
    one = found.select("pair", "_spoiled", _merged(F.col("_all")).alias("s"))
    # deviations of no more than the last digits of the mean are none
    varies = [F.col(f"s.s{c}{c}") > F.col("s.n") * (F.col(f"s.m{c}") * ROUNDING) * (F.col(f"s.m{c}") * ROUNDING) for c in ("x", "y")]
    r = F.when(varies[0] & varies[1], F.col("s.sxy") / F.sqrt(F.col("s.sxx")) / F.sqrt(F.col("s.syy")))
    return one.select("pair", F.col("s.n").alias("n"), F.when(F.col("_spoiled"), F.lit(float("nan"))).when(
        r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).alias("r"))
