"""Row-to-row operators over long timelines, without one task per key.

A plain `Window.partitionBy(vehicle)` puts all pings of a vehicle into one task, and one
vehicle may own a third of the data. Here a timeline is cut into (key, time bucket) pieces:
window functions run inside a piece, and what crosses a piece boundary (the last row before
it, the first row after it, the total so far) comes from a table with one row per piece.
That table is built by an aggregation with map-side combine, so it is the only thing ever
gathered per key, and its size is bounded by elapsed time, not by row count.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulmetrics.plans.staging import stage

BUCKET_SECONDS = 6 * 3600


def time_bucket(epoch_micros: Column, width_seconds: int = BUCKET_SECONDS) -> Column:
    """Index of the fixed-width time bucket that holds a microsecond timestamp."""
    return F.floor(epoch_micros / F.lit(width_seconds * 1_000_000)).cast("bigint")


@dataclass(frozen=True)
class Timeline:
    """Rows of each `keys` value in the order of `order`, cut by the `bucket` column.

    `bucket` must not decrease along `order`. Rows are unique in (`keys`, `order`), and key and
    order columns are never NULL.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bucket: str = "bucket"

    @property
    def _piece(self) -> list[str]:
        return [*self.keys, self.bucket]

    def _inside(self):
        return Window.partitionBy(*self._piece).orderBy(*self.order)

    def _across(self):
        keys = self.keys or (F.lit(0),)
        return Window.partitionBy(*keys).orderBy(self.bucket)

    def _position(self) -> Column:
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)

    def neighbours(self, df: DataFrame, before: list[str] = (), after: list[str] = ()) -> DataFrame:
        """Add struct `prev` with the `before` columns of the row before, and `next` likewise.

        A struct is NULL only where there is no such row.
        """
        at, piece = self._position(), self._piece
        # the leading order column is its own position, which spares a sort before the aggregation
        ends = ([(F.max(c) if c == self.order[0] else F.max_by(c, at)).alias(f"_last_{c}") for c in before]
                + [(F.min(c) if c == self.order[0] else F.min_by(c, at)).alias(f"_first_{c}") for c in after])
        inside, carried, joined = [], [F.col(c) for c in piece], []
        for name, columns, end, step in (("prev", before, "_last_", F.lag), ("next", after, "_first_", F.lead)):
            if columns:
                edge = F.struct(*[F.col(end + c).alias(c) for c in columns])
                inside.append(step(F.struct(*columns)).over(self._inside()).alias(f"_in_{name}"))
                carried.append(step(edge).over(self._across()).alias(f"_carry_{name}"))
                joined.append(F.coalesce(f"_in_{name}", f"_carry_{name}").alias(name))
        pieces = df.groupBy(*piece).agg(*ends).select(*carried)
        kept = [c for c in df.columns if c not in ("prev", "next")]
        return df.select(*kept, *inside).join(pieces, piece, "left").select(*kept, *joined)

    def running_inside(self, total: Column) -> Column:
        """Running sum (current row included) that starts over in each piece."""
        return F.sum(total).over(self._inside().rowsBetween(Window.unboundedPreceding, 0))

    def running(self, df: DataFrame, totals: dict[str, Column], per_key: DataFrame | None = None,
                inside: dict[str, str] | None = None) -> DataFrame:
        """Add running sums (current row included) of integer expressions.

        `per_key` is a table with one row per key whose columns come along with the carried
        totals (see `attach`). `inside` names the columns of a staged `df` that hold `running_inside` of every total
        already. Then the pieces are written first: with their size known, Spark sends a small table of them to the
        rows, which need not be shuffled again.
        """
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        pieces = (df.groupBy(*self._piece).agg(*[F.sum(x).alias(f"_sum_{n}") for n, x in totals.items()])
                  .select(*self._piece, *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in totals]))
        extra = []
        if per_key is not None:
            extra = [c for c in per_key.columns if c not in self.keys]
            pieces = pieces.join(per_key, list(self.keys), "left")
        if inside:
            pieces = stage(pieces, "pieces")
        rows = df.select("*", *[(F.col(inside[n]) if inside else self.running_inside(x)).alias(f"_in_{n}") for n, x in totals.items()])
        sums = [(F.col(f"_in_{n}") + F.coalesce(f"_carry_{n}", F.lit(0))).cast("bigint").alias(n) for n in totals]
        return rows.join(pieces, self._piece, "left").select(*[c for c in df.columns if c not in totals], *sums, *extra)

    def attach(self, df: DataFrame, per_key: DataFrame) -> DataFrame:
        """Left-join a table with one row per key to the rows, piece by piece.

        The per-key values go to the list of pieces first, and from there to the rows: the rows
        stay partitioned by piece, and no key meets all its rows in one task.
        """
        pieces = df.select(*self._piece).distinct().join(per_key, list(self.keys), "left")
        return df.join(pieces, self._piece, "left")
