"""Null-safe scalar helpers."""

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]. `greatest`/`least` skip NULL, so NULL is passed through by hand."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high)))))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def truthy(x: Column, tokens: Iterable[str]) -> Column:
    """Whether the trimmed-down text of `x` is one of `tokens` in any case; NULL is false."""
    return F.coalesce(F.upper(x.cast("string")).isin(*tokens), F.lit(False))


def is_true(x: Column) -> Column:
    """A flag that counts NULL as false."""
    return F.coalesce(x, F.lit(False))


def total(x: Column) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def count_where(x: Column) -> Column:
    return F.count_if(x)


def seconds(ts: Column) -> Column:
    """Epoch seconds with the fraction, as a double."""
    return F.unix_micros(ts) / F.lit(1e6)


def middle_of_three(a: Column, b: Column, c: Column) -> Column:
    """Median of up to three values, NULLs skipped.

    `greatest`/`least` ignore NULL, so with one or two values the mid-range is the median.
    """
    all_there = a.isNotNull() & b.isNotNull() & c.isNotNull()
    return (F.when(all_there, F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))
            .otherwise((F.least(a, b, c) + F.greatest(a, b, c)) / 2))


def round_half_even(x: Column, places: int) -> Column:
    """Rounding of the scaled double to the nearest even, as array libraries do it."""
    scale = F.lit(float(10 ** places))
    return F.rint(x * scale) / scale


def hours_minutes(minutes: Column) -> Column:
    """Whole minutes as zero-padded `HHh MMm`."""
    whole = minutes.cast("bigint")
    return F.format_string("%02dh %02dm", F.floor(whole / 60).cast("bigint"), whole % 60)
