"""ANSI-safe scalar and aggregate expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, n: int = 6) -> Column:
    """Round a double for reporting; never yields negative zero.

    The shift keeps exact decimal ties from flipping with the order of summation.
    """
    return F.round(col(c).cast("double") + F.lit(3.7 * 10.0 ** -(n + 4)), n) + F.lit(0.0)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return ratio(a * F.lit(100.0), b)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation aggregate; NULL when either side is constant."""
    x, y = col(x), col(y)
    # both moments must see the same rows
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))


def stable_hash(key: Column | str, seed: int | str) -> Column:
    """md5 of key and seed: a random order that any engine can reproduce."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"#{seed}")))
