"""Small numeric and time helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_time(value) -> Column:
    """A literal or column as a zone-less timestamp (``as_of`` arguments)."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def seconds_between(later, earlier) -> Column:
    """``later - earlier`` in seconds, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / F.lit(1e6)


def minus_seconds(ts, seconds) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return col(ts) - F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def within_window(ts, as_of, window_s) -> Column:
    """True while ``ts`` is strictly younger than the window."""
    return col(ts) > minus_seconds(as_time(as_of), window_s)


def count_if(cond: Column) -> Column:
    """``count`` of rows for which ``cond`` is true (NULL counts as no)."""
    return F.count(F.when(cond, F.lit(1)))


def ratio(num, den) -> Column:
    """NULL, not an error, when there is nothing to divide by."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def wrap_angle(a) -> Column:
    """Radians folded to [-pi, pi)."""
    return F.pmod(col(a) + F.lit(3.141592653589793), F.lit(6.283185307179586)) - F.lit(3.141592653589793)


def axis_diff(a_deg, b_deg) -> Column:
    """Smallest difference of two undirected bearings, in 0..90 degrees."""
    d = F.pmod(F.abs(col(a_deg) - col(b_deg)), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def discrete_percentile(ordered: Column, q: float, method: str) -> Column:
    """Pick one member of an ascending array.

    ``nearest``: index ``round((n-1)*q)`` half to even; ``truncate``: index ``floor(n*q)``;
    ``upper_median``: index ``floor(n/2)`` whatever ``q`` is.
    """
    n = F.size(ordered)
    if method == "nearest":
        idx = F.bround((n - 1) * F.lit(q)).cast("int")
    elif method == "truncate":
        idx = F.least(F.floor(n * F.lit(q)).cast("int"), n - 1)
    elif method == "upper_median":
        idx = F.floor(n / 2).cast("int")
    else:
        raise ValueError(method)
    return F.when(n > 0, F.get(ordered, idx))
