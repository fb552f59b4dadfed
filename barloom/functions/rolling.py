"""Column builders for fixed frames; ``w`` is the shared window of a chunked frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spec(w):
    return w() if callable(w) else w


def lag(x, k: int, w) -> Column:
    return F.lag(c(x), k).over(spec(w))


def lead(x, k: int, w) -> Column:
    return F.lead(c(x), k).over(spec(w))


def past(w, n: int):
    """The current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def ahead(w, n: int):
    """The n rows after the current one."""
    return w.rowsBetween(1, n)


def roll(fn, x, n: int, w) -> Column:
    return fn(c(x)).over(past(w, n))


def full(fn, x, n: int, w, need: int | None = None) -> Column:
    """NULL until the frame holds ``need`` (default n) non-null values."""
    return F.when(F.count(c(x)).over(past(w, n)) >= (need or n), fn(c(x)).over(past(w, n)))


def div(a, b) -> Column:
    """Division that gives NULL on a zero divisor."""
    return F.try_divide(c(a), c(b))


def flag(cond: Column) -> Column:
    """Missing compares as false, never as missing."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def log_ratio(a, b) -> Column:
    return F.ln(div(a, b))


def zscore(x, n: int, w, need: int | None = None, eps: float = EPS) -> Column:
    mean, spread = full(F.avg, x, n, w, need), full(F.stddev_samp, x, n, w, need)
    return div(c(x) - mean, spread + eps)


def adjusted_skew(x, n: int, w) -> Column:
    """Fisher-Pearson sample skewness from the population form."""
    return full(F.skewness, x, n, w) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))


def adjusted_kurtosis(x, n: int, w) -> Column:
    """Unbiased excess kurtosis from the population excess."""
    scale = (n - 1) / ((n - 2) * (n - 3))
    return F.lit(scale) * (F.lit(n + 1.0) * full(F.kurtosis, x, n, w) + 6.0)


def percent_rank_last(x, n: int, w) -> Column:
    """Average-tie rank of the newest value within the last n, as a fraction."""
    values = F.collect_list(c(x)).over(past(w, n))
    below = F.size(F.filter(values, lambda v: v < c(x)))
    equal = F.size(F.filter(values, lambda v: v == c(x)))
    return F.when(F.size(values) == n, (below + (equal + 1) / F.lit(2.0)) / F.lit(float(n)))


def finite(x) -> Column:
    """NaN and both infinities become NULL."""
    bad = F.isnan(c(x)) | (F.abs(c(x)) == F.lit(float("inf")))
    return F.when(~bad, c(x))


def sigmoid(x, slope: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(c(x) * F.lit(-float(slope))))


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c(x)))
