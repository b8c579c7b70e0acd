"""Column expressions shared by the operators; all stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import METRICS, SPEED_RANGE


def canonical_label(raw: Column) -> Column:
    """Trimmed, first letter upper-case, the rest lower-case; blank is null."""
    text = F.nullif(F.trim(raw), F.lit(""))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def parse_timestamp(text: Column) -> Column:
    """A time stamp with or without seconds; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))).cast("timestamp_ntz")


def valid(metric: str, probable_error: Column | None = None) -> Column:
    """Whether a metric may be analysed: not null, speeds in their range, and
    temperatures not marked as probable errors where that mark is given."""
    ok = F.col(metric).isNotNull()
    if metric == "avg_speed_kmph":
        ok = ok & F.col(metric).between(*SPEED_RANGE)
    if metric == "temperature_c" and probable_error is not None:
        ok = ok & ~F.coalesce(probable_error, F.lit(False))
    return ok


def masked(metric: str, probable_error: Column | None = None) -> Column:
    """The metric as a double where valid, else null."""
    return F.when(valid(metric, probable_error), F.col(metric).cast("double"))


def eligible() -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(valid(m), F.lit(False)) for m in METRICS))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: Chebyshev fit, relative error
    below 1.2e-7 (fixed values: the published coefficients)."""
    t = 1.0 / (1.0 + 0.5 * x)
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = F.lit(c) + t * total
    return t * F.exp(-x * x + total)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def correlation(covariance: Column, var_x: Column, var_y: Column) -> Column:
    """0 where a variance vanishes."""
    return F.when(var_x * var_y <= 0, F.lit(0.0)).otherwise(covariance / F.sqrt(var_x * var_y))


def fisher_bounds(r: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Interval of a correlation; null for n <= 3."""
    centre = F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))
    half = F.lit(z) / F.sqrt(n - 3.0)
    return F.when(n > 3, F.tanh(centre - half)), F.when(n > 3, F.tanh(centre + half))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided normal p of Fisher's z; 1 for n <= 3."""
    z = F.abs(F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))) * F.sqrt(F.greatest(n - 3.0, F.lit(0.0)))
    return F.when(n > 3, erfc(z / F.sqrt(F.lit(2.0)))).otherwise(F.lit(1.0))


def uniform32(*parts) -> Column:
    """An integer below 2**32 from the MD5 of the parts: the same in any engine
    and for any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))), 1, 8), 16, 10).cast("bigint")
