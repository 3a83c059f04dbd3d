"""Column functions. ANSI mode raises on division by zero, so every quotient is safe: an
undefined value is null, as NaN becomes null at ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clean(c) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(col(c)), col(c))


def nz(c, value=0.0) -> Column:
    """Null or NaN to ``value``."""
    return F.coalesce(clean(c), F.lit(value))


def log2z(c) -> Column:
    """log2 with log2(0) = 0."""
    return F.when(col(c) > 0, F.log2(col(c))).otherwise(0.0)


def heaviside(c, threshold: float = 0.0) -> Column:
    return (col(c) > threshold).cast("long")


def heaviside_neg(c) -> Column:
    return (col(c) < 0).cast("long")


def rectified(c) -> Column:
    return F.greatest(col(c), F.lit(0.0))


def rectified_neg(c) -> Column:
    return F.greatest(-col(c), F.lit(0.0))


def sign_code(c, threshold: float) -> Column:
    """1 above the threshold, 2 below its negative, else 0."""
    return F.when(col(c) >= threshold, 1).when(col(c) <= -threshold, 2).otherwise(0)


def stars(p) -> Column:
    """Significance marks of a p-value."""
    p = col(p)
    return F.when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def smoothing_bias(width, freq, cycles) -> Column:
    """Chance level of smoothed coherence."""
    return 1.0 / (1.0 + 2.0 * col(width) * col(freq) / col(cycles))


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x1) - col(x2), col(y1) - col(y2))


def ordered_pair(a, b) -> tuple[Column, Column]:
    """Two names in case-insensitive order."""
    first = F.lower(col(a)) <= F.lower(col(b))
    return F.when(first, col(a)).otherwise(col(b)), F.when(first, col(b)).otherwise(col(a))


def pair_label(a, b, sep: str = "-") -> Column:
    return F.concat_ws(sep, col(a), col(b))


def fraction(*parts) -> Column:
    """A reproducible number in [0, 1) from columns: the engine's source of randomness."""
    return F.pmod(F.xxhash64(*[col(p) for p in parts]), F.lit(1 << 53)).cast("double") / float(1 << 53)
