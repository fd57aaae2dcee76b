"""Exact decimal rounding and compact number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled_half_even(c: Column, digits: int) -> Column:
    """``c * 10**digits`` rounded half to even on the exact binary value (c >= 0).

    ``round`` works on the shortest decimal text of a double, so 12.35 (really
    12.3499...) would go up.  The fraction is split at 2**-26, which keeps the
    comparison with the midpoint exact in double arithmetic.
    """
    scale = 10 ** digits
    whole = F.floor(c)
    frac = c - whole
    step = F.floor(frac * F.lit(float(scale)))
    high = F.floor(frac * F.lit(2.0 ** 26))
    low = frac * F.lit(2.0 ** 26) - high
    above = (high * F.lit(2 * scale) - (step * 2 + 1) * F.lit(2 ** 26)).cast("double") + low * F.lit(2.0 * scale)
    up = (above > 0) | ((above == 0) & (step % 2 == 1))
    return whole * scale + step + F.when(up, 1).otherwise(0)


def round_exact(c: Column, digits: int) -> Column:
    c = c.cast("double")
    scaled = _scaled_half_even(F.abs(c), digits) / F.lit(float(10 ** digits))
    return F.when(c < 0, -scaled).otherwise(scaled)


def one_decimal(c: Column) -> Column:
    """Text with exactly one decimal, e.g. 3.0 -> '3.0'."""
    c = c.cast("double")
    tenths = _scaled_half_even(F.abs(c), 1)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def compact_weight(c: Column) -> Column:
    """Weight in at most six significant digits without trailing zeros; null -> ''."""
    c = c.cast("double")
    whole = F.floor(c)
    exponent = F.floor(F.log10(F.abs(c)))
    mantissa = F.round(c / F.pow(F.lit(10.0), exponent), 5)
    small = F.concat(F.regexp_replace(mantissa.cast("string"), r"\.0$", ""),
                     F.lit("e-"), F.lpad((-exponent).cast("string"), 2, "0"))
    places = (F.lit(5) - exponent).cast("int")
    factor = F.pow(F.lit(10.0), places)
    rounded = (F.rint(c * factor) / factor).cast("decimal(38,12)").cast("string")
    return (
        F.when(c.isNull(), F.lit(""))
        .when(c == whole, whole.cast("string"))
        .when(F.abs(c) < 1e-4, small)
        .otherwise(F.regexp_replace(rounded, r"\.?0+$", ""))
    )
