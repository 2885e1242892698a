"""Rounding by the exact value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary places that make a double below the bound a whole number of at most 62 bits.
SCALES = [(2.0**-9, 71), (1.0, 62), (2.0**10, 52), (2.0**20, 42), (2.0**30, 32), (2.0**40, 22), (2.0**52, 10)]


def round_half_even(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` (0 to 4), ties of its exact value to even.

    0.575 is a little less than 575/1000 as a double and becomes 0.57; rounding its shortest decimal
    form, as ``bround`` does, would give 0.58. From 2**52 on doubles are whole numbers and stay as they
    are, as do infinities and NaN.
    """
    size = F.abs(x)

    def scaled(places: int) -> Column:
        whole = (size * 2.0**places).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(5,0)")
        unit = F.lit(str(2**places)).cast("decimal(22,0)")
        rest = whole % unit
        low = ((whole - rest) / unit).cast("decimal(20,0)")
        half = F.lit(str(2 ** (places - 1))).cast("decimal(22,0)")
        up = F.when((rest > half) | ((rest == half) & (low % 2 == 1)), 1).otherwise(0)
        return (low + up).cast("double") / F.lit(float(10**digits))

    value = F.when(x.isNull(), F.lit(None).cast("double"))
    for bound, places in SCALES:
        value = value.when(size < bound, scaled(places))
    return F.when(size < SCALES[-1][0], value * F.signum(x)).otherwise(x)
