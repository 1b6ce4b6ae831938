"""Decimal rounding by a double's exact value, ties to even. Spark rounds the shortest decimal text of it instead."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _scaled_round(value: Column, scale_bits: int, power: int) -> Column:
    """round(value * power) in whole numbers; exact while value * 2**scale_bits is a whole BIGINT."""
    one = F.lit(2**scale_bits).cast("decimal(20,0)")
    exact = (value * F.lit(float(2**scale_bits))).try_cast("bigint").cast("decimal(20,0)") * F.lit(power).cast("decimal(4,0)")
    low = F.floor((exact - F.pmod(exact, one)) / one).cast("bigint")
    rest = F.pmod(exact, one) * F.lit(2).cast("decimal(1,0)")
    up = (rest > one) | ((rest == one) & (F.pmod(low, F.lit(2)) == 1))
    return low + F.when(up, 1).otherwise(0)


def one_decimal(value: Column) -> Column:
    size = F.abs(value)
    return (
        F.when(size < 1, _scaled_round(value, 60, 10) / F.lit(10.0))
        .when(size < 1024, _scaled_round(value, 52, 10) / F.lit(10.0))
        .otherwise(F.bround(value, 1))
    )


def two_decimals_text(value: Column) -> Column:
    """Text like ``0.12`` for a value from 0 to 1."""
    cents = _scaled_round(value, 60, 100)
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")
    )
