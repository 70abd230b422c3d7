"""Numeric scalars and aggregates whose result does not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER_SHAPE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_MICRO = 1_000_000


def parse_number(text: Column) -> Column:
    """Double from a decimal or exponent literal; anything else is null.

    The shape test comes first because a bare cast also takes ``5d``, ``NaN``
    and ``Infinity``.
    """
    return F.when(text.rlike(_NUMBER_SHAPE), F.trim(text).try_cast("double"))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round in binary, halves upwards: the same on every engine that has floor."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def exact_mean(value: Column) -> Column:
    """Mean that is the same for every partitioning of the input.

    Readings are fixed to millionths and summed as integers, so addition order
    has no effect. Whole and fractional parts are summed apart: each stays within
    a long for trillions of rows, and the partial aggregate needs no BigDecimal.
    """
    whole, parts = mean_parts(value)
    return mean_of_parts(F.sum(whole), F.sum(parts), F.count(value))


def mean_parts(value: Column) -> tuple[Column, Column]:
    """Whole part and millionths of a reading, as integers to be summed."""
    fixed = F.floor(value * F.lit(float(_MICRO)) + F.lit(0.5)).cast("bigint")
    parts = F.pmod(fixed, F.lit(_MICRO))
    return ((fixed - parts) / _MICRO).cast("bigint"), parts


def mean_of_parts(whole: Column, parts: Column, count: Column) -> Column:
    """Mean from the sums of ``mean_parts`` and the number of readings."""
    total = whole.cast("decimal(32,0)") * _MICRO + parts.cast("decimal(32,0)")
    return total.cast("double") / F.lit(float(_MICRO)) / count.cast("double")


def kilobytes(size: Column) -> Column:
    """Bytes to KB with two digits."""
    return round_half_up(size.cast("double") / F.lit(1024.0), 2)
