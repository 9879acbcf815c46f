"""Bearings in degrees, clockwise from north."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap360(a: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(a, F.lit(360.0))


def turn(start: Column, end: Column) -> Column:
    """The signed way from one bearing to another, in [-180, 180)."""
    return F.pmod(end - start + 180.0, F.lit(360.0)) - 180.0


def cyclic_steps(a: Column, b: Column, n: Column | int) -> Column:
    """The shorter way around between two of n steps."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.pmod(a - b, n), F.pmod(b - a, n))
