"""The calculation kernel: seven operations as expressions, and the check of stated results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATIONS = ("ratio_percent", "growth_percent", "difference", "ratio", "sum", "count", "days_between")


def _finite(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def ratio_percent(numerator: Column, denominator: Column) -> Column:
    return F.when(_finite(numerator, denominator) & (denominator != 0), numerator / denominator * 100)


def growth_percent(current: Column, previous: Column) -> Column:
    return F.when(_finite(current, previous) & (previous != 0), (current - previous) / previous * 100)


def difference(a: Column, b: Column) -> Column:
    return F.when(_finite(a, b), a - b)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(_finite(numerator, denominator) & (denominator != 0), numerator / denominator)


def total(operands: Column) -> Column:
    """Sum of a map of operands; null if one isn't finite."""
    values = F.map_values(operands)
    return F.when(F.forall(values, lambda x: _finite(x)), F.aggregate(values, F.lit(0.0), lambda a, x: a + x))


def count(operands: Column) -> Column:
    return F.size(operands).cast("double")


def days_between(start: Column, end: Column) -> Column:
    return (F.datediff(F.try_to_date(end), F.try_to_date(start))).cast("double")


def result(operation: Column, operands: Column) -> Column:
    """The result of a stated operation over a map of operands by role (doubles; days as days since 1970)."""
    x = lambda role: F.try_element_at(operands, F.lit(role))
    return (
        F.when(operation == "ratio_percent", ratio_percent(x("numerator"), x("denominator")))
        .when(operation == "growth_percent", growth_percent(x("current"), x("previous")))
        .when(operation == "difference", difference(x("a"), x("b")))
        .when(operation == "ratio", ratio(x("numerator"), x("denominator")))
        .when(operation == "sum", total(operands))
        .when(operation == "count", count(operands))
        .when(operation == "days_between", difference(x("end"), x("start")))
    )


def half_up(c: Column, decimals: int) -> Column:
    """Rounding that any engine repeats: floor(x * 10**d + 0.5) / 10**d."""
    return F.floor(c * 10.0**decimals + 0.5) / 10.0**decimals
