"""Column expressions that several operators share. All of them are built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of an open version's validity.
END_OF_TIME = "9999-12-31 23:59:59"
#: The watermark before the first run.
START_OF_TIME = "1900-01-01 00:00:00"


def surrogate_key(columns: list[str | Column], separator: str) -> Column:
    """md5 of the columns as text, joined by the separator; a null column is left out."""
    return F.md5(F.concat_ws(separator, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))


def is_distinct(left: Column, right: Column) -> Column:
    """Whether two values differ, a null being equal to a null only."""
    return ~left.eqNullSafe(right)


def any_distinct(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [is_distinct(x, y) for x, y in pairs], F.lit(False))


def exact_average(amount: Column) -> Column:
    """The mean of amounts with two decimals, rounded half up to two decimals, computed in whole cents so that the order of summation is of no
    account. Null amounts don't count; without any the mean is null."""
    cents, n = F.sum(F.round(amount * 100).cast("long")), F.count(amount)
    return F.when(n > 0, F.floor((2 * cents + n) / (2 * n)) / 100).cast("double")


def completed(status: Column) -> Column:
    return F.lower(status) == "completed"


def rate(hits: Column, total: Column, digits: int = 4) -> Column:
    return F.round(hits / total, digits)


def ltv_segment(revenue: Column, high: float = 1000, medium: float = 500) -> Column:
    """High from `high` on, Medium from `medium` on, else Low; no revenue is Low."""
    return F.when(revenue >= high, "High").when(revenue >= medium, "Medium").otherwise("Low")
