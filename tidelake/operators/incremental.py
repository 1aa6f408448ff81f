"""Incremental reading and affected-key maintenance."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(df: DataFrame, column: str, watermark: int | datetime | str | None) -> DataFrame:
    """Rows strictly after the watermark; all rows, where there is none. The column stays bare, so the filter reaches the scan.

    An integer is microseconds since the epoch, as watermark_of gives it: the same instant in every time zone. A text without an offset, or a
    datetime without a zone, is a time of the session's zone or the driver's.
    """
    if watermark is None:
        return df
    mark = F.timestamp_micros(F.lit(watermark).cast("long")) if isinstance(watermark, int) else F.lit(watermark).cast("timestamp")
    return df.where(F.col(column) > mark)


def watermark_of(df: DataFrame, column: str) -> int | None:
    """The largest value in microseconds since the epoch, whatever the zones of session and driver; None for an empty table."""
    return df.agg(F.unix_micros(F.max(F.col(column).cast("timestamp"))).alias("m")).first().m


def affected(changed: DataFrame, *keys: str | Column) -> DataFrame:
    """The distinct keys of changed rows."""
    return changed.select(*keys).distinct()


def restrict(facts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Full history of the affected keys; a semi join, so nothing is multiplied."""
    return facts.join(keys, on, "left_semi")


def maintain(target: DataFrame | None, facts: DataFrame, changed: DataFrame, on: list[str], aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An aggregate brought up to date: groups of affected keys are computed anew from their full history, the others are kept.

    A group of an affected key that is no longer there goes. on: the keys that facts and the aggregate share. target None: the first run.
    """
    if target is None:
        return aggregate(facts)
    keys = affected(changed, *on)
    fresh = aggregate(restrict(facts, keys, on))
    return target.join(keys, on, "left_anti").unionByName(fresh.select(*target.columns))


def dedup_latest(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key: the newest by the columns given, ties broken by all other columns, so that the winner does not depend on the plan.

    Plans as a window with a rank limit, which cuts groups before the shuffle.
    """
    from pyspark.sql import Window

    rest = [c for c in df.columns if c not in keys and c not in newest]
    order = [F.col(c).desc_nulls_last() for c in newest] + [F.col(c).desc_nulls_last() for c in rest]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed by the mapping, all others passed through, in order."""
    return df.select([F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])
