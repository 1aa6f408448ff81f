"""MERGE as DataFrame functions: (target, source) -> the target afterwards.

Keys match null-safely. Each is one full outer join, so one shuffle of either side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MergeError(ValueError):
    """Several source rows match one target row."""


def check_cardinality(target: DataFrame, source: DataFrame, keys: list[str]) -> None:
    twice = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    if not target.alias("t").join(twice.alias("s"), same, "left_semi").isEmpty():
        raise MergeError(f"several source rows match one target row on {keys}")


def _joined(target: DataFrame, source: DataFrame, keys: list[str], how: str) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return target.withColumn("_t", F.lit(True)).alias("t").join(source.withColumn("_s", F.lit(True)).alias("s"), same, how)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], preserve: list[str] = (), update: list[str] | None = None) -> DataFrame:
    """Matched rows take the source's columns, others of the source are inserted, the rest stays.

    preserve: columns that keep the target's value. update: the only columns that take the source's. Values are cast to the target's types.
    """
    taken = set(update) if update is not None else set(target.columns) - set(preserve)
    kinds = dict(target.dtypes)

    def value(c: str) -> Column:
        new = F.col(f"s.{c}").cast(kinds[c]) if c in source.columns else F.lit(None).cast(kinds[c])
        from_source = F.col("s._s") if c in taken and c in source.columns else F.col("s._s") & F.col("t._t").isNull()
        return F.when(from_source, new).otherwise(F.col(f"t.{c}")).alias(c)

    return _joined(target, source, keys, "full_outer").select([value(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, keys: list[str], assign: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """Matched rows for which the condition holds get the assignments; nothing is inserted. t.c and s.c name the two sides' columns."""
    hit = F.col("s._s").isNotNull() & (condition if condition is not None else F.lit(True))
    kinds = dict(target.dtypes)
    return _joined(target, source, keys, "left").select(
        [F.when(hit, assign[c].cast(kinds[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in assign else F.col(f"t.{c}").alias(c) for c in target.columns]
    )


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those source rows whose key it does not have."""
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    new = source.alias("s").join(target.select(*keys).distinct().alias("t"), same, "left_anti")
    return target.unionByName(new.select(*target.columns))


def update_where(target: DataFrame, assign: dict[str, Column], condition: Column) -> DataFrame:
    kinds = dict(target.dtypes)
    return target.withColumns({c: F.when(condition, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in assign.items()})
