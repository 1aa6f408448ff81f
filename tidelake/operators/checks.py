"""Data-quality rules: rows that break a rule go to quarantine with the names of the rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """kind: not_null, positive, allowed or sql. values: for allowed. condition: for sql. most_bad: the share of bad rows that a load bears."""

    column: str
    kind: str
    values: tuple = ()
    condition: str = ""
    most_bad: float = 1.0

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"

    def broken(self) -> Column:
        c = F.col(self.column) if self.kind != "sql" else None
        test = {"not_null": lambda: c.isNull(), "positive": lambda: ~F.coalesce(c > 0, F.lit(False)), "allowed": lambda: ~F.coalesce(c.isin(*self.values), F.lit(False)), "sql": lambda: ~F.coalesce(F.expr(self.condition), F.lit(False))}
        return test[self.kind]()


def tag(df: DataFrame, checks: list[Check]) -> DataFrame:
    """The rows with broken_rules, an array of names."""
    marks = [F.when(c.broken(), F.lit(c.name)) for c in checks]
    return df.withColumn("broken_rules", F.filter(F.array(*marks), lambda x: x.isNotNull()))


def split(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """(rows that break nothing, the quarantine)."""
    tagged = tag(df, checks)
    return tagged.where(F.size("broken_rules") == 0).drop("broken_rules"), tagged.where(F.size("broken_rules") > 0)


def breaches(df: DataFrame, checks: list[Check]) -> list[str]:
    """Checks whose share of bad rows is above what they bear; one pass over the rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c.broken()).alias(f"c{i}") for i, c in enumerate(checks)]).first()
    return [c.name for i, c in enumerate(checks) if row.n and row[f"c{i}"] / row.n > c.most_bad]
