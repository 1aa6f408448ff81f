"""The cleaned layer: type 1 and type 2 dimensions, the fact, and sessions. Pure functions; the tables are the store's matter."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.columns import END_OF_TIME, any_distinct, surrogate_key
from tidelake.operators import merge
from tidelake.operators.incremental import dedup_latest


def _stamp(run_ts: datetime | None) -> Column:
    return F.lit(run_ts).cast("timestamp") if run_ts is not None else F.current_timestamp()


def scd1_rows(source: DataFrame, keys: list[str], newest: list[str], sk: str, run_ts: datetime | None = None) -> DataFrame:
    """The latest row per key with its surrogate key and audit times."""
    stamp = _stamp(run_ts)
    return dedup_latest(source, keys, newest).withColumns({sk: surrogate_key(keys, "||"), "silver_loaded_at": stamp, "silver_updated_at": stamp})


def scd1(target: DataFrame | None, source: DataFrame, keys: list[str], newest: list[str], sk: str, run_ts: datetime | None = None) -> DataFrame:
    """The dimension afterwards: one row per key, silver_loaded_at as it was first."""
    rows = scd1_rows(source, keys, newest, sk, run_ts)
    return rows if target is None else merge.upsert(target, rows, keys, preserve=["silver_loaded_at"])


def changed_rows(source: DataFrame, current: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Source rows of keys that the current versions have, with another value in a compared column; null differs from a value."""
    now = current.select(*keys, *[F.col(c).alias(f"_now_{c}") for c in compare])
    return source.join(now, keys).where(any_distinct([(F.col(c), F.col(f"_now_{c}")) for c in compare])).select(*source.columns)


def new_rows(source: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows of keys that the current versions don't have."""
    return source.join(current.select(*keys), keys, "left_anti")


def versions(rows: DataFrame, keys: list[str], date: str, compare: list[str], sk: str, collapse: bool = True) -> DataFrame:
    """Half-open intervals per key, in order of the date: effective_from, effective_to, is_current and the surrogate key of date and key.

    rows have one row per key and date. collapse: a row equal to the one before it in all compared columns is no version of its own.
    """
    order = Window.partitionBy(*keys).orderBy(date)
    if collapse:
        before = {c: F.lag(c).over(order) for c in compare}
        first = F.row_number().over(order) == 1
        rows = rows.withColumn("_new", first | any_distinct([(F.col(c), x) for c, x in before.items()])).where("_new").drop("_new")
    following = F.lead(F.col(date)).over(order)
    return rows.withColumns(
        {
            "effective_from": F.col(date),
            "effective_to": F.coalesce(following.cast("timestamp"), F.lit(END_OF_TIME).cast("timestamp")),
            "is_current": following.isNull(),
            sk: surrogate_key([date, *keys], "|"),
        }
    )


AUDIT = ["effective_from", "effective_to", "is_current", "silver_loaded_at", "silver_updated_at"]


def scd2(
    target: DataFrame | None, source: DataFrame, keys: list[str], date: str, compare: list[str], sk: str, newest: list[str] = (), run_ts: datetime | None = None, collapse: bool = True
) -> DataFrame:
    """The dimension with its history afterwards.

    The intervals of every affected key are built anew from its stored versions and the incoming rows. So a change on the day of the current version
    replaces that version, a late one is inserted where it belongs, and any order of arrival ends in the same history; running again
    changes nothing. newest: which of several incoming rows of a key and date counts. Keys without incoming rows are untouched.
    """
    stamp = _stamp(run_ts)
    attributes = [c for c in source.columns if c not in AUDIT and c != sk]
    incoming = dedup_latest(source.select(*attributes), [*keys, date], [c for c in newest if c in attributes])
    if target is None:
        return versions(incoming, keys, date, compare, sk, collapse).withColumns({"silver_loaded_at": stamp, "silver_updated_at": stamp})
    touched = incoming.select(*keys).distinct()
    stored = target.join(touched, keys, "left_semi")
    old = stored.join(incoming.select(*keys, date), [*keys, date], "left_anti").select(*attributes)
    built = versions(old.unionByName(incoming), keys, date, compare, sk, collapse)
    before = stored.select(sk, *[F.col(c).alias(f"_old_{c}") for c in ("silver_loaded_at", "silver_updated_at", "effective_to", *[a for a in attributes if a not in (*keys, date)])])
    same = ~any_distinct([(F.col(c[5:]), F.col(c)) for c in before.columns if c.startswith("_old_") and not c.startswith("_old_silver")])
    joined = built.join(before, sk, "left")
    rebuilt = joined.withColumns(
        {
            "silver_loaded_at": F.coalesce("_old_silver_loaded_at", stamp),
            "silver_updated_at": F.when(F.col("_old_silver_updated_at").isNotNull() & same, F.col("_old_silver_updated_at")).otherwise(stamp),
        }
    )
    return target.join(touched, keys, "left_anti").unionByName(rebuilt.select(*target.columns))


@dataclass(frozen=True)
class DimensionJoin:
    """Looks a surrogate key up. effective_date: the fact's date for a dimension with history, which then gives the version of that day."""

    dimension: str
    fact_key: str
    dim_key: str
    sk: str
    effective_date: str | None = None
    how: str = "left"


def lookup(facts: DataFrame, dim: DataFrame, spec: DimensionJoin) -> DataFrame:
    """The facts with the dimension's surrogate key; null where no version fits (how left), or without such facts (how inner).

    An equality join with the interval as a residual condition; its physical kind is the optimizer's choice.
    """
    wanted = [F.col(spec.dim_key).alias("_dim_key"), F.col(spec.sk)]
    on = F.col(spec.fact_key) == F.col("_dim_key")
    drop = ["_dim_key"]
    if spec.effective_date:
        wanted += [F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to")]
        day = F.col(spec.effective_date)
        on = on & (day >= F.col("_from")) & (day < F.col("_to"))
        drop += ["_from", "_to"]
    return facts.drop(spec.sk).join(dim.select(*wanted), on, spec.how).drop(*drop)


def fact_rows(source: DataFrame, dims: dict[str, DataFrame], joins: list[DimensionJoin], keys: list[str], newest: list[str], run_ts: datetime | None = None) -> DataFrame:
    """The latest row per key, with the surrogate keys of all joins in their order, and audit times."""
    out = dedup_latest(source, keys, newest)
    for spec in joins:
        out = lookup(out, dims[spec.dimension], spec)
    stamp = _stamp(run_ts)
    return out.select(*source.columns, *[j.sk for j in joins]).withColumns({"silver_loaded_at": stamp, "silver_updated_at": stamp})


def fact(target: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows if target is None else merge.upsert(target, rows, keys, preserve=["silver_loaded_at"])


#: A pause longer than this, in whole seconds, starts a session.
SESSION_GAP = 30 * 60


def session_boundaries(events: DataFrame, gap: int = SESSION_GAP, key: str = "customer_id", ts: str = "event_ts", tie: str | None = "event_id") -> DataFrame:
    """Events with a time, prev_ts, is_session_start (0 or 1) and session_num, the running count of starts. One exchange and one sort."""
    order = [F.col(ts).asc()] + ([F.col(tie).asc()] if tie and tie in events.columns else [])
    w = Window.partitionBy(key).orderBy(*order)
    pause = F.col(ts).cast("long") - F.col("prev_ts").cast("long")
    out = events.where(F.col(ts).isNotNull()).withColumn("prev_ts", F.lag(ts).over(w))
    out = out.withColumn("is_session_start", F.when(F.col("prev_ts").isNull() | (pause > gap), 1).otherwise(0))
    return out.withColumn("session_num", F.sum("is_session_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def sessionize(events: DataFrame, gap: int = SESSION_GAP, before: DataFrame | None = None) -> DataFrame:
    """One row per session: id, customer, first and last time, duration, counts by kind, whether it converted, and its date.

    before: (customer_id, n_before), how many earlier sessions a customer has that are not among the events; numbers go on from there.
    A customer's events are one window; more than one task can hold of a single customer spill to disk."""
    numbered = session_boundaries(events, gap)
    count = lambda kind: F.count_if(F.col("event_type") == kind).cast("int")
    out = numbered.groupBy("customer_id", "session_num").agg(
        F.min("event_ts").alias("first_event_ts"),
        F.max("event_ts").alias("last_event_ts"),
        F.count(F.lit(1)).cast("int").alias("event_count"),
        count("page_view").alias("page_view_count"),
        count("add_to_cart").alias("add_to_cart_count"),
        count("purchase").alias("purchase_count"),
    )
    if before is not None:
        out = out.join(before, "customer_id", "left").withColumn("session_num", F.col("session_num") + F.coalesce("n_before", F.lit(0)))
    return out.select(
        surrogate_key(["customer_id", "session_num"], "_").alias("session_id"),
        "customer_id",
        "first_event_ts",
        "last_event_ts",
        (F.col("last_event_ts").cast("long") - F.col("first_event_ts").cast("long")).alias("session_duration_secs"),
        "event_count",
        "page_view_count",
        "add_to_cart_count",
        "purchase_count",
        (F.col("purchase_count") > 0).alias("converted"),
        F.to_date("first_event_ts").alias("session_date"),
    )


def sessions_of(target: DataFrame | None, events: DataFrame, changed: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """The sessions afterwards, the same as sessionize over all events gives.

    Of a customer with new events, the sessions that ended more than the gap before the earliest of these stay, with their numbers; only events from the
    first later session on are read again, so the work follows what is new and not the customer's history. Late events leave no orphans.
    """
    if target is None:
        return sessionize(events, gap)
    earliest = changed.where(F.col("event_ts").isNotNull()).groupBy("customer_id").agg(F.min("event_ts").alias("_earliest"))
    known = target.join(earliest, "customer_id")
    settled = F.col("_earliest").cast("long") - F.col("last_event_ts").cast("long") > gap
    past = known.groupBy("customer_id").agg(F.count_if(settled).alias("n_before"), F.min(F.when(~settled, F.col("first_event_ts"))).alias("_open"))
    start = earliest.join(past, "customer_id", "left").select("customer_id", "n_before", F.least("_earliest", "_open").alias("_start"))
    again = events.join(start.select("customer_id", "_start"), "customer_id").where(F.col("event_ts") >= F.col("_start")).drop("_start")
    fresh = sessionize(again, gap, start.select("customer_id", "n_before"))
    kept = target.join(start.select("customer_id", "_start"), "customer_id", "left").where(F.col("_start").isNull() | (F.col("first_event_ts") < F.col("_start")))
    return kept.select(*target.columns).unionByName(fresh.select(*target.columns))
