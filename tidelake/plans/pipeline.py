"""Orchestration: tables in their order, gated by their dependencies, incremental by watermark, stopping at the first failure."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import checks, gold, silver
from tidelake.operators.incremental import maintain, rename, since, watermark_of
from tidelake.plans.registry import BRONZE, GOLD, SILVER, BronzeTable, GoldTable, SilverTable
from tidelake.storage.table_store import TableStore
from tidelake.streaming import ingest

NO_NEW_DATA = "NO_NEW_DATA"


class LayerFailed(RuntimeError):
    """A table failed; the tables after it did not run."""


class Pipeline:
    def __init__(self, spark: SparkSession, root: str, landing: str, bronze=BRONZE, silver_tables=SILVER, gold_tables=GOLD):
        self.spark, self.landing = spark, landing
        self.store = TableStore(spark, f"{root}/tables")
        self.state_path = f"{root}/state"
        self.bronze, self.silver_tables, self.gold_tables = bronze, silver_tables, gold_tables
        self.done: dict[str, str] = {}

    # layers

    def run_bronze(self, events=None) -> dict:
        out = {}
        for t in self.bronze:
            out[t.name] = self._bronze(t)
        if events is not None:
            out["clickstream_raw"] = ingest.ingest_events(self.spark, self.store, events, self.state_path)
        return out

    def run_silver(self, pipeline: str | None = None) -> dict[str, str]:
        return self._layer([t for t in self.silver_tables if pipeline in (None, t.pipeline)], self._silver)

    def run_gold(self, pipeline: str | None = None) -> dict[str, str]:
        return self._layer([t for t in self.gold_tables if pipeline in (None, t.pipeline)], self._gold)

    def run(self, events=None) -> dict:
        self.done = {}
        return {"bronze": self.run_bronze(events), "silver": self.run_silver(), "gold": self.run_gold()}

    def _layer(self, tables: list, one: Callable) -> dict[str, str]:
        """Active tables in their order. A table whose dependencies don't exist, or did not succeed in this run, is skipped."""
        out = {}
        for t in sorted((t for t in tables if t.active), key=lambda t: t.order):
            missing = [d for d in t.depends if not self.store.exists(d) or self.done.get(d, "ok").startswith("skipped")]
            if missing:
                out[t.name] = self.done[t.name] = f"skipped: waits for {', '.join(missing)}"
                continue
            try:
                out[t.name] = self.done[t.name] = one(t)
            except Exception as e:
                raise LayerFailed(f"{t.name}: {e}") from e
        return out

    # tables

    def _bronze(self, t: BronzeTable) -> dict:
        return ingest.ingest_csv(self.spark, self.store, t.name, f"{self.landing}/{t.path}", self.state_path)

    def _incoming(self, table: str, source: str, column: str) -> tuple[DataFrame | None, dict]:
        """Rows of the source after this table's watermark, and the state to commit with the result. The watermark and the source's version
        are taken first, so rows that come meanwhile are the next run's."""
        if not self.store.exists(source):
            return None, {}
        before = self.store.state(table).get("watermark", {}).get(source)
        rows = self.store.read(source, self.store.snapshot(source).version)
        new = since(rows, column, before)
        top = watermark_of(new, column)
        if top is None:
            return None, {}
        return new, {"watermark": {**self.store.state(table).get("watermark", {}), source: top}}

    def _with_former(self, table: str, source: str, key: str, changed: DataFrame, state: dict) -> tuple[DataFrame, dict]:
        """Also the changed rows as they were when this table was last brought up to date: a row that moves leaves a group, which is affected too."""
        seen = self.store.state(table).get("seen_version", {})
        state = state | {"seen_version": {**seen, source: self.store.snapshot(source).version}}
        if source not in seen:
            return changed, state
        former = self.store.read(source, seen[source]).join(changed.select(key).distinct(), key, "left_semi")
        return changed.unionByName(former.select(*changed.columns)), state

    def _silver(self, t: SilverTable) -> str:
        new, state = self._incoming(t.name, t.source, t.watermark)
        if new is None:
            return NO_NEW_DATA
        target = self.store.read(t.name) if self.store.exists(t.name) else None
        if t.transform == "sessions":
            everything = self.store.read(t.source)
            if target is None:  # in buckets of customers, whose sessions are replaced together
                self.store.publish(t.name, silver.sessionize(everything), ["customer_id"], state=state)
            else:
                self.store.rewrite(t.name, new, lambda old: silver.sessions_of(old, everything, new), state)
            return "ok"
        new = rename(new, t.mapping).withColumns({c: F.expr(e) for c, e in t.derived.items()})
        if t.checks:
            if bad := checks.breaches(new, list(t.checks)):
                raise ValueError(f"too many rows break {', '.join(bad)}")
            new, broken = checks.split(new, list(t.checks))
            if not broken.isEmpty():
                self.store.append(f"{t.name}_quarantine", broken, batch=f"{state['watermark'][t.source]}")
        run_ts, newest = datetime.now(timezone.utc), [c for c in t.newest if c in new.columns]
        if t.transform == "scd1":
            rows = silver.scd1_rows(new, list(t.keys), newest, t.sk, run_ts)
            self.store.upsert(t.name, rows, list(t.keys), preserve=["silver_loaded_at"], state=state)
        elif t.transform == "fact":
            dims = {j.dimension: self.store.read(j.dimension) for j in t.joins}
            rows = silver.fact_rows(new, dims, list(t.joins), list(t.keys), newest, run_ts)
            self.store.upsert(t.name, rows, list(t.keys), preserve=["silver_loaded_at"], state=state)
        elif t.transform == "scd2":
            make = partial(silver.scd2, source=new, keys=list(t.keys), date=t.date, compare=list(t.compare), sk=t.sk, newest=newest, run_ts=run_ts)
            if target is None:
                self.store.publish(t.name, make(None), list(t.keys), state=state)
            else:
                self.store.rewrite(t.name, new, make, state)
        else:
            raise ValueError(f"unknown transform {t.transform}")
        return "ok"

    def _gold(self, t: GoldTable) -> str:
        facts = t.sources[0]
        column = "silver_updated_at" if facts == "orders_clean" else None
        if column:
            changed, state = self._incoming(t.name, facts, column)
            if changed is not None:
                changed, state = self._with_former(t.name, facts, "order_id", changed, state)
        else:  # sessions have no audit time: their version is the watermark
            version = self.store.snapshot(facts).version
            known = self.store.state(t.name).get("watermark", {}).get(facts)
            changed, state = (None, {}) if known == version else (self.store.read(facts), {"watermark": {facts: version}})
        if changed is None:
            return NO_NEW_DATA
        everything = self.store.read(facts)
        make, touched = self._aggregate(t.name, everything, changed)
        stamp = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        if t.mode == "incremental" and self.store.exists(t.name):
            self.store.rewrite(t.name, touched, lambda old: make(old.drop("updated_at")).withColumn("updated_at", stamp), state)
        else:
            self.store.publish(t.name, make(None).withColumn("updated_at", stamp), list(t.affected), state=state)
        return "ok"

    def _aggregate(self, name: str, facts: DataFrame, changed: DataFrame) -> tuple[Callable[[DataFrame | None], DataFrame], DataFrame]:
        """How to bring a part of the aggregate up to date (None: to make all of it), and the rows whose keys tell which part."""
        if name == "daily_sales_summary":
            products = self.store.read("dim_products")
            return lambda old: maintain(old, facts, changed, ["order_date"], lambda x: gold.daily_sales(x, products)), changed
        if name == "customer_ltv":
            customers = self.store.read("dim_customers")
            return lambda old: maintain(old, facts, changed, ["customer_sk"], lambda x: gold.customer_ltv(x, customers)), changed
        if name == "product_performance":
            products = self.store.read("dim_products")
            return lambda old: gold.product_performance_incremental(old, facts, products, changed), gold.affected_categories(changed, products)
        if name == "hourly_traffic_metrics":
            hour = F.date_trunc("hour", "first_event_ts").alias("event_hour")
            every, new = facts.select("*", hour), changed.select("*", hour)
            return lambda old: maintain(old, every, new, ["event_hour"], lambda x: gold.hourly_traffic(x.drop("event_hour"))), new
        raise ValueError(f"unknown aggregate {name}")


def reset(pipeline: Pipeline, confirm: bool = False) -> list[str]:
    """Drops every table with its state, and schemas and checkpoints. Needs confirm=True."""
    if not confirm:
        raise ValueError("reset deletes all tables and state; pass confirm=True")
    store = pipeline.store
    gone = store.list()
    for name in gone:
        store.drop(name)
    store._fs(pipeline.state_path).delete(store._path(pipeline.state_path), True)
    return gone
