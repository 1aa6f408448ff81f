"""The table store, sources, streams, generators and the pipeline."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidelake import generators as gen
from tidelake.operators import merge
from tidelake.operators.incremental import since, watermark_of
from tidelake.plans.pipeline import NO_NEW_DATA, LayerFailed, Pipeline, reset
from tidelake.plans.registry import GOLD
from tidelake.sources import events as ev
from tidelake.sources import files
from tidelake.storage.table_store import CommitConflict, TableStore
from tidelake.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "tables"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_snapshots(spark, store):
    a = spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string")
    store.publish("t", a, ["k"], buckets=4, state={"w": 1})
    store.upsert("t", spark.createDataFrame([(3, "b"), (99, "c")], "k int, v string"))
    assert len(rows(store.read("t", 0))) == 20 and (3, "a") in rows(store.read("t", 0))
    now = rows(store.read("t"))
    assert len(now) == 21 and (3, "b") in now and (99, "c") in now
    assert store.state("t") == {"w": 1} and store.list() == ["t"]
    before, after = Snap(store, 0), Snap(store, 1)
    assert sum(before[b] == after[b] for b in before) >= 2  # untouched buckets keep their files
    store.insert_missing("t", spark.createDataFrame([(3, "x"), (7, "y"), (100, "z")], "k int, v string"), ["k"])
    assert len(rows(store.read("t"))) == 22 and (3, "b") in rows(store.read("t"))
    store.update_from("t", spark.createDataFrame([(100,)], "k int"), ["k"], {"v": F.lit("q")})
    store.update_where("t", {"v": F.lit("all")}, F.col("v") == "a")
    assert {r[1] for r in rows(store.read("t"))} == {"all", "b", "c", "q"}
    assert store.vacuum("t") == 0  # young folders may be another writer's
    assert store.vacuum("t", spare_hours=-1) >= 1 and len(rows(store.read("t"))) == 22
    store.add_column("t", "more", "int")
    store.add_column("t", "more", "string")
    assert store.read("t").dtypes[-1] == ("more", "int") and store.read("t").where("more IS NULL").count() == 22
    store.upsert("t", spark.createDataFrame([(3, "m", 5)], "k int, v string, more int"))
    assert (3, "m", 5) in rows(store.read("t")) and len(rows(store.read("t"))) == 22
    store.clear("t")
    assert rows(store.read("t")) == [] and store.exists("t")
    store.drop("t")
    assert not store.exists("t")


def Snap(store, version):
    return store._read_json(f"{store.root}/t/log/{version:012d}.json")["files"]


def test_conflicts_and_cardinality(spark, store):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    store.publish("t", a, ["k"])
    snap = store.snapshot("t")
    with pytest.raises(CommitConflict):
        store._commit("t", snap)
    with pytest.raises(merge.MergeError):
        store.upsert("t", a.union(a))


def test_one_key_merge_reads_and_writes_one_bucket(spark, store):
    store.publish("t", spark.range(5000).selectExpr("id AS k", "'a' AS v"), ["k"], buckets=16)
    seen = []
    change = lambda old: (seen.append(len({r[0] for r in old.select(store._bucket(["k"], 16)).distinct().collect()})), old)[1]
    before = Snap(store, 0)
    store.rewrite("t", spark.createDataFrame([(7,)], "k long"), change)
    store.upsert("t", spark.createDataFrame([(7, "b")], "k long, v string"))
    after = Snap(store, 2)
    assert seen == [1] and sum(before[b] != after[b] for b in before) == 1 and len(after) == 16
    assert store._names(f"{store.root}/t/staged") == []


def test_buckets_follow_the_size(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"), bucket_bytes=20_000)
    wide = lambda a, b: spark.range(a, b).selectExpr("id AS k", "sha2(CAST(id AS STRING), 512) AS v")
    assert store.publish("t", wide(0, 50), ["k"]).buckets == 1
    assert store.publish("u", wide(0, 3000), ["k"]).buckets >= 8
    grown = store.upsert("t", wide(40, 3000))
    assert grown.buckets >= 8 and len(grown.files) == grown.buckets and store.read("t").count() == 3000
    assert rows(store.read("t").select("k")) == [(r.k,) for r in sorted(wide(0, 3000).collect(), key=lambda r: str((r.k,)))]
    assert store.publish("u", wide(0, 10), ["k"]).buckets >= 8 and store.publish("u", wide(0, 10), ["k"]).buckets == 1


def test_appends_are_compacted(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"), compact_after=4)
    for i in range(7):
        store.append("t", spark.createDataFrame([(i,)], "k int"), batch=str(i))
    assert len(store.snapshot("t").files["0"]) <= 4 and [r.k for r in store.read("t").orderBy("k").collect()] == list(range(7))
    assert store.state("t")["batch"] == {"last": "6"} and store.append("t", spark.createDataFrame([(6,)], "k int"), batch="6") is None
    store.compact("t")
    assert len(store.snapshot("t").files["0"]) == 1 and store.compact("t") is None and store.read("t").count() == 7


def test_create_and_insert_with_defaults(spark, store):
    store.create("t", "k int, who string, at timestamp", ["k"])
    store.create("t", "other int")
    assert rows(store.read("t")) == [] and store.read("t").columns == ["k", "who", "at"]
    with pytest.raises(ValueError):
        store.create("t", "k int", if_missing=False)
    defaults = {"who": F.current_user(), "at": F.current_timestamp()}
    store.insert("t", spark.createDataFrame([(1, "me"), (2, None)], "k int, who string"), defaults)
    found = {r.k: r for r in store.read("t").collect()}
    assert found[1].who == "me" and found[2].who == spark.sql("SELECT current_user()").first()[0] and found[1].at is not None


def test_append_is_idempotent_by_batch(spark, store):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    store.append("t", a, batch="0")
    store.append("t", a, batch="0")
    store.append("t", a, batch="1")
    assert len(rows(store.read("t"))) == 2


BROKEN = ["garbage", "[]", "", '{"event_id":"e"}', '{"event_id":"e","customer_id":"abc"}', '{"event_id":"e","customer_id":9999999999}', '{"customer_id":1}']


def test_messages_are_routed_once(spark, store, tmp_path):
    good = ['{"event_id":"a","customer_id":1,"event_type":"search","event_ts":"2024-01-01T10:00:00+02:00","more":1}', '{"event_id":"b","customer_id":2,"event_ts":"nope"}']
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.json").write_text("\n".join(good + BROKEN))
    source = ev.Folder(str(folder))
    ingest.ingest_events(spark, store, source, str(tmp_path / "state"))
    found = {r.event_id: r for r in store.read("clickstream_raw").collect()}
    assert set(found) == {"a", "b"} and found["b"].event_ts is None and found["a"].event_ts.hour == 8
    assert sorted(r.raw_payload for r in store.read("clickstream_dead_letter").collect()) == sorted(BROKEN)
    ingest.ingest_events(spark, store, source, str(tmp_path / "state"))
    (folder / "two.json").write_text('{"event_id":"c","customer_id":3}')
    ingest.ingest_events(spark, store, source, str(tmp_path / "state"))
    assert sorted(r.event_id for r in store.read("clickstream_raw").collect()) == ["a", "b", "c"]
    report = ingest.check_source(spark, source, str(tmp_path / "check"))
    assert report["in_memory"] == len(good) + len(BROKEN) + 1


def test_drained_messages_are_not_collected(spark, tmp_path, monkeypatch):
    """The table in memory holds every message, and new ones when the source is drained again; its stream has a sink that leaves them with the executors."""
    sinks, report = [], ingest._report
    monkeypatch.setattr(ingest, "_report", lambda query: (report(query), sinks.append(query.lastProgress))[0])
    folder = tmp_path / "in"
    folder.mkdir()
    source = ev.Folder(str(folder))
    assert ingest.check_source(spark, source, str(tmp_path / "empty"))["in_memory"] == 0
    values = [f"{i} {i * i}" for i in range(5000)]
    for i in range(4):
        (folder / f"{i}.json").write_text("\n".join(values[i::4]))
    assert ingest.check_source(spark, source, str(tmp_path / "state"))["in_memory"] == 5000
    assert sinks[-1]["sink"]["description"].startswith("FileSink")
    assert sorted(r.v for r in spark.table("source_check").selectExpr("CAST(value AS STRING) AS v").collect()) == sorted(values)
    assert spark.catalog.isCached("source_check")
    (folder / "more.json").write_text("a\nb")
    assert ingest.check_source(spark, source, str(tmp_path / "state"))["in_memory"] == 5002
    spark.catalog.dropTempView("source_check")


def test_csv_schema_is_kept_and_odd_rows_are_rescued(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("id,day,x\na,2024-01-01,1.5\n")
    ingest.ingest_csv(spark, store, "t", str(folder), str(tmp_path / "state"))
    (folder / "2.csv").write_text("id,day,x\nb,2024-01-02,2.5,extra\nc,2024-01-03,word\n")
    ingest.ingest_csv(spark, store, "t", str(folder), str(tmp_path / "state"))
    found = {r.id: r for r in store.read("t").collect()}
    assert str(found["a"].day) == "2024-01-01" and found["b"].x == 2.5 and found["b"]._rescued_data == "b,2024-01-02,2.5,extra"
    assert found["c"].x is None and found["c"]._rescued_data == "c,2024-01-03,word" and found["a"]._rescued_data is None
    assert found["b"].source_file_name == "2.csv" and found["b"].source_file_modified_at is not None


def test_generators_repeat_themselves(spark):
    a, b = gen.orders(spark, 500), gen.orders(spark, 500).repartition(3)
    assert rows(a) == rows(b)
    assert a.agg(F.min("total_amount") >= 5, F.max("total_amount") <= 2000).first()[:] == (True, True)
    assert {r.status for r in a.collect()} == {"completed", "pending", "cancelled", "refunded"}
    moved = gen.order_transitions(a, 50)
    old = {r.order_id: r.status for r in a.collect()}
    assert moved.count() == 50 and all((old[r.order_id], r.status) in {("pending", "completed"), ("pending", "cancelled"), ("completed", "refunded")} for r in moved.collect())
    assert gen.next_number(a, "order_id") == 501
    clicks = gen.click_events(spark, 50)
    assert clicks.where("event_type <> 'search' AND product_id IS NULL").isEmpty() and clicks.select("event_id").distinct().count() == clicks.count()
    changed = gen.changed_customers(gen.customers(spark, 100), 20, "2026-02-01")
    assert changed.count() == 20 and gen.changed_products(gen.products(spark, 50), 10).count() == 10


def drop_off(spark, landing, step):
    c, p = gen.customers(spark, 60), gen.products(spark, 30)
    o = gen.orders(spark, 300, 60, 30, days=60, start="2024-01-01")
    if step == 0:
        for name, df in (("customers", c), ("products", p), ("orders", o)):
            files.write_csv(df.coalesce(1), f"{landing}/{name}", "append")
    else:
        files.write_csv(gen.changed_customers(c, 10, "2024-02-01").coalesce(1), f"{landing}/customers", "append")
        files.write_csv(gen.changed_products(p, 5).coalesce(1), f"{landing}/products", "append")
        new = gen.orders(spark, 50, 60, 30, first=301, days=7, start="2024-03-01")
        files.write_csv(new.unionByName(gen.order_transitions(o, 40)).coalesce(1), f"{landing}/orders", "append")


GOLD_ROWS = {
    "daily_sales_summary": ["order_date", "product_category", "total_orders", "total_revenue"],
    "customer_ltv": ["customer_sk", "total_orders", "total_revenue", "ltv_segment"],
    "product_performance": ["product_id", "units_sold", "total_revenue", "category_rank"],
    "hourly_traffic_metrics": ["event_hour", "page_views", "total_sessions", "purchase_rate"],
}


def test_pipeline_end_to_end(spark, tmp_path):
    landing, clicks = str(tmp_path / "landing"), str(tmp_path / "clicks")
    source = ev.Folder(clicks)
    pipe = Pipeline(spark, str(tmp_path / "lake"), landing)
    drop_off(spark, landing, 0)
    source.write(gen.click_events(spark, 60, 10))
    first = pipe.run(source)
    assert set(first["silver"].values()) == {"ok"} and set(first["gold"].values()) == {"ok"}
    before = {t: rows(pipe.store.read(t).select(*cols)) for t, cols in GOLD_ROWS.items()}
    again = pipe.run(source)
    assert set(again["silver"].values()) == {NO_NEW_DATA} and set(again["gold"].values()) == {NO_NEW_DATA}
    drop_off(spark, landing, 1)
    source.write(gen.click_events(spark, 20, 10, seed=7))
    pipe.run(source)
    after = {t: rows(pipe.store.read(t).select(*cols)) for t, cols in GOLD_ROWS.items()}
    assert all(before[t] != after[t] for t in after)

    customers = pipe.store.read("dim_customers")
    assert customers.groupBy("customer_id").agg(F.count_if("is_current").alias("n")).where("n <> 1").isEmpty()
    assert customers.groupBy("customer_id").count().where("count > 1").count() > 0
    orders = pipe.store.read("orders_clean")
    assert orders.count() == 350 and orders.select("order_id").distinct().count() == 350
    # kept up to date is the same as computed anew, but for products that changed category without an order
    full = Pipeline(spark, str(tmp_path / "lake"), landing, gold_tables=[type(g)(**{**g.__dict__, "mode": "full"}) for g in GOLD if g.name in ("customer_ltv", "hourly_traffic_metrics")])
    for t in ("customer_ltv", "hourly_traffic_metrics"):
        pipe.store.put_state(t, watermark={})
    full.run_gold()
    for t in ("customer_ltv", "hourly_traffic_metrics"):
        assert rows(pipe.store.read(t).select(*GOLD_ROWS[t])) == after[t]

    with pytest.raises(ValueError):
        reset(pipe)
    assert "orders_clean" in reset(pipe, confirm=True) and pipe.store.list() == []
    assert not os.path.exists(pipe.state_path)


def test_vacuum_between_silver_and_gold(spark, tmp_path):
    landing = str(tmp_path / "landing")
    pipe = Pipeline(spark, str(tmp_path / "lake"), landing)
    drop_off(spark, landing, 0)
    pipe.run()
    drop_off(spark, landing, 1)
    pipe.run_bronze()
    pipe.run_silver()
    for t in pipe.store.list():
        pipe.store.vacuum(t, spare_hours=-1)
    assert set(pipe.run_gold("batch").values()) == {"ok"}
    kept = {t: rows(pipe.store.read(t).select(*GOLD_ROWS[t])) for t in ("daily_sales_summary", "customer_ltv")}
    for t in kept:
        pipe.store.put_state(t, watermark={}, seen_version={})
        pipe.store.clear(t)
    pipe.run_gold("batch")
    assert {t: rows(pipe.store.read(t).select(*GOLD_ROWS[t])) for t in kept} == kept


@pytest.fixture
def zone(spark):
    """Sets the zone of the driver's Python and that of the session."""
    before = os.environ.get("TZ"), spark.conf.get("spark.sql.session.timeZone")

    def put(driver, session):
        os.environ["TZ"] = driver
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", session)

    yield put
    os.environ.pop("TZ") if before[0] is None else os.environ.update(TZ=before[0])
    time.tzset()
    spark.conf.set("spark.sql.session.timeZone", before[1])


def test_watermarks_are_the_same_in_every_zone(spark, tmp_path, zone):
    stamps = spark.createDataFrame([(i, 1_700_000_000_000_000 + 1_800_000_000 * i + i) for i in range(48)], "k long, us long").select("k", F.timestamp_micros("us").alias("at"))
    stamps.write.parquet(str(tmp_path / "stamps"))
    found = {}
    for i, (driver, session) in enumerate([("UTC", "UTC"), ("Asia/Tokyo", "UTC"), ("America/Los_Angeles", "UTC"), ("Asia/Tokyo", "America/Los_Angeles")]):
        zone(driver, session)
        every = spark.read.parquet(str(tmp_path / "stamps"))
        mark = watermark_of(every.where("k <= 20"), "at")
        assert json.loads(json.dumps(mark)) == mark == 1_700_000_000_000_000 + 1_800_000_000 * 20 + 20
        assert sorted(r.k for r in since(every, "at", mark).collect()) == list(range(21, 48))
        if session != "UTC":
            continue
        landing = str(tmp_path / f"landing{i}")
        only = Pipeline(spark, "x", "y")
        pipe = Pipeline(spark, str(tmp_path / f"lake{i}"), landing, only.bronze[:1], [t for t in only.silver_tables if t.name == "dim_customers"], [])
        for day in ("2020-01-01", "2024-02-01"):
            people = gen.customers(spark, 60, start=day, days=1)
            files.write_csv(people.coalesce(1), f"{landing}/customers", "append")
            assert pipe.run()["silver"] == {"dim_customers": "ok"}
        assert pipe.run()["silver"] == {"dim_customers": NO_NEW_DATA}
        found[driver] = rows(pipe.store.read("dim_customers").selectExpr("customer_id", "CAST(effective_from AS STRING)", "CAST(effective_to AS STRING)", "is_current"))
    assert len({str(x) for x in found.values()}) == 1
    assert watermark_of(stamps.limit(0), "at") is None


def test_pipeline_stops_and_skips(spark, tmp_path):
    landing = str(tmp_path / "landing")
    pipe = Pipeline(spark, str(tmp_path / "lake"), landing)
    drop_off(spark, landing, 0)
    pipe.run_bronze()
    only_fact = Pipeline(spark, str(tmp_path / "lake"), landing, silver_tables=[t for t in pipe.silver_tables if t.name == "orders_clean"])
    assert only_fact.run_silver()["orders_clean"].startswith("skipped")
    bad = [type(t)(**{**t.__dict__, "transform": "unheard of"}) if t.order == 1 else t for t in pipe.silver_tables]
    with pytest.raises(LayerFailed):
        Pipeline(spark, str(tmp_path / "lake"), landing, silver_tables=bad).run_silver()
    assert not pipe.store.exists("dim_products")


def test_live_counts_and_repeats(spark, tmp_path):
    from tidelake.streaming import live

    folder = tmp_path / "in"
    clicks = gen.click_events(spark, 40).select("event_id", "event_type", F.to_timestamp("event_ts").alias("event_ts"))
    clicks.union(clicks.limit(20)).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(clicks.schema).parquet(str(folder))
    once = live.first_seen(stream, "40 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == clicks.count()
    counts = live.hourly_counts(spark.readStream.schema(clicks.schema).parquet(str(folder)), "40 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    counts.awaitTermination()
    want = clicks.union(clicks.limit(20)).groupBy(F.date_trunc("hour", "event_ts").alias("h"), "event_type").count()
    assert rows(spark.table("counts")) == rows(want)


def test_broker_options_and_messages(spark):
    broker = ev.Broker("host:9092", "clicks", {"kafka.security.protocol": "SASL_SSL", "maxOffsetsPerTrigger": 500})
    assert broker.read_options() == {"kafka.bootstrap.servers": "host:9092", "subscribe": "clicks", "startingOffsets": "earliest", "kafka.security.protocol": "SASL_SSL", "maxOffsetsPerTrigger": "500"}
    assert broker.read_options("latest", '{"clicks":{"0":7}}')["endingOffsets"] == '{"clicks":{"0":7}}' and broker.read_options("latest")["startingOffsets"] == "latest"
    assert broker.write_options()["topic"] == "clicks" and "subscribe" not in broker.write_options()
    clicks = gen.click_events(spark, 20, 5)
    sent = ev.to_messages(clicks)
    assert sorted({r.key.decode() for r in sent.collect()}) == sorted({str(r.customer_id) for r in clicks.collect()})
    log = sent.select("key", "value", F.lit("clicks").alias("topic"), F.lit(0).alias("partition"), F.lit(1).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))
    read = ev.valid_rows(ev.parse(log))
    cols = ["event_id", "customer_id", "product_id", "event_type", "session_id", "page"]
    assert rows(read.select(cols)) == rows(clicks.select(cols)) and read.where("event_ts IS NULL").isEmpty()
    assert ev.dead_rows(ev.parse(log)).isEmpty()


def test_journeys_depend_on_what_went_before(spark):
    kinds = {}
    for r in gen.click_events(spark, 300).orderBy("session_id", "event_ts").collect():
        kinds.setdefault(r.session_id, []).append(r.event_type)
    assert {k for x in kinds.values() for k in x} == {"page_view", "search", "add_to_cart", "purchase"}
    for x in kinds.values():
        cart = seen = False
        for k in x:
            assert k != "purchase" or cart
            assert k != "add_to_cart" or seen or cart
            cart = k == "add_to_cart" or (cart and k != "purchase")
            seen = k == "page_view" or (seen and k not in ("search", "purchase"))


def test_pace_and_send(spark, tmp_path):
    now, slept = [0.0], []
    sleep = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    pace = gen.Pace(10, 0.2, clock=lambda: now[0], sleep=sleep)
    for _ in range(50):
        pace.wait()
    assert 3.9 < now[0] < 5.9 and all(0.079 < s < 0.121 for s in slept)
    clicks, out = gen.click_events(spark, 12, 5), ev.Folder(str(tmp_path / "out"))
    assert gen.send(clicks, out.write, 3, gen.Pace(1000, clock=lambda: now[0], sleep=sleep)) == clicks.count() == out.batch(spark).count()


def test_parameters(spark, tmp_path):
    from tidelake.plans import run

    args = run.parameters([str(tmp_path / "lake"), str(tmp_path / "landing"), "--layer", "silver", "--pipeline", "streaming", "--events", "host:9092/clicks"])
    assert run.event_source(args.events) == ev.Broker("host:9092", "clicks") and run.event_source("/some/folder") == ev.Folder("/some/folder") and run.event_source(None) is None
    assert run.run(spark, args) == {"silver": {"clickstream_sessions": NO_NEW_DATA}}
    with pytest.raises(ValueError):
        run.run(spark, run.parameters([str(tmp_path / "lake"), "x", "--layer", "reset"]))
