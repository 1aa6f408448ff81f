"""The engine's queries over the test tables and their DuckDB equivalents, by name."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import generators
from tidelake.functions.columns import completed, surrogate_key
from tidelake.operators import checks, dashboard, gold, incremental, merge, silver
from tidelake.plans import retail
from tidelake.plans.pipeline import Pipeline, reset
from tidelake.plans.registry import BRONZE, SILVER
from tidelake.sources import events as ev
from tidelake.sources.files import RESCUED, read_csv, with_lineage, write_csv
from tidelake.storage.table_store import TableStore
from tidelake.streaming import ingest

#: Where history is cut into what has been loaded and what is new.
CUT = "1996-01-01"
LOW_28, LOW_6M, HIGH = "1997-06-03", "1997-01-01", "1997-06-30"
LTV = {"high": 1_000_000, "medium": 500_000}

QUERIES: dict = {}
ORACLES: dict = {}

#: The retail model in SQL.
MODEL = """
    oc AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS total_amount,
                  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
                  md5(CAST(o_custkey AS VARCHAR)) AS customer_sk FROM orders),
    ol AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_extendedprice AS total_amount, md5(CAST(l_partkey AS VARCHAR)) AS products_sk,
                  order_date, status FROM lineitem JOIN oc ON l_orderkey = order_id),
    dp AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_retailprice AS price, md5(CAST(p_partkey AS VARCHAR)) AS products_sk FROM part),
    dc AS (SELECT c_custkey AS customer_id, c_name AS name, lower(replace(c_name, '#', '.')) || '@mail.test' AS email, r_name AS region,
                  md5(CAST(c_custkey AS VARCHAR)) AS customer_sk FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    fd AS (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS modified_at, o_orderpriority AS priority, o_orderkey AS seen FROM orders),
    cl AS (SELECT event_id, user_id AS customer_id, CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase' ELSE 'search' END AS event_type,
                  ts AS event_ts, props FROM events),
    sb AS (SELECT *, CASE WHEN prev_ts IS NULL OR floor(epoch(event_ts)) - floor(epoch(prev_ts)) > 1800 THEN 1 ELSE 0 END AS is_session_start
           FROM (SELECT *, lag(event_ts) OVER (PARTITION BY customer_id ORDER BY event_ts, event_id) AS prev_ts FROM cl)),
    sn AS (SELECT *, CAST(sum(is_session_start) OVER (PARTITION BY customer_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_num FROM sb),
    ss AS (SELECT md5(customer_id || '_' || session_num) AS session_id, customer_id, min(event_ts) AS first_event_ts, max(event_ts) AS last_event_ts,
                  CAST(floor(epoch(max(event_ts))) - floor(epoch(min(event_ts))) AS BIGINT) AS session_duration_secs, CAST(count(*) AS INTEGER) AS event_count,
                  CAST(count(*) FILTER (event_type = 'page_view') AS INTEGER) AS page_view_count, CAST(count(*) FILTER (event_type = 'add_to_cart') AS INTEGER) AS add_to_cart_count,
                  CAST(count(*) FILTER (event_type = 'purchase') AS INTEGER) AS purchase_count, count(*) FILTER (event_type = 'purchase') > 0 AS converted,
                  CAST(min(event_ts) AS DATE) AS session_date FROM sn GROUP BY customer_id, session_num),
    ds AS (SELECT order_date, category AS product_category, count(DISTINCT order_id) AS total_orders, round(sum(total_amount), 2) AS total_revenue,
                  (2 * CAST(sum(CAST(round(total_amount * 100) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*)) / 100 AS avg_revenue_per_order
           FROM ol JOIN dp USING (products_sk) WHERE lower(status) = 'completed' GROUP BY ALL),
    ps AS (SELECT products_sk, dp.product_id, product_name, category, count(DISTINCT order_id) AS units_sold, round(sum(total_amount), 2) AS total_revenue
           FROM ol JOIN dp USING (products_sk) WHERE lower(status) = 'completed' GROUP BY ALL),
    lv AS (SELECT customer_sk, dc.customer_id, name, email, region, count(DISTINCT order_id) AS total_orders, round(sum(total_amount), 2) AS total_revenue,
                  min(order_date) AS first_order_date, max(order_date) AS last_order_date,
                  CASE WHEN round(sum(total_amount), 2) >= 1000000 THEN 'High' WHEN round(sum(total_amount), 2) >= 500000 THEN 'Medium' ELSE 'Low' END AS ltv_segment
           FROM oc JOIN dc USING (customer_sk) WHERE lower(status) = 'completed' GROUP BY ALL),
    fl AS (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY customer_id, modified_at ORDER BY seen DESC) = 1),
    fc AS (SELECT * FROM fl WINDOW w AS (PARTITION BY customer_id ORDER BY modified_at) QUALIFY row_number() OVER w = 1 OR priority IS DISTINCT FROM lag(priority) OVER w),
    sv AS (SELECT *, modified_at AS effective_from, coalesce(CAST(lead(modified_at) OVER w AS TIMESTAMP), TIMESTAMP '9999-12-31 23:59:59') AS effective_to,
                  lead(modified_at) OVER w IS NULL AS is_current, md5(CAST(modified_at AS VARCHAR) || '|' || customer_id) AS customer_sk
           FROM fc WINDOW w AS (PARTITION BY customer_id ORDER BY modified_at)),
    ht AS (SELECT date_trunc('hour', first_event_ts) AS event_hour, CAST(sum(page_view_count) AS BIGINT) AS page_views, count(DISTINCT customer_id) AS unique_visitors, count(*) AS total_sessions,
                  round(count(*) FILTER (add_to_cart_count > 0) / count(*), 4) AS add_to_cart_rate, round(count(*) FILTER (converted) / count(*), 4) AS purchase_rate,
                  round(avg(session_duration_secs), 1) AS avg_session_duration_secs FROM ss GROUP BY 1)
"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a query (spark, sf_dir) and its SQL, which stands behind the model's tables."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = f"WITH {MODEL.strip()}\n{sql}"
        return f

    return add


def _ntz(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _scratch(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidelake-")
    return f"{root.rstrip('/')}/engine/{uuid.uuid4().hex}"


# aggregates


@query("SELECT * FROM ds")
def daily_sales(spark, d):
    return gold.daily_sales(retail.order_lines(spark, d), retail.products(spark, d))


@query("SELECT * FROM lv")
def customer_ltv(spark, d):
    return gold.customer_ltv(retail.orders(spark, d), retail.customers(spark, d), **LTV)


@query("SELECT *, CAST(rank() OVER (PARTITION BY category ORDER BY total_revenue DESC) AS INTEGER) AS category_rank FROM ps")
def product_performance(spark, d):
    return gold.product_performance(retail.order_lines(spark, d), retail.products(spark, d))


@query("SELECT * FROM ht")
def hourly_traffic(spark, d):
    return _ntz(gold.hourly_traffic(silver.sessionize(retail.clicks(spark, d))))


@query("SELECT products_sk, category, total_revenue, CAST(rank() OVER (PARTITION BY category ORDER BY total_revenue DESC) AS INTEGER) AS category_rank FROM ps")
def rank_in_category(spark, d):
    return gold.rank_in_category(gold.product_sales(retail.order_lines(spark, d), retail.products(spark, d))).select("products_sk", "category", "total_revenue", "category_rank")


# sessions


@query("SELECT event_id, customer_id, event_ts, prev_ts, is_session_start, session_num FROM sn")
def session_boundaries(spark, d):
    return _ntz(silver.session_boundaries(retail.clicks(spark, d)).select("event_id", "customer_id", "event_ts", "prev_ts", "is_session_start", "session_num"))


@query("SELECT event_id, md5(customer_id || '_' || session_num) AS session_id FROM sn")
def session_ids(spark, d):
    return silver.session_boundaries(retail.clicks(spark, d)).select("event_id", surrogate_key(["customer_id", "session_num"], "_").alias("session_id"))


@query("SELECT * FROM ss")
def sessionize(spark, d):
    return _ntz(silver.sessionize(retail.clicks(spark, d)))


@query("SELECT * FROM ss")
def sessionize_incremental(spark, d):
    """Sessions of the first half of the month, brought up to date with the rest: the same as all at once."""
    events = retail.clicks(spark, d)
    half = F.lit("2024-01-15").cast("timestamp")
    before, after = events.where(F.col("event_ts") <= half), events.where(F.col("event_ts") > half)
    return _ntz(silver.sessions_of(silver.sessionize(before), events, after))


@query("SELECT date_trunc('hour', event_ts) AS event_hour, count(*) AS n_events FROM cl GROUP BY 1")
def hourly_bucket(spark, d):
    return _ntz(retail.clicks(spark, d).groupBy(F.date_trunc("hour", "event_ts").alias("event_hour")).agg(F.count(F.lit(1)).alias("n_events")))


@query("SELECT * FROM ss ORDER BY session_duration_secs DESC, session_id LIMIT 10")
def top_sessions(spark, d):
    return _ntz(dashboard.top(silver.sessionize(retail.clicks(spark, d)), 10))


# keys, reading, projection


@query("SELECT order_id, md5(CAST(customer_id AS VARCHAR) || '|' || order_id) AS sk, md5(CAST(order_id AS VARCHAR)) AS order_sk FROM oc", "surrogate_key")
def surrogate_keys(spark, d):
    return retail.orders(spark, d).select("order_id", surrogate_key(["customer_id", "order_id"], "|").alias("sk"), surrogate_key(["order_id"], "||").alias("order_sk"))


@query("SELECT * FROM oc QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) = 1")
def dedup_latest(spark, d):
    return incremental.dedup_latest(retail.orders(spark, d), ["customer_id"], ["order_date"])


@query("SELECT event_id, customer_id, event_ts FROM cl WHERE event_ts > TIMESTAMP '2024-01-15 00:00:00'")
def watermark_filter(spark, d):
    return _ntz(incremental.since(retail.clicks(spark, d), "event_ts", "2024-01-15 00:00:00").select("event_id", "customer_id", "event_ts"))


@query("SELECT max(event_ts) AS watermark FROM cl")
def max_watermark(spark, d):
    return _ntz(retail.clicks(spark, d).agg(F.max("event_ts").alias("watermark")))


@query("SELECT order_id, status FROM oc WHERE lower(status) = 'completed'")
def status_filter_ci(spark, d):
    return retail.orders(spark, d).where(completed(F.col("status"))).select("order_id", "status")


@query("SELECT order_id AS id, customer_id AS buyer, order_date, total_amount AS amount, status, customer_sk FROM oc")
def rename_mapping(spark, d):
    return incremental.rename(retail.orders(spark, d), {"order_id": "id", "customer_id": "buyer", "total_amount": "amount"})


@query("SELECT order_id, order_date FROM oc UNION ALL SELECT order_id, order_date FROM ol")
def union_by_name(spark, d):
    return retail.orders(spark, d).select("order_id", "order_date").unionByName(retail.order_lines(spark, d).select("order_date", "order_id"))


# affected keys


def _changed(df):
    return df.where(F.col("order_date") >= F.lit(CUT).cast("date"))


@query(f"SELECT DISTINCT order_date FROM oc WHERE order_date >= DATE '{CUT}'")
def affected_dates(spark, d):
    return incremental.affected(_changed(retail.orders(spark, d)), "order_date")


@query(f"SELECT DISTINCT customer_sk FROM oc WHERE order_date >= DATE '{CUT}'")
def affected_customers(spark, d):
    return incremental.affected(_changed(retail.orders(spark, d)), "customer_sk")


@query(f"SELECT DISTINCT category FROM ol JOIN dp USING (products_sk) WHERE order_date >= DATE '{CUT}'")
def affected_categories(spark, d):
    return gold.affected_categories(_changed(retail.order_lines(spark, d)), retail.products(spark, d))


def _early(df):
    return df.where(F.col("order_date") < F.lit(CUT).cast("date"))


@query("SELECT * FROM ds")
def daily_sales_incremental(spark, d):
    """The table as of the cut, brought up to date: the same as all at once."""
    lines, products = retail.order_lines(spark, d), retail.products(spark, d)
    target = gold.daily_sales(_early(lines), products)
    facts = lines.withColumn("_changed", F.lit(True))
    return incremental.maintain(target, facts, _changed(lines), ["order_date"], lambda x: gold.daily_sales(x, products))


@query("SELECT * FROM lv")
def customer_ltv_incremental(spark, d):
    orders, customers = retail.orders(spark, d), retail.customers(spark, d)
    target = gold.customer_ltv(_early(orders), customers, **LTV)
    return incremental.maintain(target, orders, _changed(orders), ["customer_sk"], lambda x: gold.customer_ltv(x, customers, **LTV))


@query("SELECT *, CAST(rank() OVER (PARTITION BY category ORDER BY total_revenue DESC) AS INTEGER) AS category_rank FROM ps")
def product_performance_incremental(spark, d):
    lines, products = retail.order_lines(spark, d), retail.products(spark, d)
    return gold.product_performance_incremental(gold.product_performance(_early(lines), products), lines, products, _changed(lines))


@query("SELECT * FROM ht")
def hourly_traffic_incremental(spark, d):
    sessions = silver.sessionize(retail.clicks(spark, d)).withColumn("event_hour", F.date_trunc("hour", "first_event_ts"))
    half = F.lit("2024-01-15 10:30:00").cast("timestamp")
    target = gold.hourly_traffic(sessions.where(F.col("first_event_ts") < half))
    return _ntz(incremental.maintain(target, sessions, sessions.where(F.col("first_event_ts") >= half), ["event_hour"], lambda x: gold.hourly_traffic(x.drop("event_hour"))))


# dimensions and the fact

SCD2 = {"keys": ["customer_id"], "date": "modified_at", "compare": ["priority"], "sk": "customer_sk", "newest": ["seen"]}
HISTORY = "customer_id, modified_at, priority, seen, effective_from, effective_to, is_current, customer_sk"


def _history(df):
    return _ntz(df.drop("silver_loaded_at", "silver_updated_at"))


@query(f"SELECT {HISTORY} FROM sv")
def scd2_initial(spark, d):
    return _history(silver.scd2(None, retail.feed(spark, d), **SCD2))


def _feed_parts(spark, d):
    feed, day = retail.feed(spark, d), F.lit(CUT).cast("date")
    return feed.where(F.col("modified_at") < day), feed.where(F.col("modified_at") >= day)


@query(f"SELECT {HISTORY} FROM sv")
def scd2_incremental(spark, d):
    """History of the first part, then the rest merged into it."""
    early, late = _feed_parts(spark, d)
    return _history(silver.scd2(silver.scd2(None, early, **SCD2), late, **SCD2))


@query(f"SELECT {HISTORY} FROM sv")
def scd2_late_arrival(spark, d):
    """The later part first, then the earlier one: the same history."""
    early, late = _feed_parts(spark, d)
    return _history(silver.scd2(silver.scd2(None, late, **SCD2), early, **SCD2))


_CURRENT = f"(SELECT customer_id, priority FROM fl WHERE modified_at < DATE '{CUT}' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY modified_at DESC) = 1)"


def _current(early):
    return silver.scd2(None, early, **SCD2).where("is_current").select("customer_id", "priority")


@query(f"SELECT f.customer_id, f.modified_at, f.priority, f.seen FROM fd f JOIN {_CURRENT} c USING (customer_id) WHERE f.modified_at >= DATE '{CUT}' AND f.priority IS DISTINCT FROM c.priority")
def scd2_change_detection(spark, d):
    early, late = _feed_parts(spark, d)
    return silver.changed_rows(late, _current(early), ["customer_id"], ["priority"])


@query(f"SELECT * FROM fd WHERE modified_at >= DATE '{CUT}' AND customer_id NOT IN (SELECT customer_id FROM fd WHERE modified_at < DATE '{CUT}')")
def anti_join_new(spark, d):
    early, late = _feed_parts(spark, d)
    return silver.new_rows(late, _current(early), ["customer_id"])


@query("SELECT customer_id, modified_at, priority, seen, md5(CAST(customer_id AS VARCHAR)) AS customer_sk FROM fd QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY modified_at DESC, seen DESC) = 1")
def scd1_upsert(spark, d):
    early, late = _feed_parts(spark, d)
    args = {"keys": ["customer_id"], "newest": ["modified_at", "seen"], "sk": "customer_sk"}
    return silver.scd1(silver.scd1(None, early, **args), late, **args).drop("silver_loaded_at", "silver_updated_at")


PIT = silver.DimensionJoin("customers", "customer_id", "customer_id", "version_sk", "order_date")


def _late_versions(spark, d):
    """Versions that begin at the cut, so that earlier orders find none."""
    return silver.scd2(None, _feed_parts(spark, d)[1], **SCD2).withColumnRenamed("customer_sk", "version_sk")


_LATE = f"""(SELECT customer_id AS k, modified_at AS f, coalesce(CAST(lead(modified_at) OVER w AS TIMESTAMP), TIMESTAMP '9999-12-31 23:59:59') AS t, md5(CAST(modified_at AS VARCHAR) || '|' || customer_id) AS version_sk
    FROM (SELECT * FROM fl WHERE modified_at >= DATE '{CUT}' WINDOW v AS (PARTITION BY customer_id ORDER BY modified_at) QUALIFY row_number() OVER v = 1 OR priority IS DISTINCT FROM lag(priority) OVER v)
    WINDOW w AS (PARTITION BY customer_id ORDER BY modified_at))"""


@query(f"SELECT order_id, customer_id, order_date, version_sk FROM oc LEFT JOIN {_LATE} ON customer_id = k AND order_date >= f AND order_date < t")
def pit_join(spark, d):
    return silver.lookup(retail.orders(spark, d), _late_versions(spark, d), PIT).select("order_id", "customer_id", "order_date", "version_sk")


DIM = silver.DimensionJoin("products", "product_id", "product_id", "products_sk")


@query("SELECT order_id, ol.product_id, total_amount, dp.products_sk FROM ol LEFT JOIN dp ON ol.product_id = dp.product_id")
def fact_dim_join_left(spark, d):
    return silver.lookup(retail.order_lines(spark, d).drop("products_sk"), retail.products(spark, d), DIM).select("order_id", "product_id", "total_amount", "products_sk")


@query(
    f"""SELECT o.order_id, o.product_id, o.customer_id, o.order_date, version_sk, dp.products_sk FROM
    (SELECT oc.order_id, product_id, customer_id, oc.order_date, ol.total_amount FROM ol JOIN oc USING (order_id)
     QUALIFY row_number() OVER (PARTITION BY oc.order_id, product_id ORDER BY ol.total_amount DESC) = 1) o
    LEFT JOIN {_LATE} ON o.customer_id = k AND o.order_date >= f AND o.order_date < t LEFT JOIN dp ON o.product_id = dp.product_id"""
)
def fact_star(spark, d):
    """Lines with the version of their customer and their product, one row per order and product."""
    lines = retail.order_lines(spark, d).drop("products_sk", "status").join(retail.orders(spark, d).select("order_id", "customer_id"), "order_id")
    dims = {"customers": _late_versions(spark, d), "products": retail.products(spark, d)}
    rows = silver.fact_rows(lines, dims, [PIT, DIM], ["order_id", "product_id"], ["total_amount"])
    return rows.select("order_id", "product_id", "customer_id", "order_date", "version_sk", "products_sk")


# merges: orders as of the cut are the target; all orders, with a lower amount, are the source


def _merge_sides(spark, d):
    orders = retail.orders(spark, d).select("order_id", "total_amount", "status", "order_date")
    return _early(orders), orders.withColumns({"total_amount": -F.col("total_amount"), "status": F.lit("seen")})


@query("SELECT order_id, -total_amount AS total_amount, 'seen' AS status, order_date FROM oc")
def merge_upsert_all(spark, d):
    return merge.upsert(*_merge_sides(spark, d), ["order_id"])


@query(f"SELECT order_id, -total_amount AS total_amount, CASE WHEN order_date < DATE '{CUT}' THEN status ELSE 'seen' END AS status, order_date FROM oc")
def merge_preserve_cols(spark, d):
    return merge.upsert(*_merge_sides(spark, d), ["order_id"], preserve=["status"])


@query(f"SELECT order_id, CASE WHEN order_date < DATE '{CUT}' THEN total_amount ELSE -total_amount END AS total_amount, 'seen' AS status, order_date FROM oc")
def merge_update_cols(spark, d):
    return merge.upsert(*_merge_sides(spark, d), ["order_id"], update=["status"])


@query(f"SELECT order_id, CASE WHEN order_date < DATE '{CUT}' THEN total_amount ELSE -total_amount END AS total_amount, CASE WHEN order_date < DATE '{CUT}' THEN status ELSE 'seen' END AS status, order_date FROM oc")
def merge_insert_only(spark, d):
    return merge.insert_missing(*_merge_sides(spark, d), ["order_id"])


@query(f"SELECT order_id, total_amount, CASE WHEN status = 'pending' THEN 'closed' ELSE status END AS status, order_date FROM oc WHERE order_date < DATE '{CUT}'")
def merge_update_only(spark, d):
    target, source = _merge_sides(spark, d)
    return merge.update_from(target, source, ["order_id"], {"status": F.lit("closed")}, F.col("t.status") == "pending")


@query("SELECT order_id, CASE WHEN status = 'pending' THEN 'batch' ELSE status END AS status FROM oc")
def update_where(spark, d):
    return merge.update_where(retail.orders(spark, d).select("order_id", "status"), {"status": F.lit("batch")}, F.col("status") == "pending")


@query("SELECT order_id, -total_amount AS total_amount, 'seen' AS status, order_date FROM oc")
def store_merge(spark, d):
    """The same merge through the table store: published in buckets, merged, read back."""
    target, source = _merge_sides(spark, d)
    store = TableStore(spark, _scratch(spark))
    store.publish("orders", target, ["order_id"])
    store.upsert("orders", source)
    return store.read("orders")


# messages


def _messages(spark, d):
    """Clicks as messages. Those of searches are broken: half are not JSON, half lack the customer."""
    clicks = retail.clicks(spark, d)
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("customer_id").cast("int").alias("customer_id"), "event_type", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("event_ts"), F.lit("x").alias("unknown")))
    lost = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type"))
    value = F.when(F.col("event_type") != "search", good).when(F.col("event_id") % 2 == 0, F.concat(F.lit("garbage "), F.col("event_id").cast("string"))).otherwise(lost)
    return clicks.select(
        F.lit(None).cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("clicks").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("event_ts").alias("timestamp")
    )


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(customer_id AS INTEGER) AS customer_id, event_type, event_ts, event_id AS kafka_offset FROM cl WHERE event_type <> 'search'")
def json_parse_valid(spark, d):
    return _ntz(ev.valid_rows(ev.parse(_messages(spark, d))).select("event_id", "customer_id", "event_type", "event_ts", "kafka_offset"))


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'garbage ' || event_id ELSE '{"event_id":"' || event_id || '","event_type":"search"}' END AS raw_payload, event_id AS kafka_offset FROM cl WHERE event_type = 'search'""")
def json_dead_letter(spark, d):
    return ev.dead_rows(ev.parse(_messages(spark, d))).select("raw_payload", "kafka_offset")


@query("""SELECT 'valid' AS kind, CAST(event_id AS VARCHAR) AS event_id FROM cl WHERE event_type <> 'search'
    UNION ALL SELECT 'dead', CASE WHEN event_id % 2 = 0 THEN 'garbage ' || event_id ELSE '{"event_id":"' || event_id || '","event_type":"search"}' END FROM cl WHERE event_type = 'search'""")
def json_stream_route(spark, d):
    """Messages in a folder, drained by a stream into two tables."""
    root = _scratch(spark)
    _messages(spark, d).select(F.col("value").cast("string")).write.text(f"{root}/in")
    store = TableStore(spark, f"{root}/tables")
    ingest.ingest_events(spark, store, ev.Folder(f"{root}/in"), f"{root}/state")
    dead = store.read("clickstream_dead_letter").select(F.lit("dead").alias("kind"), F.col("raw_payload").alias("event_id"))
    return store.read("clickstream_raw").select(F.lit("valid").alias("kind"), "event_id").union(dead)


@query("SELECT CAST(order_id AS INTEGER) AS order_id, CAST(customer_id AS INTEGER) AS customer_id, order_date, total_amount, status FROM oc")
def csv_stream_ingest(spark, d):
    """Two drops of CSV files, each drained by the same stream into one table."""
    root = _scratch(spark)
    store = TableStore(spark, f"{root}/tables")
    orders = retail.orders(spark, d).drop("customer_sk")
    for part in (_early(orders), _changed(orders)):
        write_csv(part, f"{root}/in", "append")
        ingest.ingest_csv(spark, store, "orders_raw", f"{root}/in", f"{root}/state")
    return store.read("orders_raw").select("order_id", "customer_id", "order_date", "total_amount", "status")


@query("SELECT count(*) AS n_rows, true AS has_lineage FROM orders")
def file_lineage(spark, d):
    df = with_lineage(spark.read.parquet(f"{d}/orders.parquet").select("*", "_metadata"))
    known = F.col("source_file_path").endswith(".parquet") & F.col("source_file_name").endswith(".parquet") & F.col("source_file_modified_at").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.every(known).alias("has_lineage"))


# dashboard


def _sales(spark, d):
    return daily_sales(spark, d)


def _range(low):
    return f"order_date BETWEEN DATE '{low}' AND DATE '{HIGH}'"


@query(f"SELECT round(sum(total_revenue), 2) AS revenue FROM ds WHERE {_range(LOW_28)}")
def dashboard_28d_revenue(spark, d):
    return dashboard.total(_sales(spark, d), "total_revenue", LOW_28, HIGH, "revenue")


@query(f"SELECT round(sum(total_revenue), 2) AS revenue FROM ds WHERE {_range(LOW_6M)}")
def dashboard_6mo_revenue(spark, d):
    return dashboard.total(_sales(spark, d), "total_revenue", LOW_6M, HIGH, "revenue")


@query(f"SELECT CAST(sum(total_orders) AS BIGINT) AS n_orders FROM ds WHERE {_range(LOW_28)}")
def dashboard_28d_orders(spark, d):
    return dashboard.total(_sales(spark, d), "total_orders", LOW_28, HIGH, "n_orders")


@query(f"SELECT product_category, round(sum(total_revenue), 2) AS revenue FROM ds WHERE {_range(LOW_28)} GROUP BY 1")
def dashboard_category_ranking(spark, d):
    return dashboard.category_ranking(_sales(spark, d), LOW_28, HIGH)


@query(f"SELECT product_category, count(*) FILTER ({_range(LOW_28)}) AS n_rows FROM ds GROUP BY 1")
def dashboard_facets(spark, d):
    return dashboard.facets(_sales(spark, d), "product_category", LOW_28, HIGH)


@query("SELECT order_date, product_category, total_revenue FROM ds")
def dashboard_timeseries(spark, d):
    return dashboard.timeseries(_sales(spark, d))


# quality rules over orders; those of cancelled ones have no customer, for a rule to find

RULES = [checks.Check("customer_id", "not_null"), checks.Check("total_amount", "positive"), checks.Check("status", "allowed", ("Completed", "pending"))]


def _tagged(spark, d, i):
    orders = retail.orders(spark, d).withColumns({"customer_id": F.when(F.col("status") != "cancelled", F.col("customer_id")), "total_amount": F.when(F.col("status") == "pending", -F.col("total_amount")).otherwise(F.col("total_amount"))})
    return checks.split(orders, [RULES[i]])


@query("SELECT order_id FROM oc WHERE status <> 'cancelled'")
def dq_not_null(spark, d):
    return _tagged(spark, d, 0)[0].select("order_id")


@query("SELECT order_id, 'positive:total_amount' AS rule FROM oc WHERE status = 'pending'")
def dq_positive(spark, d):
    return _tagged(spark, d, 1)[1].select("order_id", F.col("broken_rules")[0].alias("rule"))


@query("SELECT order_id, 'allowed:status' AS rule FROM oc WHERE status = 'cancelled'")
def dq_allowed_values(spark, d):
    return _tagged(spark, d, 2)[1].select("order_id", F.col("broken_rules")[0].alias("rule"))


# the whole pipeline


@query(
    """SELECT order_date, category AS product_category, count(DISTINCT order_id) AS total_orders, round(sum(total_amount), 2) AS total_revenue,
              (2 * CAST(sum(CAST(round(total_amount * 100) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*)) / 100 AS avg_revenue_per_order
       FROM oc JOIN (SELECT order_id, min(product_id) AS product_id FROM ol GROUP BY 1) USING (order_id) JOIN dp USING (product_id)
       WHERE lower(status) = 'completed' GROUP BY ALL"""
)
def medallion_daily_sales(spark, d):
    """CSV drops of customers, products and orders through bronze, silver and gold: orders up to the cut in a first run, all others in a second.

    The model has one product for an order, so that of its lines with the smallest number stands for the order."""
    pipe, root, orders = _landed(spark, d)
    for part in (_early(orders), _changed(orders)):
        write_csv(part, f"{root}/landing/orders", "append")
        pipe.run()
    return pipe.store.read("daily_sales_summary").drop("updated_at")


def _landed(spark, d):
    """A pipeline whose customers and products have arrived, its folder, and the orders."""
    root = _scratch(spark)
    first = retail.order_lines(spark, d).groupBy("order_id").agg(F.min("product_id").alias("product_id"))
    orders = retail.orders(spark, d).drop("customer_sk").withColumn("status", F.lower("status")).join(first, "order_id", "left").select("order_id", "customer_id", "product_id", "order_date", "total_amount", "status")
    customers = retail.customers(spark, d).select("customer_id", "name", "email", "region", F.lit("1990-01-01").cast("date").alias("signup_date"), F.lit("1990-01-01").cast("date").alias("customer_modified_at"))
    products = retail.products(spark, d).select("product_id", "product_name", "category", "price")
    pipe = Pipeline(spark, root, f"{root}/landing")
    write_csv(customers, f"{root}/landing/customers", "append")
    write_csv(products, f"{root}/landing/products", "append")
    return pipe, root, orders


@query(
    """SELECT * FROM (
    WITH one AS (SELECT oc.*, product_id FROM oc JOIN (SELECT order_id, min(product_id) AS product_id FROM ol GROUP BY 1) USING (order_id) WHERE lower(status) = 'completed'),
    cn AS (SELECT * FROM cl WHERE event_type <> 'search'),
    cs AS (SELECT *, CASE WHEN prev IS NULL OR floor(epoch(event_ts)) - floor(epoch(prev)) > 1800 THEN 1 ELSE 0 END AS s FROM (SELECT *, lag(event_ts) OVER (PARTITION BY customer_id ORDER BY event_ts, event_id) AS prev FROM cn)),
    cm AS (SELECT *, sum(s) OVER (PARTITION BY customer_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS num FROM cs),
    cg AS (SELECT customer_id, num, min(event_ts) AS first_ts, count(*) FILTER (event_type = 'page_view') AS views, bool_or(event_type = 'purchase') AS bought FROM cm GROUP BY ALL)
    SELECT 'customer_ltv' AS gold_table, md5('1990-01-01|' || customer_id) AS key, count(DISTINCT order_id) AS n, round(sum(total_amount), 2) AS amount,
           CASE WHEN round(sum(total_amount), 2) >= 1000 THEN 'High' WHEN round(sum(total_amount), 2) >= 500 THEN 'Medium' ELSE 'Low' END AS note FROM oc WHERE lower(status) = 'completed' GROUP BY customer_id
    UNION ALL SELECT 'product_performance', md5(CAST(product_id AS VARCHAR)), n, amount, CAST(rank() OVER (PARTITION BY category ORDER BY amount DESC) AS VARCHAR)
           FROM (SELECT product_id, category, count(DISTINCT order_id) AS n, round(sum(one.total_amount), 2) AS amount FROM one JOIN dp USING (product_id) GROUP BY ALL)
    UNION ALL SELECT 'hourly_traffic_metrics', strftime(date_trunc('hour', first_ts), '%Y-%m-%d %H:%M:%S'), count(*), round(count(*) FILTER (bought) / count(*), 4), CAST(CAST(sum(views) AS BIGINT) AS VARCHAR) FROM cg GROUP BY date_trunc('hour', first_ts))"""
)
def medallion_gold(spark, d):
    """The other gold tables behind the whole pipeline, clicks included, in one run."""
    pipe, root, orders = _landed(spark, d)
    write_csv(orders, f"{root}/landing/orders", "append")
    _messages(spark, d).select(F.col("value").cast("string")).write.text(f"{root}/clicks")
    pipe.run(ev.Folder(f"{root}/clicks"))
    named = lambda t, key, n, amount, note: pipe.store.read(t).select(F.lit(t).alias("gold_table"), key.alias("key"), F.col(n).cast("long").alias("n"), F.col(amount).alias("amount"), F.col(note).cast("string").alias("note"))
    hour = F.date_format("event_hour", "yyyy-MM-dd HH:mm:ss")
    return named("customer_ltv", F.col("customer_sk"), "total_orders", "total_revenue", "ltv_segment").union(named("product_performance", F.col("products_sk"), "units_sold", "total_revenue", "category_rank")).union(named("hourly_traffic_metrics", hour, "total_sessions", "purchase_rate", "page_views"))


# files, tables and state


@query("SELECT order_id, CASE WHEN order_id % 7 <> 0 THEN order_date END AS order_date, order_id % 7 = 0 OR order_id % 11 = 0 AS rescued FROM oc")
def csv_rescue(spark, d):
    """Every seventh order has no readable date, every eleventh a field too many: what fits is kept, and the raw line is too."""
    path = f"{_scratch(spark)}/in"
    day = F.when(F.col("order_id") % 7 == 0, "someday").otherwise(F.col("order_date").cast("string"))
    line = F.concat_ws(",", F.col("order_id").cast("string"), day, F.when(F.col("order_id") % 11 == 0, "more"))
    retail.orders(spark, d).select(line.alias("order_id,order_date")).write.text(path)
    schema = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("order_date", T.DateType())])
    rows = read_csv(spark, path, schema, header=False)
    return rows.select("order_id", "order_date", F.col(RESCUED).isNotNull().alias("rescued"))


@query("SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(order_date AS VARCHAR) AS order_date, status FROM oc")
def csv_all_strings(spark, d):
    path = f"{_scratch(spark)}/in"
    write_csv(retail.orders(spark, d).select("order_id", "order_date", "status"), path)
    return read_csv(spark, path)


@query("SELECT count(*) AS n_messages FROM cl")
def memory_sink(spark, d):
    """Messages of a folder, drained by a stream into a table in memory."""
    root = _scratch(spark)
    _messages(spark, d).select(F.col("value").cast("string")).write.text(f"{root}/in")
    name = f"check_{uuid.uuid4().hex}"
    report = ingest.check_source(spark, ev.Folder(f"{root}/in"), f"{root}/state", name)
    spark.catalog.dropTempView(name)
    return spark.createDataFrame([(report["in_memory"],)], "n_messages long")


@query(f"SELECT 'orders' AS source, epoch_us(CAST(max(order_date) AS TIMESTAMP)) AS first_mark, (SELECT epoch_us(CAST(max(order_date) AS TIMESTAMP)) FROM oc) AS last_mark, 0 AS after_reset FROM oc WHERE order_date < DATE '{CUT}'")
def watermark_state(spark, d):
    """Watermarks merged into a table's state, one row per source, and reset."""
    orders = retail.orders(spark, d)
    store = TableStore(spark, _scratch(spark))
    store.create("control", "source string")
    marks = []
    for part in (_early(orders), orders):
        store.put_state("control", watermark={"orders": incremental.watermark_of(part, "order_date")})
        marks.append(store.state("control")["watermark"]["orders"])
    store.put_state("control", watermark={})
    return spark.createDataFrame([("orders", *marks, len(store.state("control")["watermark"]))], "source string, first_mark long, last_mark long, after_reset int")


@query("SELECT order_id, CASE WHEN status = 'cancelled' THEN -1 ELSE customer_id END AS customer_id, CASE WHEN status = 'cancelled' THEN 'lost' WHEN total_amount > 100000 THEN 'large' ELSE status END AS status FROM oc")
def update_case_null(spark, d):
    """UPDATE with CASE, where a column is null."""
    orders = retail.orders(spark, d).select("order_id", F.when(F.col("status") != "cancelled", F.col("customer_id")).alias("customer_id"), "status", "total_amount")
    store = TableStore(spark, _scratch(spark))
    store.publish("orders", orders, ["order_id"])
    store.update_where("orders", {"status": F.when(F.col("total_amount") > 100000, "large").otherwise(F.col("status"))}, F.col("customer_id").isNotNull())
    store.update_where("orders", {"customer_id": F.lit(-1), "status": F.lit("lost")}, F.col("customer_id").isNull())
    return store.read("orders").drop("total_amount")


@query("SELECT count(*) AS before, 0 AS after, true AS is_there FROM oc")
def delete_all(spark, d):
    store = TableStore(spark, _scratch(spark))
    store.publish("orders", retail.orders(spark, d), ["order_id"])
    before = store.read("orders").count()
    store.clear("orders")
    return spark.createDataFrame([(before, store.read("orders").count(), store.exists("orders"))], "before long, after int, is_there boolean")


@query("SELECT order_id, status, CASE WHEN status = 'pending' THEN 'nobody' ELSE 'shop' END AS owner, 1 AS revision FROM oc")
def insert_defaults(spark, d):
    """A table made by DDL; rows that lack a column, or have it as null, get its default."""
    store = TableStore(spark, _scratch(spark))
    store.create("orders", "order_id long, status string, owner string, revision int", ["order_id"])
    rows = retail.orders(spark, d).select("order_id", "status", F.when(F.col("status") != "pending", "shop").alias("owner"))
    store.insert("orders", rows, {"owner": F.lit("nobody"), "revision": F.lit(1)})
    return store.read("orders")


@query("SELECT * FROM oc ORDER BY order_id LIMIT 20")
def table_preview(spark, d):
    store = TableStore(spark, _scratch(spark))
    store.publish("orders", retail.orders(spark, d), ["order_id"])
    return store.preview("orders")


STAMP = "2024-02-03 04:05:06"


@query(f"SELECT product_id, md5(CAST(product_id AS VARCHAR)) AS products_sk, TIMESTAMP '{STAMP}' AS silver_loaded_at, TIMESTAMP '2024-03-03 04:05:06' AS silver_updated_at FROM dp")
def audit_columns(spark, d):
    """Audit times of a dimension that is loaded twice: the first load's stays."""
    products = retail.products(spark, d).drop("products_sk")
    args = {"keys": ["product_id"], "newest": ["price"], "sk": "products_sk"}
    stamps = [datetime.fromisoformat(f"2024-0{m}-03T04:05:06+00:00") for m in (2, 3)]
    twice = silver.scd1(silver.scd1(None, products, run_ts=stamps[0], **args), products, run_ts=stamps[1], **args)
    return _ntz(twice.select("product_id", "products_sk", "silver_loaded_at", "silver_updated_at"))


@query("SELECT order_id, order_date FROM oc ORDER BY order_date DESC, order_id DESC LIMIT 1")
def newest_order(spark, d):
    return retail.orders(spark, d).orderBy(F.col("order_date").desc(), F.col("order_id").desc()).select("order_id", "order_date").limit(1)


# the registry


@query("SELECT * FROM (VALUES ('dim_customers', 1, ''), ('dim_products', 2, ''), ('orders_clean', 3, 'dim_customers,dim_products')) t(name, run_order, depends)")
def registry_order(spark, d):
    """Active tables of the batch pipeline in the order in which they run."""
    rows = [(t.name, t.order, ",".join(t.depends)) for t in sorted(SILVER, key=lambda t: t.order) if t.active and t.pipeline == "batch"]
    return spark.createDataFrame(rows, "name string, run_order int, depends string")


@query("SELECT 'orders_clean' AS name, 'skipped: waits for dim_customers, dim_products' AS outcome, 1 AS dropped, 0 AS left_over")
def gate_and_reset(spark, d):
    """A fact whose dimensions are not there waits; reset then drops what there is."""
    pipe, root, orders = _landed(spark, d)
    write_csv(orders, f"{root}/landing/orders", "append")
    pipe = Pipeline(spark, root, f"{root}/landing", [t for t in BRONZE if t.name == "orders_raw"], [t for t in SILVER if t.name == "orders_clean"], [])
    pipe.run_bronze()
    ((name, outcome),) = pipe.run_silver().items()
    return spark.createDataFrame([(name, outcome, len(reset(pipe, confirm=True)), len(pipe.store.list()))], "name string, outcome string, dropped int, left_over int")


# generators: what holds for every seed


@query("SELECT 2000 AS n_rows, 2000 AS n_keys, true AS emails_differ, true AS known_values")
def generated_customers(spark, d):
    known = F.col("region").isin(generators.REGIONS) & F.col("signup_date").between(F.lit("2020-01-01").cast("date"), F.lit("2026-01-31").cast("date"))
    return generators.customers(spark, 2000).agg(F.count(F.lit(1)).cast("int").alias("n_rows"), F.count_distinct("customer_id").cast("int").alias("n_keys"), (F.count_distinct("email") == 2000).alias("emails_differ"), F.every(known).alias("known_values"))


@query("SELECT 500 AS n_rows, 100 AS n_changed, true AS in_range")
def generated_products(spark, d):
    """Products, and a hundred of them with a new price or category."""
    made = generators.products(spark, 500)
    after = generators.changed_products(made, 100).select("product_id", F.col("price").alias("new_price"), F.col("category").alias("new_category"))
    in_range = F.col("new_price").isNull() | F.col("new_price").between(0.79 * F.col("price"), 1.31 * F.col("price"))
    return made.join(after, "product_id", "left").agg(F.count(F.lit(1)).cast("int").alias("n_rows"), F.count("new_price").cast("int").alias("n_changed"), F.every(in_range).alias("in_range"))


@query("SELECT 3000 AS n_rows, 3001 AS next_number, true AS in_range, 200 AS n_moved, true AS moves_allowed")
def generated_orders(spark, d):
    """Orders, and two hundred of them in their next state."""
    made = generators.orders(spark, 3000)
    moved = generators.order_transitions(made, 200).select("order_id", F.col("status").alias("then"))
    allowed = F.col("then").isNull() | F.concat_ws(">", "status", "then").isin("pending>completed", "pending>cancelled", "completed>refunded")
    checked = made.join(moved, "order_id", "left").agg(F.count(F.lit(1)).cast("int").alias("n_rows"), F.every(F.col("total_amount").between(5, 2000)).alias("in_range"), F.count("then").cast("int").alias("n_moved"), F.every(allowed).alias("moves_allowed"))
    return checked.withColumn("next_number", F.lit(generators.next_number(made, "order_id")).cast("int"))


@query("SELECT 400 AS n_sessions, true AS lengths, true AS purchases_have_carts, true AS products_known")
def generated_clicks(spark, d):
    """Sessions of 3 to 15 events, in which a purchase follows a cart."""
    clicks = generators.click_events(spark, 400)
    cart = F.min(F.when(F.col("event_type") == "add_to_cart", F.col("event_ts")))
    sold = F.min(F.when(F.col("event_type") == "purchase", F.col("event_ts")))
    sessions = clicks.groupBy("session_id").agg(F.count(F.lit(1)).alias("k"), cart.alias("cart"), sold.alias("sold"), F.every((F.col("event_type") == "search") == F.col("product_id").isNull()).alias("known"))
    return sessions.agg(F.count(F.lit(1)).cast("int").alias("n_sessions"), F.every(F.col("k").between(3, 15)).alias("lengths"), F.every(F.col("sold").isNull() | F.coalesce(F.col("cart") < F.col("sold"), F.lit(False))).alias("purchases_have_carts"), F.every("known").alias("products_known"))


@query("SELECT status, count(*) AS n_rows, count(DISTINCT customer_id) AS n_keys, round(count(*) / (SELECT count(*) FROM oc), 4) AS share FROM oc GROUP BY 1")
def status_summary(spark, d):
    return generators.summary(retail.orders(spark, d), "customer_id", "status")


@query("SELECT customer_id, min(order_id) AS order_id FROM oc GROUP BY 1")
def first_of_key(spark, d):
    return generators.first_of_key(retail.orders(spark, d).select("customer_id", "order_id"), "customer_id")
