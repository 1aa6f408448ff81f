"""Operators on small literal rows: the cases that the golden tables of FIXTURES.md name, and invariants."""

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake.functions.columns import exact_average, ltv_segment, surrogate_key
from tidelake.operators import checks, gold, incremental, merge, silver


def ts(text):
    return datetime.fromisoformat(f"2024-01-01 {text}")


def events(spark, times, customer=1042):
    rows = [(str(i), customer, "page_view", t) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "event_id string, customer_id int, event_type string, event_ts timestamp")


@pytest.mark.parametrize(
    "times, flags",
    [
        (["10:00:00", "10:05:00", "10:20:00", "10:52:00"], [1, 0, 0, 1]),
        (["10:00:00", "10:30:00", "11:00:01"], [1, 0, 1]),
        (["10:00:00.100000", "10:30:00.900000"], [1, 0]),
    ],
)
def test_session_starts(spark, times, flags):
    out = silver.session_boundaries(events(spark, [ts(t) for t in times])).orderBy("event_ts").collect()
    assert [r.is_session_start for r in out] == flags


def test_session_id_and_null_times(spark):
    df = events(spark, [ts("10:00:00"), None])
    (row,) = silver.sessionize(df).collect()
    assert (row.session_id, row.event_count, row.session_duration_secs, row.converted) == ("20206f6c5c7b895db37fa5a2a0e9029a", 1, 0, False)


def test_ltv_segments(spark):
    df = spark.createDataFrame([(1000.0,), (999.99,), (500.0,), (499.99,), (None,)], "x double")
    assert [r[0] for r in df.select(ltv_segment(F.col("x"))).collect()] == ["High", "Medium", "Medium", "Low", "Low"]


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("a", 5.0)], "category string, total_revenue double")
    assert sorted(r.category_rank for r in gold.rank_in_category(df).collect()) == [1, 1, 3]


def test_exact_average_rounds_half_up(spark):
    df = spark.createDataFrame([(1.0,), (1.01,), (None,)], "x double")
    assert df.select(exact_average(F.col("x"))).first()[0] == 1.01
    assert df.where("x IS NULL").select(exact_average(F.col("x"))).first()[0] is None


def test_surrogate_key_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(surrogate_key(["x", "y"], "|") == F.md5(F.lit("a"))).first()[0]


ARGS = {"keys": ["id"], "date": "day", "compare": ["email", "region"], "sk": "sk", "newest": ["seen"]}
SCHEMA = "id int, day date, email string, region string, name string, seen int"


def d(n):
    return date(2024, 1, n)


def history(df):
    return sorted((r.id, r.effective_from, r.effective_to.date() if r.effective_to else None, r.is_current, r.email, r.region) for r in df.collect())


def check_history(df):
    rows = df.collect()
    assert len({r.sk for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    for versions in by.values():
        versions.sort(key=lambda r: r.effective_from)
        assert [v.is_current for v in versions] == [False] * (len(versions) - 1) + [True]
        for a, b in zip(versions, versions[1:], strict=False):
            assert a.effective_to.date() == b.effective_from


def test_scd2_cases(spark):
    first = silver.scd2(None, spark.createDataFrame([(1, d(1), "a", "x", "n", 1), (2, d(1), "b", None, "n", 1)], SCHEMA), **ARGS)

    def then(*rows):
        out = silver.scd2(first, spark.createDataFrame(list(rows), SCHEMA), **ARGS)
        check_history(out)
        return [(r[0], r[1].day, r[3], r[4], r[5]) for r in history(out)]

    same = [(1, 1, True, "a", "x"), (2, 1, True, "b", None)]
    assert then((1, d(5), "a2", "x", "n", 2)) == [(1, 1, False, "a", "x"), (1, 5, True, "a2", "x"), same[1]]
    assert then((1, d(5), "a", "x", "n", 2)) == same  # nothing new
    assert then((1, d(5), "a", "x", "other", 2)) == same  # the name is not tracked
    assert then((2, d(5), "b", "y", "n", 2)) == [same[0], (2, 1, False, "b", None), (2, 5, True, "b", "y")]  # from null
    assert then((1, d(5), "a", None, "n", 2))[1] == (1, 5, True, "a", None)  # to null
    assert then((1, d(1), "a2", "x", "n", 2)) == [(1, 1, True, "a2", "x"), same[1]]  # on the same day
    assert then((3, d(5), "c", "z", "n", 2))[2] == (3, 5, True, "c", "z")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 9), st.sampled_from(["a", "b", None])), min_size=1, max_size=12), st.integers(0, 12))
def test_scd2_in_parts_is_scd2_at_once(spark, rows, cut):
    rows = [(i, d(day), e, "x", "n", k) for k, (i, day, e) in enumerate(rows)]
    at_once = silver.scd2(None, spark.createDataFrame(rows, SCHEMA), **ARGS, collapse=False)
    target = None
    for part in (rows[:cut], rows[cut:]):
        if part:
            target = silver.scd2(target, spark.createDataFrame(part, SCHEMA), **ARGS, collapse=False)
    assert history(target) == history(at_once)
    check_history(target)


def test_point_in_time_lookup(spark):
    dim = silver.scd2(None, spark.createDataFrame([(1, d(3), "a", "x", "n", 1), (1, d(5), "b", "x", "n", 2)], SCHEMA), **ARGS)
    facts = spark.createDataFrame([(10, 1, d(2)), (11, 1, d(3)), (12, 1, d(5)), (13, None, d(5))], "order_id int, id int, order_date date")
    spec = silver.DimensionJoin("c", "id", "id", "sk", "order_date")
    found = {r.order_id: r.sk for r in silver.lookup(facts.withColumnRenamed("id", "fid"), dim, silver.DimensionJoin("c", "fid", "id", "sk", "order_date")).collect()}
    by_day = {r.effective_from: r.sk for r in dim.collect()}
    assert spec.how == "left" and found == {10: None, 11: by_day[d(3)], 12: by_day[d(5)], 13: None}


def test_dedup_ties_do_not_depend_on_order(spark):
    rows = [("k", 1, "a"), ("k", 1, "b"), ("k", 0, "c")]
    for part in (rows, rows[::-1]):
        out = incremental.dedup_latest(spark.createDataFrame(part, "k string, t int, v string").repartition(3), ["k"], ["t"]).collect()
        assert [tuple(r) for r in out] == [("k", 1, "b")]


def test_refund_removes_the_group(spark):
    schema = "order_id int, products_sk string, order_date date, total_amount double, status string"
    before = spark.createDataFrame([(1, "p", d(1), 5.0, "completed"), (2, "p", d(2), 7.0, "completed")], schema)
    after = spark.createDataFrame([(1, "p", d(1), 5.0, "refunded"), (2, "p", d(2), 7.0, "completed")], schema)
    products = spark.createDataFrame([("p", None)], "products_sk string, category string")
    target = gold.daily_sales(before, products)
    out = incremental.maintain(target, after, after.where("order_id = 1"), ["order_date"], lambda x: gold.daily_sales(x, products)).collect()
    assert [(r.order_date, r.total_orders, r.product_category) for r in out] == [(d(2), 1, None)]


def test_merge_variants(spark):
    t = spark.createDataFrame([(1, "a", 10), (None, "n", 20)], "k int, v string, w int")
    s = spark.createDataFrame([(1, "b", 11), (None, "m", 21), (3, "c", 31)], "k int, v string, w int")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(merge.upsert(t, s, ["k"])) == [(1, "b", 11), (3, "c", 31), (None, "m", 21)]
    assert rows(merge.upsert(t, s, ["k"], preserve=["w"])) == [(1, "b", 10), (3, "c", 31), (None, "m", 20)]
    assert rows(merge.upsert(t, s, ["k"], update=["w"])) == [(1, "a", 11), (3, "c", 31), (None, "n", 21)]
    assert rows(merge.insert_missing(t, s, ["k"])) == [(1, "a", 10), (3, "c", 31), (None, "n", 20)]
    assert rows(merge.update_from(t, s, ["k"], {"v": F.col("s.v")}, F.col("t.w") > 15)) == [(1, "a", 10), (None, "m", 20)]
    with pytest.raises(merge.MergeError):
        merge.check_cardinality(t, s.union(s), ["k"])
    merge.check_cardinality(t, s.where("k = 3").union(s.where("k = 3")), ["k"])  # no target row


def test_checks(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (None, -1.0, "z"), (3, None, None)], "k int, x double, s string")
    rules = [checks.Check("k", "not_null"), checks.Check("x", "positive", most_bad=0.5), checks.Check("s", "allowed", ("a",)), checks.Check("", "sql", condition="k < 3")]
    good, bad = checks.split(df, rules)
    assert [r.k for r in good.collect()] == [1]
    assert {r.k: sorted(r.broken_rules) for r in bad.collect()} == {None: ["allowed:s", "not_null:k", "positive:x", "sql:"], 3: ["allowed:s", "positive:x", "sql:"]}
    assert checks.breaches(df, rules) == ["positive:x"]


def test_watermarks(spark):
    df = spark.createDataFrame([(ts("10:00:00"),), (ts("11:00:00"),)], "t timestamp")
    assert incremental.since(df, "t", ts("10:00:00")).count() == 1
    assert incremental.since(df, "t", None).count() == 2
    assert incremental.watermark_of(df.limit(0), "t") is None
