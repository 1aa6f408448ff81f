"""Seeded generators of customers, products, orders and click events. Every value is a function of the seed and the row's number, so a run can be
repeated, and rows are made in parallel."""

from __future__ import annotations

import argparse
import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values to draw from. Categories have price ranges, states the share up to and with them.
REGIONS = ["Coast", "Highlands", "Islands", "Lakes", "Plains", "Valley"]
CATEGORIES = {"Lighting": (12, 640), "Cycling": (9, 2100), "Stationery": (1, 45), "Gardening": (4, 310), "Tableware": (6, 190), "Audio": (25, 980), "Camping": (8, 720), "Pet care": (3, 85), "Knitwear": (18, 240), "Board games": (11, 95), "Bakery": (2, 28)}
NOUNS = ["Lamp", "Kettle", "Jacket", "Novel", "Racket", "Cream", "Puzzle", "Granola", "Speaker", "Blanket", "Monitor", "Sandals"]
VARIANTS = ["", " No. 2", " in blue", " for two", " (set)", " with lid"]
FIRST = ["Ada", "Ben", "Caro", "Dev", "Elif", "Finn", "Gia", "Hugo", "Iris", "Jon", "Kim", "Lena"]
LAST = ["Adler", "Baker", "Costa", "Dietz", "Evans", "Fuchs", "Greco", "Hansen", "Ito", "Jensen", "Kaya", "Lopez"]
STATUS = [("completed", 0.6), ("pending", 0.8), ("cancelled", 0.9), ("refunded", 1.0)]


def _u(seed: int, salt: str) -> Column:
    """A number in [0, 1) for each row's n."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "n"), F.lit(1 << 52)) / float(1 << 52)


def _pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def _normal(seed: int, salt: str) -> Column:
    return F.sqrt(-2 * F.log(1 - _u(seed, salt + "r"))) * F.cos(6.283185307179586 * _u(seed, salt + "a"))


def customers(spark: SparkSession, n: int = 10_000, first: int = 1, seed: int = 42, start: str = "2020-01-01", days: int = 2222) -> DataFrame:
    df = spark.range(first, first + n).toDF("n")
    first_name, last = _pick(FIRST, _u(seed, "f")), _pick(LAST, _u(seed, "l"))
    signup = F.date_add(F.lit(start).cast("date"), F.floor(_u(seed, "d") * days).cast("int"))
    return df.select(
        F.format_string("CUST-%06d", "n").alias("customer_id"),
        F.concat_ws(" ", first_name, last).alias("name"),
        F.concat(F.lower(first_name), F.lit("."), F.lower(last), F.substring(F.md5(F.col("n").cast("string")), 1, 6), F.lit("@mail.test")).alias("email"),
        _pick(REGIONS, _u(seed, "r")).alias("region"),
        signup.alias("signup_date"),
        signup.alias("customer_modified_at"),
    )


def changed_customers(existing: DataFrame, n: int, day: str, seed: int = 43) -> DataFrame:
    """n customers with a new email, region or both, as of a day; drawn without replacement."""
    drawn = sample(existing, n, "customer_id", seed).withColumn("n", F.xxhash64("customer_id"))
    kind = F.floor(_u(seed, "k") * 3)
    email = F.concat(F.lit("new"), F.substring(F.md5(F.concat("customer_id", F.lit(day))), 1, 8), F.lit("@mail.test"))
    return drawn.withColumns({"email": F.when(kind != 1, email).otherwise(F.col("email")), "region": F.when(kind != 0, _pick(REGIONS, _u(seed, "r"))).otherwise(F.col("region")), "customer_modified_at": F.lit(day).cast("date")}).drop("n")


def products(spark: SparkSession, n: int = 1000, first: int = 1, seed: int = 42) -> DataFrame:
    df = spark.range(first, first + n).toDF("n").withColumn("category", _pick(list(CATEGORIES), _u(seed, "c")))
    low = F.coalesce(*[F.when(F.col("category") == c, F.lit(float(a))) for c, (a, _) in CATEGORIES.items()])
    high = F.coalesce(*[F.when(F.col("category") == c, F.lit(float(b))) for c, (_, b) in CATEGORIES.items()])
    name = F.concat(_pick(NOUNS, _u(seed, "n")), _pick(VARIANTS, _u(seed, "v")))
    return df.select(F.format_string("PROD-%06d", "n").alias("product_id"), name.alias("product_name"), "category", F.round(low + _u(seed, "p") * (high - low), 2).alias("price"))


def changed_products(existing: DataFrame, n: int, seed: int = 43) -> DataFrame:
    """Three quarters get a new price within 80 to 130 percent, the others a new category."""
    drawn = sample(existing, n, "product_id", seed).withColumn("n", F.xxhash64("product_id"))
    price = F.round(F.col("price") * (0.8 + 0.5 * _u(seed, "p")), 2)
    return drawn.withColumns({"price": price, "category": F.when(_u(seed, "k") < 0.75, F.col("category")).otherwise(_pick(list(CATEGORIES), _u(seed, "c")))}).drop("n")


def orders(spark: SparkSession, n: int = 100_000, n_customers: int = 10_000, n_products: int = 1000, first: int = 1, seed: int = 42, start: str = "2022-01-01", days: int = 1491, status=STATUS) -> DataFrame:
    """Amounts are log-normal, from 5 to 2000."""
    df, u = spark.range(first, first + n).toDF("n"), _u(seed, "s")
    state = F.coalesce(*[F.when(u < p, F.lit(s)) for s, p in status])
    amount = F.least(F.lit(2000.0), F.greatest(F.lit(5.0), F.exp(3.5 + _normal(seed, "a"))))
    return df.select(
        F.format_string("ORD-%07d", "n").alias("order_id"),
        F.format_string("CUST-%06d", (F.floor(_u(seed, "c") * n_customers) + 1)).alias("customer_id"),
        F.format_string("PROD-%06d", (F.floor(_u(seed, "p") * n_products) + 1)).alias("product_id"),
        F.date_add(F.lit(start).cast("date"), F.floor(_u(seed, "d") * days).cast("int")).alias("order_date"),
        F.round(amount, 2).alias("total_amount"),
        state.alias("status"),
    )


def order_transitions(latest: DataFrame, n: int, seed: int = 43) -> DataFrame:
    """n pending or completed orders in their next state: pending ones are completed (0.7) or cancelled, completed ones refunded. latest: one row per order."""
    drawn = sample(latest.where(F.col("status").isin("pending", "completed")), n, "order_id", seed).withColumn("n", F.xxhash64("order_id"))
    after = F.when(F.col("status") == "completed", "refunded").when(_u(seed, "t") < 0.7, "completed").otherwise("cancelled")
    return drawn.withColumn("status", after).drop("n")


def sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement, the same in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def next_number(df: DataFrame, key: str) -> int:
    """The number after the largest in ids like ABC-000123."""
    top = df.agg(F.max(F.split_part(F.col(key), F.lit("-"), F.lit(-1)).cast("long")).alias("m")).first().m
    return (top or 0) + 1


#: What a visitor does next, by what went before: the kinds with the share up to and with them, and the state that each leads to.
JOURNEY = {
    "fresh": [("page_view", 0.7, "looking"), ("search", 1.0, "fresh")],
    "looking": [("page_view", 0.5, "looking"), ("search", 0.7, "fresh"), ("add_to_cart", 1.0, "cart")],
    "cart": [("page_view", 0.3, "cart"), ("search", 0.4, "cart"), ("add_to_cart", 0.6, "cart"), ("purchase", 1.0, "fresh")],
}


def _journey(steps: str, draw: str) -> Column:
    """The kinds of a session's events, drawn one after the other; draw: a number in [0, 1) for step i."""
    arms = " ".join(f"WHEN a.state = '{state}' AND u < {upto} THEN named_struct('kind', '{kind}', 'state', '{then}')" for state, moves in JOURNEY.items() for kind, upto, then in moves)
    step = f"get(transform(array({draw}), u -> CASE {arms} END), 0)"
    return F.expr(f"aggregate({steps}, named_struct('state', 'fresh', 'kinds', cast(array() AS array<string>)), (a, i) -> get(transform(array({step}), m -> named_struct('state', m.state, 'kinds', concat(a.kinds, array(m.kind)))), 0), a -> a.kinds)")


def click_events(spark: SparkSession, n_sessions: int = 1000, n_customers: int = 100, n_products: int = 1000, seed: int = 42, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """Sessions of 3 to 15 events. What follows depends on what went before (JOURNEY): only a cart leads to a purchase. Times lie within a session's half hour."""
    s = spark.range(n_sessions).toDF("n")
    s = s.select(
        "n",
        (F.floor(_u(seed, "c") * n_customers) + 1).cast("int").alias("customer_id"),
        (F.lit(start).cast("timestamp").cast("long") + F.floor(_u(seed, "t") * 30 * 86400)).alias("begin"),
        (F.floor(_u(seed, "k") * 13) + 3).cast("int").alias("k"),
        F.md5(F.concat_ws("-", F.lit(seed), "n")).alias("session_id"),
    )
    kinds = _journey("sequence(1, k)", f"pmod(xxhash64({seed}, 'e', n, i), {1 << 52}L) / {float(1 << 52)}D")
    e = s.select("*", F.posexplode(kinds).alias("at", "event_type")).withColumn("i", F.col("at") + 1).withColumn("n", F.col("n") * 100 + F.col("i"))
    product = F.when(F.col("event_type") != "search", (F.floor(_u(seed, "p") * n_products) + 1).cast("int"))
    return e.select(
        F.md5(F.concat_ws("/", "session_id", "i")).alias("event_id"),
        "customer_id",
        product.alias("product_id"),
        "event_type",
        "session_id",
        F.concat(F.lit("/"), "event_type").alias("page"),
        F.date_format(F.timestamp_seconds(F.col("begin") + F.col("i") * 60 + F.floor(_u(seed, "j") * 50)), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("event_ts"),
    )


class Pace:
    """Holds a producer to a rate: wait(n) returns when n more events may be sent. Waits vary by `jitter` of themselves, by the seed."""

    def __init__(self, per_second: float = 1.0, jitter: float = 0.2, seed: int = 42, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.jitter, self.draw, self.clock, self.sleep = 1 / per_second, jitter, random.Random(seed), clock, sleep
        self.due = clock()

    def wait(self, n: int = 1) -> None:
        self.due = max(self.due, self.clock()) if n else self.due
        if (rest := self.due - self.clock()) > 0:
            self.sleep(rest)
        self.due += n * self.gap * (1 + self.jitter * (2 * self.draw.random() - 1))


def send(events: DataFrame, write: Callable[[DataFrame], None], batches: int, pace: Pace, key: str = "session_id") -> int:
    """Writes the events in batches, no faster than the pace: sessions stay together. The number of events sent."""
    dealt, sent = events.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches))), 0
    for i in range(batches):
        part = dealt.where(F.col("_batch") == i).drop("_batch")
        n = part.count()
        if n:
            pace.wait(n)
            write(part)
            sent += n
    return sent


def first_of_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by all other columns, so a repeated draw of a number does no harm."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def summary(df: DataFrame, key: str, by: str) -> DataFrame:
    """Per value of a column its rows, distinct keys and share of all rows."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
    return counted.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 4))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def main() -> None:
    from tidelake.session import build_session
    from tidelake.sources.files import write_csv

    parser = argparse.ArgumentParser(description="Writes a generated table as CSV.")
    parser.add_argument("table", choices=["customers", "products", "orders"])
    parser.add_argument("path")
    parser.add_argument("--rows", type=int, default=1000)
    parser.add_argument("--first", type=int, default=1)
    parser.add_argument("--seed", type=int, default=42)
    args = parser.parse_args()
    spark = build_session("generate")
    write_csv(globals()[args.table](spark, args.rows, first=args.first, seed=args.seed), args.path, "append")


if __name__ == "__main__":
    main()
