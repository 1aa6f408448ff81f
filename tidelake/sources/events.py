"""Message sources: a broker where its connector is there, or a folder of JSON lines with the same envelope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the JSON of an event holds. Absent or mistyped fields are null, unknown ones are dropped.
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("customer_id", T.IntegerType()),
        T.StructField("product_id", T.IntegerType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("event_ts", T.StringType()),
    ]
)

ENVELOPE = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


@dataclass(frozen=True)
class Broker:
    """servers and topic, and whatever else the connector takes (security, limits)."""

    servers: str
    topic: str
    options: dict = field(default_factory=dict)

    def read_options(self, starting: str = "earliest", ending: str | None = None) -> dict[str, str]:
        """starting, ending: earliest, latest or offsets by partition as JSON; a stream has no end."""
        own = {"kafka.bootstrap.servers": self.servers, "subscribe": self.topic, "startingOffsets": starting}
        return own | ({"endingOffsets": ending} if ending else {}) | {k: str(v) for k, v in self.options.items()}

    def write_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic} | {k: str(v) for k, v in self.options.items()}

    def stream(self, spark: SparkSession, starting: str = "earliest") -> DataFrame:
        return spark.readStream.format("kafka").options(**self.read_options(starting)).load()

    def batch(self, spark: SparkSession, starting: str = "earliest", ending: str = "latest") -> DataFrame:
        return spark.read.format("kafka").options(**self.read_options(starting, ending)).load()

    def write(self, events: DataFrame, key: str = "customer_id") -> None:
        """A message that the broker does not take fails its task, and in the end the write: there is no report by message."""
        to_messages(events, key).write.format("kafka").options(**self.write_options()).save()


@dataclass(frozen=True)
class Folder:
    """Files of lines; each line is a message's value. The offset is a hash of the file and the line, the time that of the file."""

    path: str
    topic: str = "folder"

    def _envelope(self, lines: DataFrame) -> DataFrame:
        return lines.select(
            F.lit(None).cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.lit(self.topic).alias("topic"),
            F.lit(0).alias("partition"),
            F.xxhash64(F.col("_metadata.file_path"), "value").alias("offset"),
            F.col("_metadata.file_modification_time").alias("timestamp"),
        )

    def stream(self, spark: SparkSession, starting: str = "earliest") -> DataFrame:
        return self._envelope(spark.readStream.format("text").load(self.path).select("value", "_metadata"))

    def batch(self, spark: SparkSession) -> DataFrame:
        return self._envelope(spark.read.text(self.path).select("value", "_metadata"))

    def write(self, events: DataFrame, key: str = "customer_id") -> None:
        to_messages(events, key).select(F.col("value").cast("string")).write.mode("append").text(self.path)


def to_messages(events: DataFrame, key: str = "customer_id") -> DataFrame:
    """(key, value): the JSON of each event, keyed so that a customer's events keep their order."""
    return events.select(F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*events.columns)).cast("binary").alias("value"))


#: What a message must have to be an event.
REQUIRED = ("event_id", "customer_id")
#: The raw event's columns: its name here, and the expression over the JSON `j` and the envelope.
RAW_EVENT = {
    **{c: f"j.{c}" for c in ("event_id", "customer_id", "product_id", "event_type", "session_id", "page")},
    "event_ts": "try_to_timestamp(j.event_ts)",
    "kafka_offset": "offset",
    "kafka_partition": "partition",
}
#: The dead letter's columns.
DEAD_LETTER = {"raw_payload": "text", "kafka_offset": "offset", "kafka_partition": "partition", "kafka_timestamp": "timestamp"}


def parse(envelope: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """The envelope with its text, the JSON j (null where it can't be read), and ok: whether all required fields are there. ok is never null."""
    read = envelope.select("*", F.col("value").cast("string").alias("text"))
    read = read.select("*", F.from_json("text", schema).alias("j"))
    return read.select("*", F.expr(" AND ".join(f"j.{c} IS NOT NULL" for c in REQUIRED)).alias("ok"))


def _laid_out(rows: DataFrame, columns: dict[str, str], run_ts) -> DataFrame:
    stamp = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    return rows.select(*[F.expr(e).alias(c) for c, e in columns.items()], stamp.alias("ingested_at"))


def valid_rows(parsed: DataFrame, run_ts=None) -> DataFrame:
    """Valid messages as raw events with their place in the log. A time that can't be read is null."""
    return _laid_out(parsed.where("ok"), RAW_EVENT, run_ts)


def dead_rows(parsed: DataFrame, run_ts=None, reason: str = "missing event_id or customer_id, or not JSON") -> DataFrame:
    """All other messages, raw, with the broker's time and a reason."""
    return _laid_out(parsed.where("NOT ok"), DEAD_LETTER, run_ts).withColumn("failure_reason", F.lit(reason))
