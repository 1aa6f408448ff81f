"""Bronze ingestion by streams that drain what is there and stop. Batches carry their number into the commit, so a replay adds nothing."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelake.sources import events as ev
from tidelake.sources import files
from tidelake.storage.table_store import TableStore


def _report(query: StreamingQuery) -> dict:
    query.awaitTermination()
    last = query.lastProgress
    return {"batches": last["batchId"] + 1 if last else 0, "rows": sum(p["numInputRows"] for p in query.recentProgress)}


def ingest_csv(spark: SparkSession, store: TableStore, table: str, path: str, state_path: str) -> dict:
    """New files of a folder, appended to a table with lineage; schema and checkpoint are kept under state_path."""
    schema = files.kept_schema(spark, path, f"{state_path}/{table}/schema")

    def add(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.append(table, files.with_lineage(batch), batch=f"{table}:{batch_id}")

    stream = files.stream_csv(spark, path, schema).writeStream.foreachBatch(add)
    return _report(stream.option("checkpointLocation", f"{state_path}/{table}/checkpoint").trigger(availableNow=True).start())


def ingest_events(spark: SparkSession, store: TableStore, source: ev.Broker | ev.Folder, state_path: str, table: str = "clickstream_raw", dead_table: str = "clickstream_dead_letter") -> dict:
    """Messages parsed once; valid ones go to one table, all others to the dead-letter table."""

    def route(batch: DataFrame, batch_id: int) -> None:
        parsed = ev.parse(batch).persist()
        try:
            for name, rows in ((table, ev.valid_rows(parsed)), (dead_table, ev.dead_rows(parsed))):
                if not rows.isEmpty():
                    store.append(name, rows, batch=f"{name}:{batch_id}")
        finally:
            parsed.unpersist()

    stream = source.stream(spark).writeStream.foreachBatch(route)
    return _report(stream.option("checkpointLocation", f"{state_path}/{table}/checkpoint").trigger(availableNow=True).start())


def check_source(spark: SparkSession, source: ev.Broker | ev.Folder, state_path: str, name: str = "source_check") -> dict:
    """Whether a source can be read: its schema, and how many messages a drained stream puts in a table in memory, the view `name`.

    The stream writes files under state_path and the view is cached from them, in the executors' memory and beyond it on their disks: Spark's own memory sink
    collects every message on the driver. Dropping the view frees the memory."""
    messages, path = source.stream(spark), f"{state_path}/{name}_messages"
    query = messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{state_path}/{name}").trigger(availableNow=True).start()
    report = _report(query)
    spark.catalog.dropTempView(name)
    spark.read.schema(messages.schema).parquet(path).createOrReplaceTempView(name)
    spark.catalog.cacheTable(name, StorageLevel.MEMORY_AND_DISK)
    return report | {"schema": source.batch(spark).schema.simpleString(), "in_memory": spark.table(name).count()}
