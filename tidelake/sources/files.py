"""File sources and sinks: CSV with a schema that is inferred once and kept, rescue of unexpected fields, and file lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESCUED = "_rescued_data"


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.option("header", True).option("inferSchema", True).csv(path).schema


def kept_schema(spark: SparkSession, path: str, schema_path: str) -> T.StructType:
    """The schema that was inferred first, kept as JSON text at schema_path; later files don't change it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{schema_path}/schema.json")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        stream = fs.open(p)
        text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        import json

        return T.StructType.fromJson(json.loads(text))
    schema = infer_schema(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(schema.json().encode()))
    stream.close()
    return schema


def with_lineage(df: DataFrame, run_ts=None) -> DataFrame:
    """Ingestion time and the file's path, name and modification time. df must still have the hidden _metadata column, or one selected."""
    stamp = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    out = df.withColumns(
        {
            "ingestion_timestamp": stamp,
            "source_file_path": F.col("_metadata.file_path"),
            "source_file_name": F.col("_metadata.file_name"),
            "source_file_modified_at": F.col("_metadata.file_modification_time"),
        }
    )
    return out.drop("_metadata")


def _rescuing(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """With a schema, rows with more fields or a value of another type keep what fits, and their raw line in the rescue column. Without, all strings."""
    reader = spark.read.option("header", header)
    if schema is None:
        return reader.csv(path)
    return reader.schema(_rescuing(schema)).option("columnNameOfCorruptRecord", RESCUED).option("enforceSchema", True).csv(path)


def stream_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stream of a folder's files with the lineage struct selected, as a micro-batch can't reach the hidden one."""
    reader = spark.readStream.format("csv").option("header", True).schema(_rescuing(schema)).option("columnNameOfCorruptRecord", RESCUED)
    return reader.load(path).select("*", "_metadata")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
