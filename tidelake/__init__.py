"""tidelake: a Spark-first retail medallion engine (bronze, silver, gold) on DataFrames and Structured Streaming."""

__version__ = "0.1.0"
