"""The same row-wise operators over a stream of transcripts; they hold no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.pipeline import process


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def start(df: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Process a stream into parquet files, each input row exactly once."""
    out = process(df, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
