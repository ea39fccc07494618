"""The event store fed by a stream: new files are cleaned and appended as they come, with the operators for batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandline.schemas import EVENTS
from strandline.sources.readers import clean_events


def follow_events(spark: SparkSession, path: str, schema: T.StructType = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append_clean(events: DataFrame, store: str, checkpoint: str, banned_items: tuple[int, ...] = ()) -> StreamingQuery:
    """Append cleaned events to a store, each file once; ends when what is there has been read."""
    writer = clean_events(events, banned_items).writeStream.format("parquet").outputMode("append")
    return writer.option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
