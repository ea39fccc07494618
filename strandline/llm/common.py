"""What the operators of this subpackage share: the shared scratch folder, written tables, Arrow batch maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandline.sources.scratch import scratch, written

__all__ = ["keep_rows", "map_arrow", "scratch", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that a function gets at a time, or one row: what it makes of them is all that is in memory.
BYTES_AT_ONCE = 4_000_000


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches, in slices of bounded size; fn is a picklable function of one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, mask: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """Rows of docs where mask(batch) is true, all columns as they are (extra ones too), without a shuffle."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(mask(batch), pa.bool_()))

    return map_arrow(docs, fn, docs.schema)
