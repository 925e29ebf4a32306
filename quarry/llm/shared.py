"""Arrow batches of bounded size; tables in the shared folder and components come from the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarry.operators.iterate import components, shared_dir, stored

__all__ = ["components", "over_batches", "shared_dir", "stored", "tuned"]


def tuned(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that very long texts stay in memory bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def over_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """Run ``work`` on each Arrow batch of ``df``."""
    tuned(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)
