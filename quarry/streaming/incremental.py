"""Streams over the same operators: an extension, as the reference has none.

``fold_calls`` keeps the last value of each field of an event stream's calls; ``index``
puts packages into a catalog as their files land.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.iterate import stored
from quarry.sources import packages
from quarry.sources.catalog import Catalog


def fold_calls(events: DataFrame, key: str = "call_id", order: str = "ts", fields: Sequence[str] = ("status",), late: str | None = None) -> DataFrame:
    """One row a call: the latest value that isn't null of each field, and the number of events.

    The same on a table and on a stream; ``late`` bounds a stream's state by a watermark.
    """
    if late is not None:
        events = events.withWatermark(order, late)
    return events.groupBy(key).agg(F.count("*").alias("events"), F.max(order).alias(f"last_{order}"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def index(files: DataFrame, catalog: Catalog, cache_key: str, checkpoint: str) -> StreamingQuery:
    """Indexes the packages in each micro-batch of (path, text) files.

    A batch must hold whole packages. A batch that is run again after a failure replaces
    the same packages, so the catalog ends up as if it had run once.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch = stored(batch, "landed")
        found = catalog.misses(packages.scan(batch), cache_key)
        if not found.isEmpty():
            catalog.save(found, packages.graphs(batch).join(found.select(F.col("name").alias("package"), "version"), ["package", "version"], "left_semi"), cache_key)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
