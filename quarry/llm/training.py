"""Bounded samples of labelled texts, and the folds that hold rows out."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of any classifier's training sample: rows, and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 20 << 20


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))


def released() -> None:
    """Gives memory that a fit has used back to the system: the driver has other stages to run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sample(docs: DataFrame, labels: DataFrame | None, target: str, in_fold: Column, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """At most ``rows`` labelled rows (``text``, ``target``) on the driver, ``text_bytes`` long in all.

    A text that doesn't fit in what is left of the bound is left out and takes nothing from it.
    ``labels`` has ``doc_id`` and ``target`` (the least of an id's labels counts); without it
    ``target`` is a column of ``docs``. Rows where the id or the label is null, or outside of
    ``in_fold``, are never seen. The choice follows a hash of the id, so it doesn't depend
    on the order or the partitions. Ids and lengths come first, so that no more text is
    fetched than the bound allows.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("sample"), "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    texts = docs.where(in_fold & F.col("doc_id").isNotNull())
    if labels is None:
        texts = texts.where(F.col(target).isNotNull()).select("doc_id", "text", target, size)
        fit = texts.select("doc_id", "size").where(F.col("size") <= text_bytes)
    else:
        chosen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & in_fold).select("doc_id", target)
        texts = texts.select("doc_id", "text", size)
        fit = chosen.select("doc_id").distinct().join(texts.select("doc_id", "size").where(F.col("size") <= text_bytes), "doc_id")
    ids, left = [], text_bytes
    for row in fit.orderBy(order, "doc_id", "size").limit(rows).collect():
        if row.size <= left:  # a text that doesn't fit is left out; those after it may fit
            left -= row.size
            ids.append((row.doc_id, row.size))
    if not ids:
        return pa.table({"text": pa.array([], pa.large_string()), target: pa.array([], pa.int32())})
    few = spark.createDataFrame(sorted(set(ids)), "doc_id long, size long")  # at most ``rows``
    got = texts.join(F.broadcast(few), ["doc_id", "size"])
    if labels is not None:
        least = chosen.join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(target).alias(target))
        got = got.join(F.broadcast(least), "doc_id")
    return got.orderBy(order, "doc_id", "size", "text").limit(rows).select("text", target).toArrow()
