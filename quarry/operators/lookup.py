"""Point lookups, optional predicates, siblings and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, equals: Mapping[str, object] | None = None, contains: Mapping[str, str | None] | None = None, public: Column | None = None) -> DataFrame:
    """Keeps rows that meet every argument that is set.

    A predicate that isn't asked for isn't in the plan, so the rest reaches the scan.
    ``contains`` ignores case and leaves % and _ their meaning. ``public`` keeps rows
    where it holds.
    """
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    for name, part in (contains or {}).items():
        if part is not None:
            df = df.where(F.col(name).ilike(f"%{part}%"))
    return df if public is None else df.where(public)


def top(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows; ``order`` ends in a unique key."""
    return df.orderBy(*order).limit(n)


def exact_name(df: DataFrame, name: str, value: str, order: Sequence[Column | str], limit: int = 20, **filters: object) -> DataFrame:
    """Rows of one exact name, under optional filters, internal ones last (Q2, O2)."""
    return top(optional_filters(df.where(F.col(name) == value), **filters), order, limit)


def first_of(df: DataFrame, name: str, value: object, row_id: str) -> DataFrame:
    """The row with the lowest ``row_id`` of a stable id."""
    return df.where(F.col(name) == F.lit(value)).orderBy(row_id).limit(1)


def siblings(df: DataFrame, name: str, value: object, same: Sequence[str], row_id: str) -> DataFrame:
    """Rows that agree with the first row of ``value`` in all of ``same``, nulls with nulls."""
    anchor = first_of(df, name, value, row_id).select(*[F.col(c).alias(f"__{c}") for c in same])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same])
    return df.join(F.broadcast(anchor), on).select(*df.columns)  # one row


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in ``order`` with the ``total`` of all rows and whether more follow (O3, A1)."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def in_chunks(df: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Rows whose ``keys`` are among ``wanted``; Spark picks the join by size."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def capped(df: DataFrame, most: int) -> list:
    """All rows, or an error if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def union_tagged(branches: Mapping[str, DataFrame], tag: str = "branch") -> DataFrame:
    """All rows of all branches, each with its branch's name."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(k)) for k, df in branches.items()])
