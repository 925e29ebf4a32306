"""Declaration merging, numbering and preferred picks, as aggregations and windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.functions.scalars import normalize_signature


def merge_key(kind: Column, scope: Column, name: Column, file: Column, signature: Column) -> Column:
    """What declarations of one symbol share: depends on the kind."""
    norm = normalize_signature(signature)
    return (
        F.when(kind.isin(*fixed.SCOPE_MERGED), F.concat_ws("::", scope, name, kind))
        .when(kind.isin(*fixed.SIGNATURE_MERGED), F.concat_ws("::", name, kind, norm))
        .otherwise(F.concat_ws("::", name, kind, file, norm))
    )


def first_seen(df: DataFrame, key: Sequence[str], value: str, seq: str, shown: str | None = None) -> DataFrame:
    """``key`` and an array of its distinct values in order of first occurrence.

    Values are made distinct before they are collected, so an array is no longer than its
    distinct values. ``shown`` is collected in place of ``value``, from its first row.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(seq).alias("__seq"), F.min_by(shown or value, seq).alias("__shown"))
    ordered = F.array_sort(F.collect_list(F.struct("__seq", "__shown")))
    return distinct.groupBy(*key).agg(F.transform(ordered, lambda s: s["__shown"]).alias("values"))


def merged(df: DataFrame, key: str, seq: str, signature: str, file: str, first: Sequence[str] = (), any_of: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    """One row for each ``key``: its first row by ``seq``, with the others folded in.

    ``signature``: those distinct after normalising, in order, one a line, empty ones left
    out. ``additional_files``: other files than the first, in order. ``first``: the first value that isn't null.
    ``any_of``: true if any is. ``sets``: sorted distinct values.
    """
    base = df.groupBy(key).agg(
        F.min(seq).alias(seq), F.min_by(file, seq).alias(file), F.count("*").alias("declarations"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first],
        *[F.bool_or(c).alias(c) for c in any_of], *[F.array_sort(F.collect_set(c)).alias(c) for c in sets],
    )
    normal = normalize_signature(F.col(signature))
    signatures = first_seen(df.withColumn("__norm", F.when(normal != "", normal)), [key], "__norm", seq, signature).withColumnRenamed("values", "__signatures")
    files = first_seen(df, [key], file, seq).withColumnRenamed("values", "__files")
    out = base.join(signatures, key, "left").join(files, key, "left")
    return out.withColumn(signature, F.array_join("__signatures", "\n")).withColumn("additional_files", F.coalesce(F.slice("__files", 2, F.greatest(F.size("__files"), F.lit(1))), F.array().cast("array<string>"))).drop("__signatures", "__files")


def numbered(df: DataFrame, base: Column, partition: Sequence[str], order: Sequence[Column | str], out: str = "id") -> DataFrame:
    """Ids of homonyms in order: ``base``, ``base#2``, ``base#3``."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, base).otherwise(F.concat(base, F.lit("#"), n.cast("string"))))


def first_tier(df: DataFrame, keys: Sequence[str], tier: str) -> DataFrame:
    """All rows of the lowest tier of each key."""
    return df.withColumn("__tier", F.min(tier).over(Window.partitionBy(*keys))).where(F.col(tier) == F.col("__tier")).drop("__tier")


def picked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def name_order(kind: Column, seq: Column) -> list[Column]:
    """Order in which a name's id is picked: the last interface or alias, else the first class, namespace or other."""
    last = kind.isin("InterfaceDeclaration", "TypeAliasDeclaration")
    tier = F.when(last, 0).when(kind == "ClassDeclaration", 1).when(kind == "ModuleDeclaration", 2).otherwise(3)
    return [tier, F.when(last, -seq).otherwise(seq)]


def ranked(c: Column, ranks: Mapping[str, int] | Sequence[str], default: int = fixed.DEFAULT_PARENT_RANK) -> Column:
    """The rank of a value in a list, ``default`` if it isn't there."""
    out = F.lit(default)
    for value, rank in ranks.items() if isinstance(ranks, Mapping) else ((v, k) for k, v in enumerate(ranks)):
        out = F.when(c == value, rank).otherwise(out)
    return out


def parent_rank(parent_kind: Column, member_kind: Column, is_type: Column) -> Column:
    """How well a parent's kind suits a member."""
    tables = {k: ranked(parent_kind, v) for k, v in fixed.PARENT_RANKS.items()}
    return (
        F.when(member_kind.isin("MethodDeclaration", "PropertyDeclaration"), tables["declared_member"])
        .when(member_kind.isin("InterfaceDeclaration", "ClassDeclaration", "EnumDeclaration", "TypeAliasDeclaration"), tables["declaration"])
        .when(is_type | member_kind.isin(*fixed.SIGNATURE_MERGED), tables["type_shape"])
        .otherwise(tables["value"])
    )


def hint_allows(kind: Column, hint: Column) -> Column:
    """Whether a kind may be meant by a reference with a hint; without one any may."""
    return hint.isNull() | ((hint == "value") & kind.isin(*fixed.KINDS_BY_HINT["value"])) | ((hint == "type") & kind.isin(*fixed.KINDS_BY_HINT["type"]))
