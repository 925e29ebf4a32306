"""Reports of two engines, and how they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import base_name, before_hash
from quarry.operators import stats

REPORT = "packages array<struct<package:string,version:string,totalSymbols:long,totalFiles:long,symbols:array<struct<id:string,name:string,kindName:string,filePath:string>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(package, version, id, name, kind, file_path) of the symbols in JSON reports."""
    packages = spark.read.schema(REPORT).option("multiLine", "true").json(path).select(F.explode("packages").alias("p"))
    rows = packages.select("p.package", "p.version", F.explode("p.symbols").alias("s"))
    return rows.select("package", "version", "s.id", "s.name", F.col("s.kindName").alias("kind"), F.col("s.filePath").alias("file_path"))


def write(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines (K9)."""
    rows.write.mode("overwrite").json(path)


def package_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Symbols of each package in either report, their difference, largest first."""
    count = lambda df: df.groupBy(F.concat_ws("@", "package", "version").alias("key")).agg(F.count("*").alias("n"))
    return stats.one_sided(count(left), count(right), "key", "n").orderBy(F.abs("delta").desc(), "key")


def symbol_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, name) pairs of which the reports have different numbers."""
    keyed = lambda df: df.select(base_name(F.col("file_path")).alias("file"), "name")
    return stats.multiset_difference(keyed(left), keyed(right), ["file", "name"])


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of the first report that the second lacks, with whether it has their name."""
    bases = right.select(before_hash(F.col("name")).alias("base")).distinct().withColumn("has_name", F.lit(True))
    return left.join(right.select("id"), "id", "left_anti").withColumn("base", before_hash(F.col("name"))).join(bases, "base", "left").select("id", "name", F.coalesce("has_name", F.lit(False)).alias("has_name"))


def kind_shares(rows: DataFrame, k: int = 10) -> DataFrame:
    """The commonest kinds with their share of all symbols."""
    return stats.top_share(rows, "kind", k)


def constraint_faults(rows: DataFrame) -> DataFrame:
    """Ids that a package has more than once."""
    return stats.surplus(rows, ["package", "version", "id"])
