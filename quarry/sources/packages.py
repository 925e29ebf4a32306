"""Installed packages as tables: scanning, lookup and parsing at the scale of a registry.

Files come from ``spark.read`` as (path, text) rows, so any store that Spark reads will do.
Packages are independent: one task handles whole packages, a package's files together.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import fixed
from quarry.operators.iterate import reached, stored

FILES = "package_dir string, path string, text string"


def files(spark: SparkSession, root: str, glob: str = "*.{ts,mts,cts,json}") -> DataFrame:
    """(path, text) of all files below ``root`` that a package graph may need."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).format("binaryFile").load(root)
    return read.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", F.lit("UTF-8")).alias("text"))


#: The folder of the installed package that owns a path: the last ``node_modules`` segment and one or two more.
_PACKAGE = r"^(.*/node_modules/(?:@[^/]+/[^/]+|[^/@.][^/]*))/"


def package_of(path: Column) -> Column:
    return F.regexp_extract(path, _PACKAGE, 1)


def scan(found: DataFrame) -> DataFrame:
    """(package_dir, name, version, dependencies, is_scoped) of manifests right below an install root.

    Dot folders and package managers are left out; a manifest that is no JSON object is, too.
    """
    manifests = found.where(F.col("path").rlike(r"/node_modules/(@[^/]+/[^/]+|[^/@.][^/]*)/package\.json$")).withColumn("package_dir", F.regexp_extract("path", "^(.*)/package.json$", 1))
    json = F.from_json("text", "name string, version string, dependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>")
    keys = lambda c: F.coalesce(F.map_keys(F.col(f"m.{c}")), F.array().cast("array<string>"))
    every = F.array_sort(F.array_distinct(F.concat(keys("dependencies"), keys("peerDependencies"), keys("optionalDependencies"))))
    fallback = F.regexp_extract("package_dir", r"/node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    rows = manifests.withColumn("m", json).where(F.col("m").isNotNull() & F.try_parse_json("text").isNotNull())
    out = rows.select("package_dir", F.coalesce("m.name", fallback).alias("name"), F.coalesce("m.version", F.lit("0.0.0")).alias("version"), every.alias("dependencies"))
    return out.where(~F.col("name").isin(*fixed.TOOLCHAIN)).withColumn("is_scoped", F.col("name").startswith("@"))


def exact(packages: DataFrame, name: str, version: str) -> DataFrame:
    """The installed package of a name and version; an error if there is none (S3)."""
    out = packages.where((F.col("name") == name) & (F.col("version") == version))
    if out.isEmpty():
        raise LookupError(f"{name}@{version} is not installed")
    return out


def named(packages: DataFrame, name: str) -> DataFrame:
    """The installed packages of a name."""
    return packages.where(F.col("name") == name)


def first_installed(packages: DataFrame, roots: Sequence[str]) -> DataFrame:
    """One row a package name: that of the first root, in their order."""
    rank = F.lit(len(roots))
    for k, root in reversed(list(enumerate(roots))):
        rank = F.when(F.col("package_dir").startswith(root), k).otherwise(rank)
    return packages.groupBy("name").agg(F.min_by(F.struct(*packages.columns), F.struct(rank, "package_dir")).alias("p")).select("p.*")


PARSED = (
    "path string, seq int, name string, kind string, kind_code int, signature string, js_doc string, deprecated string, visibility string, since string, "
    "refs array<struct<name:string,import_path:string,hint:string>>, heritage array<string>, modifiers array<string>, is_explicit boolean, is_type_only boolean, symbol_space string, "
    "source string, original_name string, is_wildcard boolean, is_namespace_export boolean, is_global boolean, enclosing string, is_module boolean, references array<string>"
)


#: Rows that a task hands on together.
ROWS = 20_000


def _in_turn(made: list[pa.RecordBatch], keys: list[str], name: str) -> pa.RecordBatch:
    """The rows of each of ``made`` after each other, beside its key; the same one may stand there many times."""
    distinct = {id(x): x for x in made}
    starts = dict(zip(distinct, np.cumsum([0, *(x.num_rows for x in distinct.values())]).tolist(), strict=False))
    sizes = np.array([x.num_rows for x in made])
    rows = np.arange(sizes.sum()) + np.repeat(np.array([starts[id(x)] for x in made]) - (np.cumsum(sizes) - sizes), sizes)
    out = pa.concat_batches(distinct.values()).take(pa.array(rows))
    key = pa.array(keys, pa.string()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
    return pa.RecordBatch.from_arrays([key, *out.columns], [name, *out.schema.names])


def parsed(found: DataFrame) -> DataFrame:
    """One row for each declaration and export clause of the declaration files among (path, text)."""
    schema = to_arrow_schema(StructType.fromDDL(PARSED.removeprefix("path string, ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.sources import declarations

        def rows_of(text: str) -> pa.RecordBatch:
            p = declarations.parse(text)
            rows = [
                (
                    k, e.name, e.kind, fixed.KIND_CODES[e.kind], e.signature, e.js_doc, e.deprecated, e.visibility, e.since,
                    [{"name": r.name, "import_path": r.import_path, "hint": r.hint} for r in e.references], e.heritage, e.modifiers, e.is_explicit, e.is_type_only, e.space,
                    e.source, e.original_name, e.is_wildcard, e.is_namespace_export, e.is_global, e.enclosing, p.is_module, p.references,
                )
                for k, e in enumerate(p.exports)
            ]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

        for batch in batches:
            seen: dict[str, pa.RecordBatch] = {}  # equal texts of a batch give equal rows
            made, paths, n = [], [], 0
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (text := text or "") not in seen:
                    seen[text] = rows_of(text)
                made.append(seen[text])
                paths.append(path)
                n += made[-1].num_rows
                if n >= ROWS:
                    yield _in_turn(made, paths, "path")
                    seen, made, paths, n = {}, [], [], 0
            if made:
                yield _in_turn(made, paths, "path")

    return found.where(F.col("path").rlike(r"\.d\.(ts|mts|cts)$")).select("path", "text").mapInArrow(run, PARSED)


def _wanted(found: DataFrame) -> DataFrame:
    """(package_dir, target): packages that a package's declarations may lead into, over-estimated by their quoted texts.

    A bare specifier means the packages of its name, or their types, in the folders above; a
    relative one may lead into a neighbour.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for path, own, text in zip(batch.path, batch.package_dir, batch.text, strict=True):
                for spec in set(re.findall(r"""["']([^"'\s]+)["']""", text or "")):
                    if spec.startswith("."):
                        full = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)) + "/"
                        if not full.startswith(f"{own}/") and (m := re.match(_PACKAGE, full)):
                            rows.add((own, "", m[1]))
                    elif m := re.match(r"(@[^/]+/[^/]+|[^@/][^/]*)", spec):
                        rows.update((own, name, "") for name in (m[1], f"@types/{m[1]}"))
            yield pd.DataFrame(sorted(rows), columns=["package_dir", "name", "target"])

    needs = found.where(F.col("path").rlike(r"\.d\.(ts|mts|cts)$")).mapInPandas(run, "package_dir string, name string, target string").distinct()
    known = found.select("package_dir").distinct().select(F.col("package_dir").alias("target"), _root(F.col("package_dir")).alias("root"), F.regexp_extract("package_dir", r"/node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("name"))
    bare = needs.where("target = ''").select("package_dir", _root(F.col("package_dir")).alias("root"), "name").hint("merge").join(known.hint("merge"), ["root", "name"])
    above = bare.where(F.col("package_dir").startswith(F.regexp_extract("target", r"^(.*)/node_modules/", 1))).select("package_dir", "target")
    return above.unionByName(needs.where("target <> ''").select("package_dir", "target")).where("package_dir <> target").distinct()


def _root(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/node_modules/", 1)


def graphs(found: DataFrame, max_hops: int = 10, stubs: Sequence[str] = ()) -> DataFrame:
    """The symbol graph of every installed package among (path, text): see ``graph.SYMBOLS``."""
    return by_folder(found, max_hops, stubs).drop("package_dir")


def by_folder(found: DataFrame, max_hops: int = 10, stubs: Sequence[str] = ()) -> DataFrame:
    """``graphs`` beside the folder that each package is in, ``package_dir``.

    A package is a group of its own: its files and those of the packages that it may lead
    into, however an install root is laid out. Only the names of packages meet in a join.
    Joins are by sorting: how large texts made by a plan are is not known to the planner, and
    the driver must never hold them.
    """
    owned = found.withColumn("package_dir", package_of(F.col("path"))).where("package_dir <> ''")
    leads = stored(_wanted(owned), "package-leads")
    every = owned.where(F.col("path") == F.concat("package_dir", F.lit("/package.json"))).select("package_dir").distinct()
    starts = every.select(F.col("package_dir").alias("node"))
    within = reached(starts, leads.select(F.col("package_dir").alias("src"), F.col("target").alias("dst")), max_hops + 1 if max_hops >= 0 else -1).select("root", F.col("node").alias("package_dir"))
    files_of = within.hint("merge").join(owned.select("package_dir", "path", "text").hint("merge"), "package_dir").select("root", "path", "text")
    return built(files_of, max_hops, stubs)


def built(files_of: DataFrame, max_hops: int = 10, stubs: Sequence[str] = ()) -> DataFrame:
    """The symbol graph, beside ``package_dir``, of each package folder ``root``, given all files (root, path, text) it may reach.

    A task goes through its packages one after another; it holds the files of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.sources import graph

        made, roots, n = [], [], 0
        root, files = None, {}
        for batch in batches:
            for at, path, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at != root:
                    if root is not None:
                        made.append(graph.table(files, root, max_hops, stubs))
                        roots.append(root)
                        n += made[-1].num_rows
                    if n >= ROWS:
                        yield _in_turn(made, roots, "package_dir")
                        made, roots, n = [], [], 0
                    root, files = at, {}
                files[path] = text
        if root is not None:
            made.append(graph.table(files, root, max_hops, stubs))
            roots.append(root)
        if made:
            yield _in_turn(made, roots, "package_dir")

    from quarry.sources import graph

    return files_of.select("root", "path", "text").repartition("root").sortWithinPartitions("root").mapInArrow(run, "package_dir string, " + graph.SYMBOLS)
