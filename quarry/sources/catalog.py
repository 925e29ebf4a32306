"""The catalog of indexed packages: versioned Parquet snapshots in a shared folder.

Rows lie in buckets by package name. A change writes the buckets that it touches anew and
then publishes a manifest that names each bucket's files: readers see the state before or
after, never between. A lost executor's half-written files are in no manifest. Manifests
are renamed into place, so of two writers that began from one state the second fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import globs, search
from quarry.operators.iterate import stored
from quarry.sources import graph

SCHEMA_VERSION = 3
BUCKETS = 64
#: Names of the stored schema's tables and columns.
TABLES = {
    "packages": "name string, version string, package_dir string, symbols long, files long, indexed_at long, cache_key string, backfill_revision int, dependencies array<string>",
    "symbols": "seq long, " + graph.SYMBOLS + ", since_major long, since_minor long, since_patch long, decorators array<struct<name:string,arguments:string>>",
    "postings": "package string, version string, term string, id string, col string, positions array<int>",
    "lengths": "package string, version string, id string, len long",
}
#: How a table's rows lie in a bucket: postings by term, so that a search reads its terms' row groups.
ORDER = {"packages": ["name", "version"], "symbols": ["package", "version", "seq"], "postings": ["term", "id"], "lengths": ["id"]}
#: Tables that ad hoc SQL sees; the others are the text index.
SHOWN = ("packages", "symbols")
TEXT_COLUMNS = ("name", "signature", "js_doc")
#: Child tables are views on the symbols' arrays: distinct values of a row, as a set.
CHILDREN = {
    "symbol_dependencies": ("dependencies", "to_id"), "symbol_surface_dependencies": ("surface_dependencies", "to_id"), "symbol_inherited_from": ("inherited_from", "source_id"),
    "symbol_additional_files": ("additional_files", "file_path"), "symbol_heritage": ("heritage", "heritage"), "symbol_modifiers": ("modifiers", "modifier"),
}


def row_id() -> Column:
    """What names a symbol among all packages, in the text index."""
    return F.concat_ws("\u0001", "package", "version", "id")


def text_index(symbols: DataFrame) -> dict[str, DataFrame]:
    """``postings`` and ``lengths`` of symbols (K4)."""
    index = search.build(symbols.select("package", "version", row_id().alias("row_id"), *TEXT_COLUMNS), "row_id", TEXT_COLUMNS)
    parts = F.split("id", "\u0001")
    return {k: df.withColumns({"package": parts[0], "version": parts[1]}) for k, df in (("postings", index.postings), ("lengths", index.lengths))}


class Conflict(RuntimeError):
    """Another writer published first."""


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


@dataclass
class State:
    """What a manifest says."""

    number: int = 0
    schema_version: int = SCHEMA_VERSION
    pending_backfill: int | None = None
    buckets: int = BUCKETS
    files: dict[str, dict[str, str]] = field(default_factory=dict)  # table -> bucket -> folder


class Catalog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests ---------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _numbers(self) -> list[int]:
        log = self._path("_log")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in self._fs.listStatus(log) if x.getPath().getName().endswith(".json")) if self._fs.exists(log) else []

    def state(self) -> State:
        numbers = self._numbers()
        if not numbers:
            return State(buckets=self._buckets)
        stream = self._fs.open(self._path("_log", f"{numbers[-1]:012d}.json"))
        try:
            raw = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        state = State(**raw)
        if state.schema_version > SCHEMA_VERSION:
            raise RuntimeError(f"the catalog has schema {state.schema_version}; this code knows {SCHEMA_VERSION}")
        return state

    def _publish(self, state: State) -> None:
        state.number += 1
        final, part = self._path("_log", f"{state.number:012d}.json"), self._path("_log", f"{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(self._path("_log"))
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise Conflict(f"state {state.number} was published by another writer")

    # reading -----------------------------------------------------------------------------

    def table(self, name: str, state: State | None = None, package: str | None = None) -> DataFrame:
        """A table's rows; with a ``package`` only its bucket is read."""
        if name in CHILDREN:
            column, shown = CHILDREN[name]
            rows = self.table("symbols", state, package)
            return rows.select("package", "version", F.col("id").alias("from_id"), F.explode(F.array_distinct(column)).alias(shown))
        if name == "symbol_decorators":  # a bag: a decorator that stands twice is two rows (K3)
            rows = self.table("symbols", state, package).select("package", "version", F.col("id").alias("from_id"), F.posexplode("decorators").alias("place", "d"))
            return rows.select("package", "version", "from_id", "place", "d.name", "d.arguments")
        if name == "package_dependencies":
            return self.table("packages", state, package).select("name", "version", F.explode(F.array_distinct("dependencies")).alias("dependency"))
        state = state or self.state()
        folders = state.files.get(name, {})
        if package is not None:
            own = str(self.spark.range(1).select(bucket_of(F.lit(package), state.buckets)).first()[0])
            folders = {k: v for k, v in folders.items() if k == own}
        schema = StructType.fromDDL(TABLES[name])
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{x}" for x in sorted(set(folders.values()))])
        if package is not None:
            rows = rows.where(F.col("name" if name == "packages" else "package") == package)
        return rows

    def views(self, package: str | None = None) -> dict[str, DataFrame]:
        state = self.state()
        return {t: self.table(t, state, package) for t in (*SHOWN, *CHILDREN, "symbol_decorators", "package_dependencies")}

    def index(self, package: str | None = None) -> search.Index:
        """The kept text index."""
        state = self.state()
        return search.Index(self.table("postings", state, package), self.table("lengths", state, package))

    # writing -----------------------------------------------------------------------------

    def _rewrite(self, state: State, name: str, rows: DataFrame, touched: Iterable[int]) -> None:
        """Writes the ``touched`` buckets of a table; an empty bucket loses its files."""
        key = "name" if name == "packages" else "package"
        folder = f"{name}/{uuid.uuid4().hex}"
        numbered = rows.withColumn("bucket", bucket_of(F.col(key), state.buckets))
        numbered.repartition("bucket", F.col(key)).sortWithinPartitions("bucket", *ORDER[name]).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        written = {x.getPath().getName() for x in self._fs.listStatus(self._path(folder))}
        own = state.files.setdefault(name, {})
        for b in touched:
            own.pop(str(b), None)
            if f"bucket={b}" in written:
                own[str(b)] = f"{folder}/bucket={b}"

    def _touched(self, keys: DataFrame, buckets: int) -> list[int]:
        return sorted(r[0] for r in keys.select(bucket_of(F.col("name"), buckets)).distinct().collect())  # at most ``buckets`` rows

    def _kept(self, state: State, name: str, touched: Sequence[int], gone: DataFrame) -> DataFrame:
        """Rows of the touched buckets whose package and version aren't in ``gone``."""
        part = State(state.number, state.schema_version, state.pending_backfill, state.buckets, {name: {k: v for k, v in state.files.get(name, {}).items() if int(k) in set(touched)}})
        key = "name" if name == "packages" else "package"
        return self.table(name, part).join(gone.select(F.col("name").alias(key), "version").distinct(), [key, "version"], "left_anti").select(*StructType.fromDDL(TABLES[name]).names)

    def save(self, packages: DataFrame, symbols: DataFrame, cache_key: str, revision: int = 0) -> None:
        """Replaces packages with all their symbols at once, by name and version (K1, K2).

        ``packages`` has name, version and may have package_dir and dependencies;
        ``symbols`` is as ``graph.SYMBOLS``. Homonymous ids of a package are an error.
        """
        from quarry.functions.scalars import since_semver

        state, have = self.state(), set(packages.columns)
        since = since_semver(F.col("since"))
        if "decorators" not in symbols.columns:  # the parser skips them
            symbols = symbols.withColumn("decorators", F.lit(None).cast("array<struct<name:string,arguments:string>>"))
        new = symbols.withColumn("seq", F.monotonically_increasing_id() if "seq" not in symbols.columns else F.col("seq")).withColumns({f"since_{k}": since[k] for k in ("major", "minor", "patch")})
        new = stored(new.select(*StructType.fromDDL(TABLES["symbols"]).names), "save")  # the input runs once; numbers are fixed from here
        if not new.groupBy("package", "version", "id").count().where("count > 1").isEmpty():
            raise ValueError("a package has two symbols of one id")
        counts = new.groupBy(F.col("package").alias("name"), "version").agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"))
        given = packages.select("name", "version", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("package_dir", "string"), ("dependencies", "array<string>"))]).dropDuplicates(["name", "version"])
        given = stored(given, "save")
        rows = given.join(counts, ["name", "version"], "left").withColumns({
            "symbols": F.coalesce("symbols", F.lit(0)), "files": F.coalesce("files", F.lit(0)), "indexed_at": F.lit(int(time.time())), "cache_key": F.lit(cache_key), "backfill_revision": F.lit(revision),
            "dependencies": F.coalesce("dependencies", F.array().cast("array<string>")),
        })
        self._replace(state, given, {"packages": rows, "symbols": new, **text_index(new)})

    def _replace(self, state: State, gone: DataFrame, fresh: Mapping[str, DataFrame]) -> None:
        """Publishes a state in which the rows of ``gone`` (name, version) have given way to ``fresh`` ones, by table."""
        touched = self._touched(gone, state.buckets)
        for t in TABLES:
            rows = self._kept(state, t, touched, gone)
            self._rewrite(state, t, rows.unionByName(fresh[t].select(*StructType.fromDDL(TABLES[t]).names)) if t in fresh else rows, touched)
        self._publish(state)

    def delete(self, name: str | None = None, version: str | None = None, glob: str | None = None) -> int:
        """Drops packages by name, name and version, name glob, or all (M2); their symbols go, too."""
        state = self.state()
        gone = self.table("packages", state)
        if glob is not None:
            gone = gone.where(globs.glob(F.col("name"), glob))
        if name is not None:
            gone = gone.where(F.col("name") == name)
        if version is not None:
            gone = gone.where(F.col("version") == version)
        n = gone.count()
        if n:
            self._replace(state, gone, {})
        return n

    # cache and backfill ------------------------------------------------------------------

    def misses(self, packages: DataFrame, cache_key: str) -> DataFrame:
        """Packages that aren't indexed under ``cache_key`` up to the pending revision (M1)."""
        state = self.state()
        hits = self.table("packages", state).where((F.col("cache_key") == cache_key) & (F.col("backfill_revision") >= F.lit(state.pending_backfill or 0)))
        return packages.join(hits.select("name", "version"), ["name", "version"], "left_anti")

    def pending(self, cache_key: str) -> DataFrame:
        """Packages of a cache key that lag behind the pending revision."""
        state = self.state()
        return self.table("packages", state).where((F.col("cache_key") == cache_key) & (F.col("backfill_revision") < F.lit(state.pending_backfill or 0)))

    def migrate(self, steps: Sequence[tuple[int, str, int | None]]) -> list[int]:
        """Applies ordered (version, kind, revision) steps above the present one: ``instant``, ``rebuild`` or ``backfill`` (M3)."""
        state, applied = self.state(), []
        known = [v for v, _, _ in steps]
        if known != sorted(set(known)):
            raise ValueError("migrations must ascend")
        for version, kind, revision in steps:
            if version <= state.schema_version:
                continue
            if kind == "rebuild":
                state.files = {}
            elif kind == "backfill":
                state.pending_backfill = max(state.pending_backfill or 0, revision or 0)
            state.schema_version = version
            applied.append(version)
        if applied:
            self._publish(state)
        return applied

    def backfill(self, steps: Mapping[int, Callable[[DataFrame], DataFrame]], cache_key: str, most: int | None = None) -> int:
        """Runs the steps above each lagging package's revision, on at most ``most`` packages (M4, M5, M6).

        A step rewrites symbol rows; packages at different revisions run the steps that they
        lack. When no package of the key lags, the pending mark goes.
        """
        state = self.state()
        target = state.pending_backfill
        if target is None:
            return 0
        lagging = self.pending(cache_key).orderBy("name", "version")
        todo = (lagging if most is None else lagging.limit(most)).select("name", "version", "backfill_revision")
        todo = self.spark.createDataFrame(todo.collect(), todo.schema) if most is not None else todo  # a fixed choice
        n = todo.count()
        if n:
            symbols = self.table("symbols", state).join(todo.select(F.col("name").alias("package"), "version", "backfill_revision"), ["package", "version"])
            for revision in sorted(r for r in steps if r <= target):
                due = symbols.where(F.col("backfill_revision") < revision)
                symbols = symbols.where(F.col("backfill_revision") >= revision).unionByName(steps[revision](due))
            symbols = stored(symbols, "backfill")
            packages = self.table("packages", state).join(todo.select("name", "version"), ["name", "version"], "left_semi").withColumn("backfill_revision", F.lit(target))
            self._replace(state, todo, {"symbols": symbols, "packages": packages, **text_index(symbols)})
        if self.pending(cache_key).isEmpty():
            state = self.state()
            state.pending_backfill = None
            self._publish(state)
        return n

    # maintenance -------------------------------------------------------------------------

    def status(self) -> dict[str, object]:
        """Sizes, versions, and the outcome of key and reference checks (M7)."""
        state = self.state()
        packages, symbols = self.table("packages", state), self.table("symbols", state)
        twice = packages.groupBy("name", "version").count().where("count > 1").count()
        orphans = symbols.join(packages.select(F.col("name").alias("package"), "version"), ["package", "version"], "left_anti").count()
        again = symbols.groupBy("package", "version", "id").count().where("count > 1").count()
        size = self._fs.getContentSummary(self._path()).getLength() if self._fs.exists(self._path()) else 0
        return {
            "state": state.number, "schema_version": state.schema_version, "pending_backfill": state.pending_backfill, "bytes": size, "packages": packages.count(), "symbols": symbols.count(),
            "repeated_packages": twice, "orphan_symbols": orphans, "repeated_symbols": again, "ok": not (twice or orphans or again),
        }

    def vacuum(self) -> int:
        """Deletes buckets' folders and manifests that the present state doesn't name (M8). No reader may hold an older state."""
        state, gone = self.state(), 0
        used = {x for t in state.files.values() for x in t.values()}
        for t in TABLES:
            for x in self._fs.listStatus(self._path(t)) if self._fs.exists(self._path(t)) else []:
                folder, parts = f"{t}/{x.getPath().getName()}", list(self._fs.listStatus(x.getPath()))
                kept = [y for y in parts if f"{folder}/{y.getPath().getName()}" in used]
                for y in parts if kept else [x]:
                    if y not in kept and (y is x or y.getPath().getName().startswith("bucket=")):
                        gone += bool(self._fs.delete(y.getPath(), True))
        for k in self._numbers()[:-1]:
            self._fs.delete(self._path("_log", f"{k:012d}.json"), False)
        return gone

    def destroy(self, force: bool = False) -> bool:
        """Deletes the whole catalog; refused where the folder isn't one, and without ``force``."""
        if not force:
            raise PermissionError("deleting a catalog needs force=True")
        if not self._fs.exists(self._path("_log")):
            raise ValueError(f"{self.root} is no catalog")
        return bool(self._fs.delete(self._path(), True))


class Given(Catalog):
    """Tables that lie elsewhere, for reading: the commands over them are those over a catalog."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, {**{k: v for k, v in text_index(tables["symbols"]).items() if k not in tables}, **tables}

    def state(self) -> State:
        return State()

    def table(self, name: str, state: State | None = None, package: str | None = None) -> DataFrame:
        if name not in self.tables:
            return super().table(name, state, package)
        rows = self.tables[name]
        return rows if package is None else rows.where(F.col("name" if name == "packages" else "package") == package)
