"""The query commands over a catalog (Q1-Q13), and their envelope and printers (K5-K8)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.functions.scalars import preview
from quarry.operators import lookup, merge, search
from quarry.plans import guarded
from quarry.sources.catalog import TEXT_COLUMNS, Catalog, row_id

ENVELOPE_VERSION = 1


def hits(symbols: DataFrame) -> DataFrame:
    """The columns that every search returns (F1)."""
    source = F.struct(F.col("source_package").alias("package"), F.col("source_version").alias("version"), F.col("source_path").alias("path"))
    return symbols.select("package", "version", "seq", "id", "name", "kind", "file_path", preview(F.col("signature")).alias("signature"), "is_internal", source.alias("source"))


def _filtered(catalog: Catalog, package: str | None, version: str | None, source_package: str | None, kind: str | None, file: str | None, internal: bool) -> DataFrame:
    rows = catalog.table("symbols", package=package)
    return lookup.optional_filters(rows, {"version": version, "source_package": source_package, "kind": kind}, {"file_path": file}, None if internal else ~F.col("is_internal"))


_ORDER = ("is_internal", "package", "version", "seq")


def symbol(catalog: Catalog, name: str, limit: int = 20, package: str | None = None, version: str | None = None, source_package: str | None = None, kind: str | None = None, file: str | None = None, internal: bool = False) -> DataFrame:
    """Symbols of an exact name (Q2)."""
    rows = _filtered(catalog, package, version, source_package, kind, file, internal)
    return hits(lookup.exact_name(rows, "name", name, _ORDER, limit))


def find(catalog: Catalog, text: str, limit: int = 20, package: str | None = None, version: str | None = None, source_package: str | None = None, kind: str | None = None, file: str | None = None, internal: bool = False) -> DataFrame:
    """Symbols that a search text matches, best first (Q1)."""
    rows = _filtered(catalog, package, version, source_package, kind, file, internal).withColumn("row_id", row_id())
    found = search.find(rows, catalog.index(package), text, "row_id", "name", limit, F.col("is_internal"), TEXT_COLUMNS)  # scores count all rows
    return hits(found)


def show(catalog: Catalog, symbol_id: str) -> DataFrame:
    """One symbol by id (Q3)."""
    return hits(catalog.table("symbols").where(F.col("id") == symbol_id).orderBy("package", "version", "seq").limit(1))


def snippet(catalog: Catalog, symbol_id: str) -> DataFrame:
    """A symbol's whole signature and documentation (Q4)."""
    rows = catalog.table("symbols").where(F.col("id") == symbol_id).orderBy("package", "version", "seq").limit(1)
    return rows.select("id", "name", "kind", "file_path", "signature", "js_doc", "deprecated", "since")


def overloads(catalog: Catalog, symbol_id: str) -> DataFrame:
    """The symbols that share a symbol's package, version, name and parent (Q5)."""
    rows = catalog.table("symbols")
    return hits(lookup.siblings(rows, "id", symbol_id, ["package", "version", "name", "parent_id"], "seq")).orderBy("package", "version", "seq")


def packages(catalog: Catalog) -> DataFrame:
    """All packages and versions, in text order (Q6)."""
    return catalog.table("packages").select("name", "version").orderBy("name", "version")


def package_versions(catalog: Catalog, name: str) -> DataFrame:
    return catalog.table("packages", package=name).select("version").orderBy("version")


def package_deps(catalog: Catalog, name: str, version: str) -> DataFrame:
    return catalog.table("package_dependencies", package=name).where(F.col("version") == version).select("dependency").orderBy("dependency")


def source_packages(catalog: Catalog, name: str, version: str) -> DataFrame:
    """The packages whose declarations a package shows (Q9)."""
    return catalog.table("symbols", package=name).where(F.col("version") == version).select("source_package").distinct().orderBy("source_package")


def active_package(installed: DataFrame, name: str, roots: Sequence[str], catalog: Catalog) -> DataFrame:
    """Installed versions of a name in the order of roots; the first is selected (Q10)."""
    rank = F.lit(len(roots))
    for k, root in reversed(list(enumerate(roots))):
        rank = F.when(F.col("package_dir").startswith(root), k).otherwise(rank)
    own = merge.picked(installed.where(F.col("name") == name).withColumn("rank", rank), ["package_dir"], ["rank"])
    indexed = catalog.table("packages", package=name).select("version").withColumn("is_indexed", F.lit(True))
    first = F.row_number().over(Window.partitionBy("name").orderBy("rank", "package_dir")) == 1
    return own.join(indexed, "version", "left").select("name", "version", "package_dir", F.coalesce("is_indexed", F.lit(False)).alias("is_indexed"), first.alias("selected"), "rank").orderBy("rank", "package_dir")


def symbols(catalog: Catalog, name: str, version: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a package's symbols, with their number and whether more follow (Q11)."""
    rows = catalog.table("symbols", package=name).where(F.col("version") == version)
    return lookup.page(hits(rows), ["seq"], limit, offset)


def evidence(catalog: Catalog, names: Sequence[str] = (), phrases: Sequence[str] = (), limit: int = 10, **filters: object) -> tuple[list[dict], dict[str, dict]]:
    """(hits, snippets by id): each anchor's best, exact names first, repeats left out.

    An anchor with more hits than ``limit`` ends in a row that says so.
    """
    out, seen, more = [], set(), 0
    for kind, text in [*(("name", n) for n in names), *(("phrase", p) for p in phrases)]:
        got = (symbol if kind == "name" else find)(catalog, text, limit + 1, **filters).collect()  # one over
        more += len(got) > limit
        for r in got[:limit]:
            if (r.package, r.version, r.id) not in seen:
                seen.add((r.package, r.version, r.id))
                out.append(r.asDict(recursive=True))
    ids = sorted({h["id"] for h in out})
    found = catalog.table("symbols").where(F.col("id").isin(*ids)) if ids else None  # at most limit * anchors
    rows = merge.picked(found, ["id"], ["package", "version", "seq"]).select("id", "signature", "js_doc").collect() if ids else []
    if more:
        out.append({"id": None, "truncated_anchors": more})
    return out, {r.id: {"signature": r.signature, "js_doc": r.js_doc} for r in rows}


def sql(catalog: Catalog, text: str, max_rows: int | None = None) -> list | DataFrame:
    """Rows of one reading statement over the catalog's tables."""
    got = guarded.read_only(catalog.spark, text, catalog.views())
    return got if max_rows is None else lookup.capped(got, max_rows)


def schema(catalog: Catalog) -> dict[str, str]:
    """Columns of each table, base tables first."""
    return {name: df.schema.simpleString() for name, df in catalog.views().items()}


# --- output ------------------------------------------------------------------------------


def suggestions(query: str, duration_ms: float, hits_found: int, snippets: int = 0, anchors: int = 0, empty_anchors: int = 0) -> list[str]:
    """Cheaper commands to try after a slow query that found little."""
    if duration_ms < fixed.SLOW_QUERY_MS:
        return []
    if query == "evidence":
        low = not hits_found or not snippets or (anchors > 0 and empty_anchors >= anchors)
        return ["symbol", "find", "snippet", "evidence"] if low else []
    if hits_found:
        return []
    return {"find": ["symbol", "evidence"], "symbol": ["find", "evidence"]}.get(query, [])


def envelope(query: str, run: Callable[[], object]) -> dict[str, object]:
    """``ok``, ``data`` and ``meta`` of a command; an error becomes a hint (K5)."""
    began = time.perf_counter()
    cost = "heavy" if query == "evidence" else "moderate" if query in ("find", "symbols", "active-package") else "light"
    meta: dict[str, object] = {"envelopeVersion": ENVELOPE_VERSION, "query": query, "cost": cost}
    try:
        data = run()
        data = [r.asDict(recursive=True) for r in data.collect()] if isinstance(data, DataFrame) else data
        out: dict[str, object] = {"ok": True, "data": data, "meta": meta}
    except (ValueError, LookupError) as fault:
        out = {"ok": False, "data": None, "meta": meta, "hint": str(fault)}
    meta["durationMs"] = round((time.perf_counter() - began) * 1000, 3)
    found = len(out["data"]) if isinstance(out["data"], list) else 0
    if tips := suggestions(query, meta["durationMs"], found):
        meta["suggestions"] = tips
    return out


def cell(value: object) -> object:
    """A value of ad hoc SQL as JSON has it: bytes as hex, odd floats as text."""
    if isinstance(value, (bytes, bytearray)):
        return f"hex:{bytes(value).hex()}"
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return str(value)
    return value


def printed(rows: Sequence[Mapping[str, object]], form: str = "jsonl") -> str:
    """Rows as ``jsonl``, one ``json`` array, or ``tsv`` with a header (K6)."""
    plain = [{k: cell(v) for k, v in r.items()} for r in rows]
    if form == "json":
        return json.dumps(plain, default=str)
    if form == "jsonl":
        return "\n".join(json.dumps(r, default=str) for r in plain)
    if form != "tsv":
        raise ValueError(f"unknown form {form!r}")
    flat = lambda v: "" if v is None else " ".join(str(v).replace("\t", " ").splitlines()) if isinstance(v, str) else json.dumps(v, default=str)
    return "\n".join("\t".join(line) for line in [list(plain[0]) if plain else [], *([flat(v) for v in r.values()] for r in plain)])


def plain_hits(rows: Sequence[Mapping[str, object]]) -> str:
    """Hits for a reader, one a line (K8)."""
    return "\n".join(f"{r['name']}  [{r['kind']}]  {r['package']}@{r['version']}  {r['file_path']}" + ("  (internal)" if r.get("is_internal") else "") for r in rows)
