"""Ingestion and catalog operators over packages made from the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import iterate, merge
from quarry.plans.tables import spread
from quarry.plans.tables import table as T

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _word(k: int):
    """The k-th word of a part's name, as an identifier."""
    return F.initcap(F.element_at(F.split("p_name", " "), k))


def _files(s, d) -> DataFrame:
    """One install root for each part: a package with an entry, a shapes file and a manifest, and a dependency."""
    p = spread(T(s, d, "part"))
    root = F.concat(F.lit("/w"), F.col("p_partkey").cast("string"), F.lit("/node_modules/"))
    own, lib = F.concat(root, F.lit("pkg")), F.concat(root, F.lit("lib"))
    manifest = F.format_string('{"name": "pkg", "version": "%d.0.0", "types": "./index.d.ts", "dependencies": {"lib": "1", "%s": "*"}}', F.col("p_size"), F.lower("p_type"))
    index = F.format_string('import { Unit } from "lib";\nexport * from "./shapes";\nexport { %2$s as Renamed } from "./shapes.js";\n/** Makes a part.\n * @since %3$d.1 */\nexport declare function make(size: Unit, of: %1$s): %2$s;\n', _word(1), _word(2), F.col("p_size"))
    shapes = F.format_string("/// <reference path='./globals.d.ts' />\nexport interface %1$s { size: number; weight(): void }\nexport interface %2$s extends %1$s { weight(): void; own: string }\ndeclare const hidden: %1$s;\n", _word(1), _word(2))
    files = F.array(
        F.struct(F.concat(own, F.lit("/package.json")).alias("path"), manifest.alias("text")), F.struct(F.concat(own, F.lit("/index.d.ts")).alias("path"), index.alias("text")),
        F.struct(F.concat(own, F.lit("/shapes.d.ts")).alias("path"), shapes.alias("text")), F.struct(F.concat(lib, F.lit("/package.json")).alias("path"), F.lit('{"name": "lib", "version": "1.0.0"}').alias("text")),
        F.struct(F.concat(lib, F.lit("/index.d.ts")).alias("path"), F.lit("export type Unit = number;\n").alias("text")),
    )
    return p.select(F.explode(files).alias("f")).select("f.path", "f.text")


def _key(c: str):
    return F.regexp_extract(c, r"^/w(\d+)/", 1).cast("long")


_WORDS = "upper(substr(split_part(p_name, ' ', {k}), 1, 1)) || substr(split_part(p_name, ' ', {k}), 2)"
_W = f"w AS (SELECT p_partkey, p_size, p_type, {_WORDS.format(k=1)} AS a, {_WORDS.format(k=2)} AS b FROM part)"


@query("s1_scan_packages", "SELECT p_partkey, 'pkg' AS name, p_size || '.0.0' AS version, list_sort(['lib', lower(p_type)]) AS dependencies FROM part UNION ALL SELECT p_partkey, 'lib', '1.0.0', [] FROM part")
def s1_scan_packages(s, d):
    from quarry.sources import packages

    return packages.scan(_files(s, d)).select(_key("package_dir").alias("p_partkey"), "name", "version", "dependencies")


@query("s3_exact_package", "SELECT p_partkey FROM part WHERE p_size = 7")
def s3_exact_package(s, d):
    from quarry.sources import packages

    found = packages.scan(_files(s, d))
    return found.where("name = 'pkg' AND version = '7.0.0'").select(_key("package_dir").alias("p_partkey"))


@query(
    "s5_parse_declarations",
    f"""WITH {_W} SELECT p_partkey, a AS name, 'InterfaceDeclaration' AS kind, [] AS heritage FROM w UNION ALL SELECT p_partkey, a || '.size', 'PropertySignature', [] FROM w UNION ALL SELECT p_partkey, a || '.weight', 'MethodSignature', [] FROM w
    UNION ALL SELECT p_partkey, b, 'InterfaceDeclaration', [a] FROM w UNION ALL SELECT p_partkey, b || '.weight', 'MethodSignature', [] FROM w UNION ALL SELECT p_partkey, b || '.own', 'PropertySignature', [] FROM w
    UNION ALL SELECT p_partkey, 'hidden', 'VariableStatement', [] FROM w UNION ALL SELECT p_partkey, 'make', 'FunctionDeclaration', [] FROM w UNION ALL SELECT p_partkey, 'Renamed', 'ExportDeclaration', [] FROM w
    UNION ALL SELECT p_partkey, '*', 'ExportDeclaration', [] FROM w UNION ALL SELECT p_partkey, 'Unit', 'TypeAliasDeclaration', [] FROM w""",
)
def s5_parse_declarations(s, d):
    from quarry.sources import packages

    rows = packages.parsed(_files(s, d)).where("path NOT LIKE '%/lib/%' OR name = 'Unit'")
    hidden_members = F.col("name").startswith("hidden.")
    return rows.where(~hidden_members).select(_key("path").alias("p_partkey"), "name", "kind", "heritage")


@query("s6_directives", "SELECT p_partkey, ['./globals.d.ts'] AS paths FROM part")
def s6_directives(s, d):
    from quarry.sources import packages

    rows = packages.parsed(_files(s, d)).where("path LIKE '%/shapes.d.ts'")
    return rows.groupBy(_key("path").alias("p_partkey")).agg(F.first("references").alias("paths"))


@query(
    "package_graph",
    f"""WITH {_W}, r AS (SELECT *, 'pkg@' || p_size || '.0.0::' AS p FROM w)
    SELECT p_partkey, p || a AS id, 'InterfaceDeclaration' AS kind, false AS is_inherited, NULL AS since, [] AS dependencies FROM r
    UNION ALL SELECT p_partkey, p || b, 'InterfaceDeclaration', false, NULL, [p || a] FROM r
    UNION ALL SELECT p_partkey, p || 'Renamed', 'InterfaceDeclaration', false, NULL, [p || a] FROM r
    UNION ALL SELECT p_partkey, p || a || '.size', 'PropertySignature', false, NULL, [] FROM r UNION ALL SELECT p_partkey, p || a || '.weight', 'MethodSignature', false, NULL, [] FROM r
    UNION ALL SELECT p_partkey, p || b || '.own', 'PropertySignature', false, NULL, [] FROM r UNION ALL SELECT p_partkey, p || b || '.weight', 'MethodSignature', false, NULL, [] FROM r
    UNION ALL SELECT p_partkey, p || b || '.size', 'PropertySignature', true, NULL, [] FROM r UNION ALL SELECT p_partkey, p || 'Renamed.size', 'PropertySignature', true, NULL, [] FROM r UNION ALL SELECT p_partkey, p || 'Renamed.weight', 'MethodSignature', true, NULL, [] FROM r
    UNION ALL SELECT p_partkey, p || 'make', 'FunctionDeclaration', false, p_size || '.1', list_sort([p || a, p || b, p || '__outside__/__up__/lib/index.d.ts::Unit']) FROM r""",
)
def package_graph(s, d):
    """Public rows of each part's package: the graph is built once per install root."""
    from quarry.sources import packages

    files = _files(s, d)
    root = F.concat(F.regexp_extract("path", "^(/w[0-9]+/node_modules/)", 1), F.lit("pkg"))
    rows = packages.built(files.select(root.alias("root"), "path", "text")).where("NOT is_internal")
    return rows.select(_key("package_dir").alias("p_partkey"), "id", "kind", "is_inherited", "since", "dependencies")


@query("s4_packages_of_a_name", "SELECT p_partkey, '1.0.0' AS version FROM part")
def s4_packages_of_a_name(s, d):
    from quarry.sources import packages

    return packages.named(packages.scan(_files(s, d)), "lib").select(_key("package_dir").alias("p_partkey"), "version")


_LAYOUTS = [  # manifest, other files, entries
    ({"exports": {".": {"import": "./dist/main.mjs", "default": "./x.js"}, "./package.json": "./package.json"}}, ["dist/main.d.mts", "x.d.ts"], ["dist/main.d.mts"]),
    ({"typesVersions": {"<4.0": {"*": ["old/*"]}, ">=5.0": {"*": ["ts5/*"]}}}, ["old/index.d.ts", "ts5/index.d.ts", "index.d.ts"], ["ts5/index.d.ts"]),
    ({"exports": {"./features/*": {"types": ["./gen/*.d.ts"]}}}, ["gen/b.d.ts", "gen/a.d.ts", "gen/deep/c.d.ts"], ["gen/a.d.ts", "gen/b.d.ts"]),
    ({"types": "lib/index.js"}, ["lib/index.d.ts", "index.d.ts"], ["lib/index.d.ts"]),
    ({}, ["index.d.ts"], ["index.d.ts"]),
]


@query("s7_manifest_entries", "SELECT p_partkey, CASE p_size % 5 " + " ".join(f"WHEN {k} THEN {e}" for k, (_, _, e) in enumerate(_LAYOUTS)) + " END AS entries FROM part")
def s7_manifest_entries(s, d):
    """Conditional exports, typesVersions, wildcards, types beside a script, the fallback."""
    import json

    import pandas as pd

    from quarry.sources import manifests

    def entries(batches):
        for batch in batches:
            rows = []
            for key, size in zip(batch.p_partkey, batch.p_size, strict=True):
                raw, others, _ = _LAYOUTS[size % len(_LAYOUTS)]
                folder = f"/w{key}/node_modules/pkg"
                text = json.dumps({"name": "pkg", **raw})
                tree = manifests.Tree({f"{folder}/package.json": text, **{f"{folder}/{x}": "" for x in others}})
                found = manifests.entry_of(tree, folder, manifests.read_manifest(text, "pkg"))
                rows.append((key, [x.removeprefix(f"{folder}/") for x in found.files]))
            yield pd.DataFrame(rows, columns=["p_partkey", "entries"])

    return T(s, d, "part").select("p_partkey", "p_size").mapInPandas(entries, "p_partkey long, entries array<string>")


@query("s15_merged_options", "SELECT 'max_hops' AS option, '3' AS value UNION ALL SELECT 'include', '[\"a*\"]' UNION ALL SELECT 'exclude', '[]' UNION ALL SELECT 'package_scope', '[\"dependencies\"]'")
def s15_merged_options(s, d):
    import json

    from quarry.sources import config

    got = config.merged(config.DEFAULTS, config.from_mapping({"max_hops": 5, "include": ["a*"]}), config.from_mapping({"max_hops": 3}))
    return s.createDataFrame([(k, json.dumps(getattr(got, k))) for k in ("max_hops", "include", "exclude", "package_scope")], "option string, value string")


@query("s16_first_installed", "SELECT name, version, package_dir FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN package_dir LIKE '/b/%' THEN 0 WHEN package_dir LIKE '/a/%' THEN 1 ELSE 2 END, package_dir) AS n FROM (SELECT p_brand AS name, CAST(p_size AS STRING) AS version, concat('/', substr('abc', CAST(p_partkey % 3 + 1 AS INT), 1), '/', p_partkey, '/', p_brand) AS package_dir FROM part)) WHERE n = 1")
def s16_first_installed(s, d):
    from quarry.sources import packages

    root = F.element_at(F.array(F.lit("/a"), F.lit("/b"), F.lit("/c")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = T(s, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), F.concat_ws("/", root, "p_partkey", "p_brand").alias("package_dir"))
    return packages.first_installed(rows, ["/b/", "/a/"])


@query("o9_file_layers", "SELECT p_partkey, unnest(['index.d.ts', '__outside__/__up__/lib/index.d.ts', 'shapes.d.ts']) AS path, unnest([0, 1, 1])::INTEGER AS hop, unnest([0, 0, 1])::INTEGER AS place FROM part")
def o9_file_layers(s, d):
    """The files of each part's package by hops, sorted within a layer."""
    import pandas as pd

    from quarry.sources import graph, manifests

    def layers(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf.p_partkey.iloc[0])
        folder = f"/w{key}/node_modules/pkg"
        p = graph.Package(dict(zip(pdf.path, pdf.text, strict=True)), folder, 10, ())
        p.discover(manifests.entry_of(p.tree, folder, p.manifest).files)
        places: dict[int, int] = {}
        rows = []
        for path, hop in p.hops.items():
            rows.append((key, p.relative(path), hop, places.setdefault(hop, 0)))
            places[hop] += 1
        return pd.DataFrame(rows, columns=["p_partkey", "path", "hop", "place"])

    return _files(s, d).withColumn("p_partkey", _key("path")).groupBy("p_partkey").applyInPandas(layers, "p_partkey long, path string, hop int, place int")


@query(
    "x17_declared_members",
    f"""WITH {_W}, r AS (SELECT p_partkey, p_size, a, b FROM w)
    SELECT p_partkey, a AS name, 'ModuleDeclaration' AS kind, [] AS refs, NULL AS js_doc, NULL AS deprecated, NULL AS since, NULL AS visibility FROM r
    UNION ALL SELECT p_partkey, a || '.' || b, 'InterfaceDeclaration', [a || '.Other'], 'Holds ' || b || '.', 'use another', p_size || '.2', 'beta' FROM r
    UNION ALL SELECT p_partkey, a || '.' || b || '.quoted-key', 'PropertySignature', [a || '.Other'], NULL, 'use another', p_size || '.2', 'beta' FROM r
    UNION ALL SELECT p_partkey, a || '.' || b || '.[Symbol.iterator]', 'PropertySignature', [], NULL, 'use another', p_size || '.2', 'beta' FROM r
    UNION ALL SELECT p_partkey, a || '.Other', 'InterfaceDeclaration', [], NULL, NULL, NULL, NULL FROM r
    UNION ALL SELECT p_partkey, 'Deep', 'TypeAliasDeclaration', [], NULL, NULL, NULL, NULL FROM r UNION ALL SELECT p_partkey, 'Deep.one', 'PropertySignature', [], NULL, NULL, NULL, NULL FROM r
    UNION ALL SELECT p_partkey, 'Deep.one.two', 'PropertySignature', [], NULL, NULL, NULL, NULL FROM r UNION ALL SELECT p_partkey, 'Deep.three', 'MethodSignature', [], NULL, NULL, NULL, NULL FROM r""",
)
def x17_declared_members(s, d):
    """Qualified names, comments, keys and nested members of a declaration file made from each part."""
    from quarry.sources import packages

    text = F.format_string(
        "declare namespace %1$s {\n/** Holds %2$s.\n * @deprecated use another\n * @since %3$d.2\n * @beta */\ninterface %2$s { 'quoted-key': Other; [Symbol.iterator]: 1 }\ninterface Other {}\n}\nexport type Deep = { one: { two: 1 } } & { three(): void };\n",
        _word(1), _word(2), F.col("p_size"),
    )
    found = T(s, d, "part").where("p_name IS NOT NULL").select(F.concat(F.lit("/w"), "p_partkey", F.lit("/x.d.ts")).alias("path"), text.alias("text"))
    rows = packages.parsed(found)
    return rows.select(_key("path").alias("p_partkey"), "name", "kind", F.transform("refs", lambda r: r["name"]).alias("refs"), "js_doc", "deprecated", "since", "visibility")


# names are {a} and {b} of the part, ids and what they point to are below its package
_STRUCTURE = [  # id, kind, internal, parent, enclosing module, dependencies, surface, first re-export
    ("Shown", "InterfaceDeclaration", False, None, None, ["UNIT"], [], None), ("Shown.size", "PropertySignature", False, "Shown", None, ["UNIT"], [], None),
    ("{b}", "ModuleDeclaration", False, None, None, [], ["index.d.ts::{b}.Item", "index.d.ts::{a}", "shapes.d.ts::Box", "shapes.d.ts::Late"], None),
    ("Crate", "InterfaceDeclaration", False, None, None, [], [], "index.d.ts"), ("make", "FunctionDeclaration", False, None, None, [], [], None),
    ("Ambient", "InterfaceDeclaration", False, None, None, [], [], None), ("Ambient.here", "PropertySignature", False, "Ambient", None, [], [], None),
    ("UNIT", "TypeAliasDeclaration", True, None, None, [], [], None), ("index.d.ts::{b}.Item.of.size", "PropertySignature", True, "index.d.ts::{b}.Item.of", "{b}", ["UNIT"], [], None),
    ("index.d.ts::{b}.Item.of", "PropertySignature", True, "index.d.ts::{b}.Item", "{b}", ["index.d.ts::{a}"], [], None), ("index.d.ts::{b}.Item", "InterfaceDeclaration", True, "{b}", "{b}", ["index.d.ts::{a}"], [], None),
    ("index.d.ts::{b}.use", "FunctionDeclaration", True, "{b}", "{b}", ["index.d.ts::{b}.Item", "shapes.d.ts::Box", "shapes.d.ts::Late"], [], None),
    ("index.d.ts::{a}.size", "PropertySignature", True, "index.d.ts::{a}", None, ["UNIT"], [], None), ("index.d.ts::{a}", "InterfaceDeclaration", True, None, None, ["UNIT"], [], None),
    ("index.d.ts::make", "FunctionDeclaration", True, None, None, ["Ambient"], [], None), ("shapes.d.ts::Box.side", "PropertySignature", True, "shapes.d.ts::Box", None, [], [], None),
    ("shapes.d.ts::Box", "InterfaceDeclaration", True, None, None, [], [], None), ("shapes.d.ts::Late", "InterfaceDeclaration", True, None, None, [], [], None),
]


def _as_sql(x: str | None) -> str:
    if x is None:
        return "CAST(NULL AS STRING)"
    return "p || '" + x.replace("UNIT", "__outside__/__up__/lib/index.d.ts::Unit").replace("{a}", "' || a || '").replace("{b}", "' || b || '") + "'"


_STRUCTURE_SQL = f"WITH {_W}, r AS (SELECT *, 'pkg@' || p_size || '.0.0::' AS p FROM w) " + " UNION ALL ".join(
    f"SELECT p_partkey, {_as_sql(i)} AS id, '{kind}' AS kind, {str(internal).lower()} AS is_internal, {_as_sql(parent)} AS parent_id, {_as_sql(module)} AS enclosing_module_id, "
    f"list_sort([{', '.join(map(_as_sql, needs))}]) AS dependencies, list_sort([{', '.join(map(_as_sql, surface))}]) AS surface_dependencies, {f"'{first}'" if first else 'CAST(NULL AS STRING)'} AS re_exported_from FROM r"
    for i, kind, internal, parent, module, needs, surface, first in _STRUCTURE
)


@query("graph_structure", _STRUCTURE_SQL)
def graph_structure(s, d):
    """A package with imports, a namespace, directives, a default and renamed exports for each part, by ``packages.graphs``."""
    from quarry.sources import packages

    p = spread(T(s, d, "part"))
    folder = F.concat(F.lit("/w"), F.col("p_partkey").cast("string"), F.lit("/node_modules/"))
    index = F.format_string(
        '/// <reference path="./globals.d.ts" />\nimport { Unit as Size } from "lib";\nimport * as shapes from "./shapes";\ninterface %1$s { size: Size }\nexport { %1$s as Shown };\n'
        'export namespace %2$s { interface Item { of: %1$s } function use(x: Item, y: shapes.Box): Late; }\nexport { Box as Crate } from "./shapes.js";\nexport default function make(): Ambient;\n',
        _word(1), _word(2),
    )
    manifest = F.format_string('{"name": "pkg", "version": "%d.0.0", "types": "./index.d.ts"}', F.col("p_size"))
    texts = {
        "pkg/package.json": manifest, "pkg/index.d.ts": index, "pkg/shapes.d.ts": F.lit("export interface Box { side: number }\nexport interface Late {}\n"), "pkg/globals.d.ts": F.lit("interface Ambient { here: 1 }\n"),
        "lib/package.json": F.lit('{"name": "lib", "version": "1.0.0"}'), "lib/index.d.ts": F.lit("export type Unit = number;\n"),
    }
    found = p.select("p_partkey", "p_size", F.explode(F.array(*[F.struct(F.concat(folder, F.lit(k)).alias("path"), v.alias("text")) for k, v in texts.items()])).alias("f"))
    rows = packages.by_folder(found.select("f.*")).where("package = 'pkg'")
    lists = lambda c: F.array_sort(c).alias(c)
    return rows.select(_key("package_dir").alias("p_partkey"), "id", "kind", "is_internal", "parent_id", "enclosing_module_id", lists("dependencies"), lists("surface_dependencies"), "re_exported_from")


# --- catalog (K1-K4, M1-M9, J4) ----------------------------------------------------------


def _catalog(s, d):
    """A fresh catalog of parts: brands as packages, types as versions, names as symbols."""
    from quarry.sources import catalog, graph

    parts = T(s, d, "part")
    symbols = merge.numbered(parts, F.concat(F.col("p_brand"), F.lit("@"), F.col("p_type"), F.lit("::"), F.col("p_name")), ["p_brand", "p_type", "p_name"], ["p_partkey"])
    given = {"package": F.col("p_brand"), "version": F.col("p_type"), "id": F.col("id"), "name": F.col("p_name"), "seq": F.col("p_partkey"), "dependencies": F.split("p_name", " "), "since": F.col("p_size").cast("string"), "file_path": F.col("p_type")}
    fields = StructType.fromDDL(graph.SYMBOLS).fields
    rows = symbols.select(F.col("p_partkey").alias("seq"), *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    packages = parts.select(F.col("p_brand").alias("name"), F.col("p_type").alias("version")).distinct()
    c = catalog.Catalog(s, f"{iterate.shared_dir(s)}/quarry-catalog-{uuid.uuid4().hex}", buckets=8)
    return c, packages, rows


@query(
    "k1_save_replace",
    "SELECT p_brand AS package, p_type AS version, count(*) AS n, CASE WHEN p_brand = 'Brand#12' THEN 'second' ELSE 'first' END AS cache_key FROM part WHERE p_brand <> 'Brand#12' OR p_size > 20 GROUP BY 1, 2",
)
def k1_save_replace(s, d):
    c, packages, rows = _catalog(s, d)
    c.save(packages, rows, "first")
    again = rows.where("package = 'Brand#12' AND CAST(since AS int) > 20")
    c.save(packages.where("name = 'Brand#12'"), again, "second")
    keys = c.table("packages").select(F.col("name").alias("package"), "version", "cache_key")
    return c.table("symbols").groupBy("package", "version").agg(F.count("*").alias("n")).join(keys, ["package", "version"])


@query("k2_child_rows", "SELECT DISTINCT from_id, unnest(string_split(p_name, ' ')) AS to_id FROM (SELECT p_name, p_brand || '@' || p_type || '::' || p_name || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS from_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey) AS n FROM part))")
def k2_child_rows(s, d):
    c, packages, rows = _catalog(s, d)
    c.save(packages, rows, "k")
    return c.table("symbol_dependencies").select("from_id", "to_id")


@query("m1_cache_misses", "SELECT DISTINCT p_brand AS name, p_type AS version FROM part WHERE p_brand = 'Brand#7'")
def m1_cache_misses(s, d):
    c, packages, rows = _catalog(s, d)
    c.save(packages.where("name <> 'Brand#7'"), rows.where("package <> 'Brand#7'"), "k")
    return c.misses(packages, "k")


@query("m2_delete_glob", "SELECT p_brand AS package, count(*) AS n FROM part WHERE NOT (p_brand GLOB 'Brand#1*') GROUP BY 1")
def m2_delete_glob(s, d):
    c, packages, rows = _catalog(s, d)
    c.save(packages, rows, "k")
    c.delete(glob="Brand#1*")
    return c.table("symbols").groupBy("package").agg(F.count("*").alias("n"))


@query("m4_backfill", "SELECT p_brand AS name, p_type AS version, 1 AS backfill_revision, count(*) AS filled FROM part GROUP BY 1, 2")
def m4_backfill(s, d):
    c, packages, rows = _catalog(s, d)
    c.save(packages, rows, "k")
    state = c.state()
    state.pending_backfill = 1
    c._publish(state)
    c.backfill({1: lambda df: df.withColumn("js_doc", F.lit("filled"))}, "k")
    filled = c.table("symbols").where("js_doc = 'filled'").groupBy(F.col("package").alias("name"), "version").agg(F.count("*").alias("filled"))
    return c.table("packages").select("name", "version", "backfill_revision").join(filled, ["name", "version"])


@query("m7_status", "SELECT count(DISTINCT (p_brand, p_type)) AS packages, count(*) AS symbols, true AS ok FROM part")
def m7_status(s, d):
    c, packages, rows = _catalog(s, d)
    c.save(packages, rows, "k")
    got = c.status()
    return s.createDataFrame([(got["packages"], got["symbols"], got["ok"])], "packages long, symbols long, ok boolean")


@query("q_symbols_command", "SELECT p_name AS name, p_brand AS package, p_type AS version FROM part WHERE p_name = 'red plate' ORDER BY p_brand, p_type, p_partkey LIMIT 20")
def q_symbols_command(s, d):
    from quarry.plans import api

    c, packages, rows = _catalog(s, d)
    c.save(packages, rows.withColumn("is_internal", F.lit(False)), "k")
    return api.symbol(c, "red plate").select("name", "package", "version")


# --- evaluation (X28, F21, A17, A18) ------------------------------------------------------


@query("x28_first_object", "SELECT event_id, props AS body FROM events")
def x28_first_object(s, d):
    from quarry.operators import evaluation

    return T(s, d, "events").select("event_id", evaluation.first_object_of(F.concat(F.lit("answer: "), "props", F.lit(" } {"))).alias("body"))


@query("f21_json_contract", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['k_text'] ELSE ['valid_json'] END AS faults FROM events")
def f21_json_contract(s, d):
    from quarry.operators import evaluation

    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("says "), "props")).otherwise("nothing")
    return T(s, d, "events").select("event_id", evaluation.contract_faults(text, ["k_text"], []).alias("faults"))


@query(
    "pairwise_summary",
    """WITH p AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN value END) AS b, min(CASE WHEN event_type = 'purchase' THEN value END) AS t FROM events GROUP BY 1)
       SELECT count(*) AS attempted, count(*) FILTER (b < 50) AS completed, count(*) FILTER (t > b AND b < 50) AS correctness_treatment, count(*) FILTER (t < b AND b < 50) AS correctness_baseline FROM p WHERE b IS NOT NULL AND t IS NOT NULL""",
)
def pairwise_summary(s, d):
    from quarry.operators import evaluation, stats

    pairs = stats.paired(T(s, d, "events"), ["user_id"], "event_type", "view", "purchase", "value")
    named = {"task_id": F.col("user_id").cast("string"), "status": F.when(F.col("baseline") < 50, "completed").otherwise("skipped"), "baseline_correctness": F.col("baseline"), "treatment_correctness": F.col("treatment")}
    judgments = pairs.select(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(evaluation.JUDGMENT)])
    return evaluation.pairwise_summary(judgments).select("attempted", "completed", "correctness_treatment", "correctness_baseline")
