"""The query commands, printers and catalog operators over a catalog of parts, with their SQL.

Brands are packages and parts are symbols; the expressions below mean the same to Spark
and to DuckDB, so that both sides begin from equal tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import iterate, lookup, merge
from quarry.plans import api, guarded
from quarry.plans.tables import table as T
from quarry.sources import catalog, graph

QUERIES, ORACLE_SQL = {}, {}

_VERSION = "concat('1.', CAST(p_size % 3 AS STRING), '.0')"
_SYMBOLS = {
    "seq": "p_partkey", "package": "p_brand", "version": _VERSION, "id": "concat('part:', CAST(p_partkey AS STRING))", "name": "p_name",
    "kind": "CASE p_size % 4 WHEN 0 THEN 'InterfaceDeclaration' WHEN 1 THEN 'TypeAliasDeclaration' WHEN 2 THEN 'ClassDeclaration' ELSE 'FunctionDeclaration' END",
    "file_path": "concat('src/', lower(p_type), '.d.ts')", "signature": "concat('declare ', p_name, ' as ', lower(p_type))",
    "js_doc": "CASE WHEN p_size % 3 > 0 THEN concat('A ', p_name, ' of size ', CAST(p_size AS STRING)) END", "is_internal": "p_size % 5 = 0",
    "parent_id": "CASE WHEN p_partkey % 10 <> 0 THEN concat('part:', CAST(p_partkey - p_partkey % 10 AS STRING)) END",
    "source_package": "CASE WHEN p_size % 7 = 0 THEN 'shared' ELSE p_brand END", "since": "CAST(p_size AS STRING)",
}
_LISTS = {"dependencies": ("concat('part:', CAST(p_partkey % 97 + 1 AS STRING))", "concat('part:', CAST(p_partkey + 1 AS STRING))"), "heritage": ("lower(p_type)",), "inherited_from": ("concat('part:', CAST(p_partkey % 10 AS STRING))",)}
_SYM = "symbols AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SYMBOLS.items()) + ", " + ", ".join(f"[{', '.join(e)}] AS {n}" for n, e in _LISTS.items()) + " FROM part)"
_PKG = f"packages AS (SELECT p_brand AS name, {_VERSION} AS version, count(*) AS symbols, list_sort(list_distinct(list(lower(p_type)))) AS dependencies FROM part GROUP BY 1, 2)"
_CHILD = "symbol_dependencies AS (SELECT DISTINCT package, version, id AS from_id, unnest(dependencies) AS to_id FROM symbols), symbol_inherited_from AS (SELECT DISTINCT package, version, id AS from_id, unnest(inherited_from) AS source_id FROM symbols)"
_WITH = f"WITH {_SYM}, {_PKG}, {_CHILD}"
_HITS = "package, version, seq, id, name, kind, file_path, signature, is_internal"


def query(name: str, sql: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.startswith("WITH") else f"{_WITH} {sql}"
        return f

    return register


def _tables(s, d) -> dict[str, DataFrame]:
    """``packages`` and ``symbols`` of the parts."""
    given = {n: F.expr(e) for n, e in _SYMBOLS.items()} | {n: F.expr(f"array({', '.join(e)})") for n, e in _LISTS.items()}
    fields = StructType.fromDDL(catalog.TABLES["symbols"]).fields
    symbols = T(s, d, "part").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    packages = symbols.groupBy(F.col("package").alias("name"), "version").agg(F.count("*").alias("symbols"), F.array_sort(F.collect_set(F.element_at("heritage", 1))).alias("dependencies"))
    return {"packages": packages, "symbols": symbols}


def _given(s, d) -> catalog.Given:
    return catalog.Given(s, _tables(s, d))


_kept: dict[tuple[str, str], catalog.Catalog] = {}


def _saved(s, d) -> catalog.Catalog:
    """The parts in a real catalog, kept with its text index for as long as the session lives."""
    key = (s.sparkContext.applicationId, d)
    if key not in _kept:
        _kept[key] = _fresh(s, d)
    return _kept[key]


def _fresh(s, d, some: str = "true") -> catalog.Catalog:
    tables = _tables(s, d)
    c = catalog.Catalog(s, f"{iterate.shared_dir(s)}/quarry-catalog-{uuid.uuid4().hex}", buckets=8)
    names = [f.name for f in StructType.fromDDL(graph.SYMBOLS)]
    c.save(tables["packages"].where(some), tables["symbols"].select("seq", *names).join(tables["packages"].where(some).select(F.col("name").alias("package"), "version"), ["package", "version"], "left_semi"), "k")
    return c


def _plain(hits: DataFrame) -> DataFrame:
    return hits.drop("source")


# --- commands (Q1-Q12, O1-O8, J1-J8, A2-A5) ------------------------------------------------

_RANKED = """, toks AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', name, signature, js_doc)), '[a-z0-9]+') AS t FROM symbols), corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
  words AS (SELECT id, unnest(t) AS term FROM toks), tf AS (SELECT id, term, count(*) AS tf FROM words WHERE term IN ('red', 'plate') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  scored AS (SELECT id, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))) AS score FROM tf JOIN df USING (term) JOIN toks USING (id), corpus GROUP BY id HAVING count(*) = 2)"""
_FIND = f"""{_WITH}{_RANKED} SELECT {_HITS} FROM symbols JOIN scored USING (id)
  ORDER BY CASE WHEN name = 'red plate' THEN 0 WHEN name ILIKE 'red plate%' THEN 1 ELSE 2 END, score, is_internal, concat_ws(chr(1), package, version, id) LIMIT 60"""


@query("q1_find", _FIND)
def q1_find(s, d):
    """Through the text index that the catalog keeps."""
    return _plain(api.find(_saved(s, d), "red plate", limit=60, internal=True))


@query("q1_find_given", _FIND)
def q1_find_given(s, d):
    return _plain(api.find(_given(s, d), "red plate", limit=60, internal=True))


@query("q2_symbol_filtered", f"SELECT {_HITS} FROM symbols WHERE name = 'red plate' AND kind = 'ClassDeclaration' AND file_path ILIKE '%s%' AND NOT is_internal ORDER BY package, version, seq LIMIT 30")
def q2_symbol_filtered(s, d):
    return _plain(api.symbol(_saved(s, d), "red plate", kind="ClassDeclaration", file="s", limit=30))


@query("q3_show", f"SELECT {_HITS} FROM symbols WHERE id = 'part:17'")
def q3_show(s, d):
    return _plain(api.show(_given(s, d), "part:17"))


@query("q4_snippet", "SELECT id, name, kind, file_path, signature, js_doc, CAST(NULL AS VARCHAR) AS deprecated, since FROM symbols WHERE id = 'part:23'")
def q4_snippet(s, d):
    return api.snippet(_given(s, d), "part:23")


@query("q5_overloads", f"SELECT {_HITS} FROM symbols s WHERE EXISTS (SELECT * FROM symbols a WHERE a.id = 'part:40' AND a.package = s.package AND a.version = s.version AND a.name = s.name AND a.parent_id IS NOT DISTINCT FROM s.parent_id)")
def q5_overloads(s, d):
    return _plain(api.overloads(_given(s, d), "part:40"))


@query("q6_packages", "SELECT name, version FROM packages ORDER BY name, version")
def q6_packages(s, d):
    return api.packages(_given(s, d))


@query("q7_package_versions", "SELECT version FROM packages WHERE name = 'Brand#12' ORDER BY version")
def q7_package_versions(s, d):
    return api.package_versions(_saved(s, d), "Brand#12")


@query("q8_package_deps", "SELECT unnest(dependencies) AS dependency FROM packages WHERE name = 'Brand#12' AND version = '1.1.0' ORDER BY 1")
def q8_package_deps(s, d):
    return api.package_deps(_given(s, d), "Brand#12", "1.1.0")


@query("q9_source_packages", "SELECT DISTINCT source_package FROM symbols WHERE package = 'Brand#12' AND version = '1.1.0' ORDER BY 1")
def q9_source_packages(s, d):
    return api.source_packages(_given(s, d), "Brand#12", "1.1.0")


@query(
    "q10_active_package",
    """, i AS (SELECT DISTINCT p_brand AS name, concat('2.', CAST(p_size % 4 AS STRING), '.0') AS other, concat('1.', CAST(p_size % 4 AS STRING), '.0') AS version FROM part WHERE p_brand = 'Brand#12'),
       o AS (SELECT name, version, concat(CASE WHEN version = '1.2.0' THEN '/b' WHEN version = '1.3.0' THEN '/c' ELSE '/a' END, '/', version, '/', name) AS package_dir FROM i)
       SELECT o.name, o.version, package_dir, p.name IS NOT NULL AS is_indexed, row_number() OVER (ORDER BY CASE WHEN package_dir LIKE '/b%' THEN 0 WHEN package_dir LIKE '/a%' THEN 1 ELSE 2 END, package_dir) = 1 AS selected,
       CASE WHEN package_dir LIKE '/b%' THEN 0 WHEN package_dir LIKE '/a%' THEN 1 ELSE 2 END AS rank FROM o LEFT JOIN packages p USING (name, version)""",
)
def q10_active_package(s, d):
    version = F.concat(F.lit("1."), (F.col("p_size") % 4).cast("string"), F.lit(".0"))
    found = T(s, d, "part").select(F.col("p_brand").alias("name"), version.alias("version")).distinct()
    root = F.when(F.col("version") == "1.2.0", "/b").when(F.col("version") == "1.3.0", "/c").otherwise("/a")
    return api.active_package(found.withColumn("package_dir", F.concat_ws("/", root, "version", "name")), "Brand#12", ["/b", "/a"], _given(s, d))


@query("q11_symbols", f"SELECT {_HITS}, count(*) OVER () AS total, count(*) OVER () > 25 AS has_more FROM symbols WHERE package = 'Brand#12' AND version = '1.1.0' ORDER BY seq LIMIT 20 OFFSET 5")
def q11_symbols(s, d):
    return _plain(api.symbols(_given(s, d), "Brand#12", "1.1.0", limit=20, offset=5))


@query(
    "q12_evidence",
    """, a AS (SELECT 0 AS anchor, * FROM (SELECT id, signature, js_doc, row_number() OVER (ORDER BY is_internal, package, version, seq) AS n FROM symbols WHERE name = 'red plate' AND NOT is_internal)
             UNION ALL SELECT 1, * FROM (SELECT id, signature, js_doc, row_number() OVER (ORDER BY is_internal, package, version, seq) AS n FROM symbols WHERE name = 'blue ring' AND NOT is_internal)),
       kept AS (SELECT * FROM a WHERE n <= 4)
       SELECT row_number() OVER (ORDER BY anchor, n) AS place, id, signature, js_doc, CAST(NULL AS INTEGER) AS truncated_anchors FROM kept
       UNION ALL SELECT (SELECT count(*) FROM kept) + 1, NULL, NULL, NULL, CAST(count(DISTINCT anchor) AS INTEGER) FROM a WHERE n > 4 HAVING count(*) > 0""",
)
def q12_evidence(s, d):
    """Anchors with snippets; where an anchor has more, a last row says so."""
    found, snippets = api.evidence(_saved(s, d), ["red plate", "blue ring"], [], limit=4)
    rows = [(k, h["id"], snippets[h["id"]]["signature"], snippets[h["id"]]["js_doc"], None) if h["id"] else (k, None, None, None, h["truncated_anchors"]) for k, h in enumerate(found, 1)]
    return s.createDataFrame(rows, "place long, id string, signature string, js_doc string, truncated_anchors int")


@query("j1_symbols_of_packages", "SELECT p.name, p.version, p.symbols, s.id FROM packages p JOIN symbols s ON s.package = p.name AND s.version = p.version")
def j1_symbols_of_packages(s, d):
    return api.sql(_given(s, d), "SELECT p.name, p.version, p.symbols, s.id FROM packages p JOIN symbols s ON s.package = p.name AND s.version = p.version")


@query("a1_sql_capped", "SELECT name, count(*) AS n FROM symbols GROUP BY name ORDER BY n DESC, name LIMIT 9")
def a1_sql_capped(s, d):
    rows = api.sql(_given(s, d), "SELECT name, count(*) AS n FROM symbols GROUP BY name ORDER BY n DESC, name LIMIT 9", max_rows=9)
    return s.createDataFrame(rows, "name string, n long")


@query("f20_row_cap_fault", "SELECT 'more than 8 rows' AS fault")
def f20_row_cap_fault(s, d):
    try:
        lookup.capped(_tables(s, d)["symbols"], 8)
    except ValueError as fault:
        return s.createDataFrame([(str(fault),)], "fault string")
    return s.createDataFrame([], "fault string")


@query("a2_pending", "SELECT (SELECT count(*) FROM packages) AS pending, name AS next_name, version AS next_version FROM packages ORDER BY name, version LIMIT 1")
def a2_pending(s, d):
    """Packages that lag behind a pending revision, and which comes next."""
    c = _fresh(s, d)
    state = c.state()
    state.pending_backfill = 3
    c._publish(state)
    lagging = c.pending("k")
    following = lookup.top(lagging.select("name", "version"), ["name", "version"], 1)
    return lagging.agg(F.count("*").alias("pending")).join(F.broadcast(following.toDF("next_name", "next_version")))  # one row


@query("a14_cached_and_fresh", "SELECT count(*) FILTER (WHERE name < 'Brand#3') AS cached, count(*) FILTER (WHERE NOT name < 'Brand#3') AS missing FROM packages")
def a14_cached_and_fresh(s, d):
    """What of an install is indexed under a key, and what isn't."""
    c, packages = _fresh(s, d, "name < 'Brand#3'"), _tables(s, d)["packages"]
    missing = c.misses(packages, "k").agg(F.count("*").alias("missing"))
    return c.table("packages").agg(F.count("*").alias("cached")).join(F.broadcast(missing))  # one row


@query("m3_migrate_rebuild", "SELECT 0::BIGINT AS symbols, 2 AS applied")
def m3_migrate_rebuild(s, d):
    """Ordered steps above the stored version; a rebuild leaves no rows (M3)."""
    c = _fresh(s, d, "name < 'Brand#2'")
    state = c.state()
    state.schema_version = 1
    c._publish(state)
    applied = c.migrate([(1, "instant", None), (2, "rebuild", None), (3, "instant", None)])
    return c.table("symbols").agg(F.count("*").alias("symbols")).withColumn("applied", F.lit(len(applied)))


@query("m5_backfill_capped", "SELECT backfill_revision, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY name, version) <= 5 THEN 2 ELSE 0 END AS backfill_revision FROM packages) GROUP BY 1")
def m5_backfill_capped(s, d):
    """A drain that stops after some packages (M5, M6)."""
    c = _fresh(s, d)
    state = c.state()
    state.pending_backfill = 2
    c._publish(state)
    c.backfill({2: lambda df: df.withColumn("js_doc", F.lit("filled"))}, "k", most=5)
    return c.table("packages").groupBy("backfill_revision").agg(F.count("*").alias("n"))


@query("m8_vacuum", "SELECT count(*) AS symbols, true AS freed FROM symbols WHERE package <> 'Brand#12'")
def m8_vacuum(s, d):
    """Files that no state names go, the rest stays."""
    c = _fresh(s, d)
    c.delete(name="Brand#12")
    freed = c.vacuum() > 0
    return c.table("symbols").agg(F.count("*").alias("symbols")).withColumn("freed", F.lit(freed))


@query("k3_decorators", "SELECT package, version, id AS from_id, unnest([0, 1, 2])::INTEGER AS place, unnest(['Part', lower(package), 'Part']) AS name, unnest(['[]', '[\"' || name || '\"]', '[]']) AS arguments FROM symbols")
def k3_decorators(s, d):
    """Saved as a bag: the repeated one is kept."""
    one = lambda name, arguments: F.struct(name.alias("name"), arguments.alias("arguments"))
    tables, plain = _tables(s, d), one(F.lit("Part"), F.lit("[]"))
    c = catalog.Catalog(s, f"{iterate.shared_dir(s)}/quarry-catalog-{uuid.uuid4().hex}", buckets=8)
    names = [f.name for f in StructType.fromDDL(graph.SYMBOLS)]
    c.save(tables["packages"], tables["symbols"].select("seq", *names, F.array(plain, one(F.lower("package"), F.concat(F.lit('["'), "name", F.lit('"]'))), plain).alias("decorators")), "k")
    return c.table("symbol_decorators")


@query("k10_stdio", "SELECT 'packages' AS called, (SELECT count(*) FROM packages)::BIGINT AS rows, false AS failed UNION ALL SELECT 'sql', (SELECT count(DISTINCT name) FROM symbols), false UNION ALL SELECT 'write', 0, true")
def k10_stdio(s, d):
    """Three calls of the two tools, as a client's lines."""
    import io
    import json

    from quarry.plans import stdio

    calls = {"packages": ("query", {"command": "packages"}), "sql": ("sql", {"sql": "SELECT DISTINCT name FROM symbols", "max_rows": 100000}), "write": ("sql", {"sql": "DROP TABLE symbols"})}
    lines = [json.dumps({"jsonrpc": "2.0", "id": k, "method": "tools/call", "params": {"name": tool, "arguments": given}}) for k, (tool, given) in calls.items()]
    out = io.StringIO()
    stdio.serve(_given(s, d), lines, out)
    rows = []
    for answer in map(json.loads, out.getvalue().splitlines()):
        failed, text = answer["result"].get("isError", False), answer["result"]["content"][0]["text"]
        n = 0 if failed else len(json.loads(text)["data"]) if answer["id"] == "packages" else len(text.splitlines())
        rows.append((answer["id"], n, failed))
    return s.createDataFrame(rows, "called string, rows long, failed boolean")


# --- recipes over the catalog's views (R1-R7, J7, J8, J20) --------------------------------

_RECIPES = {
    "r1_members_of_class": "SELECT c.id AS class_id, m.id AS member FROM symbols c JOIN symbols m ON m.parent_id = c.id WHERE c.kind = 'ClassDeclaration'",
    "r2_uses_edges": "SELECT e.to_id, t.name FROM symbol_dependencies e LEFT JOIN symbols t ON t.id = e.to_id WHERE e.from_id = 'part:17'",
    "r3_surface": "SELECT id, name FROM symbols WHERE NOT is_internal AND package = (SELECT min(name) FROM packages)",
    "r4_siblings": "SELECT b.id FROM symbols a JOIN symbols b ON b.package = a.package AND b.name = a.name AND COALESCE(b.parent_id, '-') = COALESCE(a.parent_id, '-') WHERE a.id = 'part:40'",
    "r5_inherited": "SELECT i.from_id, i.source_id, s.kind FROM symbol_inherited_from i JOIN symbols s ON s.id = i.source_id",
    "r6_sweep": "SELECT id, name FROM symbols WHERE LOWER(name) IN ('red bolt', 'blue ring') OR name LIKE '%plate%' ORDER BY seq LIMIT 40",
    "r7_counts": "SELECT p.name, p.version, count(s.id) AS n FROM packages p LEFT JOIN symbols s ON s.package = p.name AND s.version = p.version AND s.seq < 900 GROUP BY p.name, p.version",
}
for _name, _sql in _RECIPES.items():
    query(_name, _sql)(lambda s, d, _sql=_sql: api.sql(_given(s, d), _sql))


@query("w8_repeated_columns", "SELECT n_name, n_name AS n_name__2, n_nationkey AS n_name__3 FROM nation")
def w8_repeated_columns(s, d):
    return guarded.read_only(s, "SELECT n_name, n_name, n_nationkey AS n_name FROM nation", {"nation": T(s, d, "nation")})


# --- printers (K5-K8) ---------------------------------------------------------------------


def _lines(s, text: str) -> DataFrame:
    return s.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


def _nations(s, d) -> list:
    return [r.asDict() for r in T(s, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows


@query("k5_envelope", "SELECT true AS ok, 'symbol' AS query, 'light' AS cost, 1 AS version, (SELECT count(*) FROM (SELECT * FROM symbols WHERE name = 'red plate' AND NOT is_internal LIMIT 20))::INTEGER AS hits")
def k5_envelope(s, d):
    out = api.envelope("symbol", lambda: api.symbol(_given(s, d), "red plate"))
    return s.createDataFrame([(out["ok"], out["meta"]["query"], out["meta"]["cost"], out["meta"]["envelopeVersion"], len(out["data"]))], "ok boolean, query string, cost string, version int, hits int")


@query("k6_tsv", "SELECT n_nationkey::BIGINT + 1 AS line, n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS text FROM nation UNION ALL SELECT 0, 'n_nationkey' || chr(9) || 'n_name' || chr(9) || 'n_regionkey'")
def k6_tsv(s, d):
    return _lines(s, api.printed(_nations(s, d), "tsv"))


@query("k6_jsonl", """SELECT n_nationkey::BIGINT AS line, '{"n_nationkey": ' || n_nationkey || ', "n_name": "' || n_name || '", "n_regionkey": ' || n_regionkey || '}' AS text FROM nation""")
def k6_jsonl(s, d):
    return _lines(s, api.printed(_nations(s, d)))


@query("k8_plain_hits", "SELECT row_number() OVER (ORDER BY package, version, seq) - 1 AS line, name || '  [' || kind || ']  ' || package || '@' || version || '  ' || file_path AS text FROM (SELECT * FROM symbols WHERE name = 'red plate' AND NOT is_internal ORDER BY package, version, seq LIMIT 5)")
def k8_plain_hits(s, d):
    return _lines(s, api.plain_hits([r.asDict() for r in api.symbol(_given(s, d), "red plate", limit=5).collect()]))


@query("s14_schema", "SELECT 'packages' AS name, 0::BIGINT AS place UNION ALL SELECT 'symbols', 1 UNION ALL SELECT 'symbol_dependencies', 2 UNION ALL SELECT 'symbol_surface_dependencies', 3 UNION ALL SELECT 'symbol_inherited_from', 4 UNION ALL SELECT 'symbol_additional_files', 5 UNION ALL SELECT 'symbol_heritage', 6 UNION ALL SELECT 'symbol_modifiers', 7 UNION ALL SELECT 'symbol_decorators', 8 UNION ALL SELECT 'package_dependencies', 9")
def s14_schema(s, d):
    return s.createDataFrame(list(enumerate(api.schema(_given(s, d)))), "place long, name string")


# --- reports of two engines (S17, K9, J17, J18, A20-A22, O12, U4, U5) ----------------------


def _reports(s, d) -> tuple[DataFrame, DataFrame]:
    """Written as reports and read again: all parts, and those under size 40 with a mark on some names."""
    from quarry.sources import reports

    rows, out = _tables(s, d)["symbols"], []
    for df in (rows, rows.where("CAST(since AS INT) < 40").withColumn("name", F.when(F.col("seq") % 9 == 0, F.concat("name", F.lit("#2"))).otherwise(F.col("name"))).withColumn("id", F.when(F.col("seq") % 9 == 0, F.concat("id", F.lit("#2"))).otherwise(F.col("id")))):
        own = F.struct("id", "name", F.col("kind").alias("kindName"), F.col("file_path").alias("filePath"))
        packages = df.groupBy("package", "version").agg(F.count("*").alias("totalSymbols"), F.count_distinct("file_path").alias("totalFiles"), F.collect_list(own).alias("symbols"))
        path = f"{iterate.shared_dir(s)}/quarry-report-{uuid.uuid4().hex}"
        reports.write(packages.select(F.array(F.struct("*")).alias("packages")), path)
        out.append(s.read.schema(reports.REPORT).json(path).select(F.explode("packages").alias("p")).select("p.package", "p.version", F.explode("p.symbols").alias("s")).select("package", "version", "s.id", "s.name", F.col("s.kindName").alias("kind"), F.col("s.filePath").alias("file_path")))
    return out[0], out[1]


_RIGHT = ", rgt AS (SELECT * REPLACE (CASE WHEN seq % 9 = 0 THEN name || '#2' ELSE name END AS name, CASE WHEN seq % 9 = 0 THEN id || '#2' ELSE id END AS id) FROM symbols WHERE since::INT < 40)"


@query("report_package_parity", f"""{_RIGHT}, l AS (SELECT package || '@' || version AS key, count(*) AS n FROM symbols GROUP BY 1), r AS (SELECT package || '@' || version AS key, count(*) AS n FROM rgt GROUP BY 1)
  SELECT key, l.n AS left_value, r.n AS right_value, CASE WHEN r.n IS NULL THEN 'left' WHEN l.n IS NULL THEN 'right' ELSE 'both' END AS side, coalesce(l.n, 0) - coalesce(r.n, 0) AS delta FROM l FULL JOIN r USING (key)""")
def report_package_parity(s, d):
    from quarry.sources import reports

    return reports.package_parity(*_reports(s, d))


@query("report_symbol_parity", f"""{_RIGHT}, l AS (SELECT regexp_extract(file_path, '[^/]*$') AS file, name, count(*) AS n FROM symbols GROUP BY 1, 2), r AS (SELECT regexp_extract(file_path, '[^/]*$') AS file, name, count(*) AS n FROM rgt GROUP BY 1, 2)
  SELECT file, name, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM l FULL JOIN r USING (file, name) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def report_symbol_parity(s, d):
    from quarry.sources import reports

    return reports.symbol_parity(*_reports(s, d))


@query("report_only_in", f"{_RIGHT} SELECT id, name, EXISTS (SELECT * FROM rgt WHERE split_part(rgt.name, '#', 1) = split_part(symbols.name, '#', 1)) AS has_name FROM symbols WHERE id NOT IN (SELECT id FROM rgt)")
def report_only_in(s, d):
    from quarry.sources import reports

    return reports.only_in(*_reports(s, d))


@query("report_kind_shares", "SELECT kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM symbols), 4) AS percent FROM symbols GROUP BY 1 ORDER BY n DESC, kind LIMIT 10")
def report_kind_shares(s, d):
    from quarry.sources import reports

    return reports.kind_shares(_tables(s, d)["symbols"])


@query("report_constraint_faults", "SELECT package, version, name AS id, count(*) AS n FROM symbols GROUP BY 1, 2, 3 HAVING count(*) > 1")
def report_constraint_faults(s, d):
    from quarry.sources import reports

    return reports.constraint_faults(_tables(s, d)["symbols"].drop("id").withColumnRenamed("name", "id"))


# --- hashes (X24, X25, O11) ---------------------------------------------------------------


@query(
    "x24_fingerprint",
    """WITH names AS (SELECT DISTINCT p_brand AS package, list_sort(list_distinct([lower(p_type), lower(p_name)])) AS stubs FROM part),
       bytes AS (SELECT package, stubs, list_transform(string_split(array_to_string(stubs, chr(10)), ''), lambda c: ascii(c)::UBIGINT) AS b FROM names)
       SELECT package, stubs, 'i7+' || printf('%x', list_reduce(list_prepend(14695981039346656037::UBIGINT, b), lambda h, x: ((xor(h, x)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)) AS cache_key FROM bytes""",
)
def x24_fingerprint(s, d):
    from quarry.functions import hashes

    keyed = F.udf(lambda stubs: hashes.cache_key(stubs, 7), "string")
    names = T(s, d, "part").select(F.col("p_brand").alias("package"), F.array_sort(F.array_distinct(F.array(F.lower("p_type"), F.lower("p_name")))).alias("stubs")).distinct()
    return names.withColumn("cache_key", keyed("stubs"))


@query("o11_seeded_shuffle", None)
def o11_seeded_shuffle(s, d):
    """The nations in the order of a seeded shuffle: a test holds it against a plain one."""
    from quarry.functions import hashes

    rows = [r["n_name"] for r in _nations(s, d)]
    return s.createDataFrame(list(enumerate(hashes.shuffled(rows, "seed:7"))), "place long, n_name string")


# --- statistics that need a pick ----------------------------------------------------------


@query("w3_name_picks", """SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN kind IN ('InterfaceDeclaration', 'TypeAliasDeclaration') THEN 0 WHEN kind = 'ClassDeclaration' THEN 1 ELSE 3 END,
  CASE WHEN kind IN ('InterfaceDeclaration', 'TypeAliasDeclaration') THEN -seq ELSE seq END) AS n FROM symbols) WHERE n = 1""")
def w3_name_picks(s, d):
    rows = _tables(s, d)["symbols"]
    return merge.picked(rows, ["name"], merge.name_order(F.col("kind"), F.col("seq"))).select("name", "id")


@query("f22_task_filter", "SELECT CAST(event_type AS VARCHAR) AS task_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def f22_task_filter(s, d):
    from quarry.operators import evaluation

    tasks = T(s, d, "events").select(F.col("event_type").alias("task_id"), "value")
    return evaluation.chosen(tasks, ["view", "click"]).groupBy("task_id").agg(F.count("*").alias("n"))
