import json

import pytest
from pyspark.sql import functions as F

from quarry.plans import api, guarded
from quarry.sources import catalog as catalogs
from quarry.sources import declarations, graph, manifests, packages

ROOT = "/w/node_modules"
FILES = {
    f"{ROOT}/alpha/package.json": json.dumps({"name": "alpha", "version": "1.2.0", "types": "./index.d.ts", "dependencies": {"beta": "1"}, "peerDependencies": {"@s/gamma": "*"}}),
    f"{ROOT}/alpha/index.d.ts": """
/// <reference path="./globals.d.ts" />
import { Thing as T } from "beta";
import { Readable } from "node:stream";
export * from "./shapes";
export * as tools from "./tools.js";
export { hidden as shown } from "./tools.js";
export { missing } from "nowhere";
/** Makes one.
 * @since v1.1
 * @deprecated use make2 */
export declare function make<K extends string>(kind: K, of?: T, from?: Readable): Shape<K>;
export declare function make(kind: number): Shape;
interface Inner { a: Shape }
declare const config: { depth: number; deep: { er: Inner } };
export default config;
""",
    f"{ROOT}/alpha/globals.d.ts": "interface Window { alpha: number }\n",
    f"{ROOT}/alpha/shapes.d.ts": """
export interface Base { id: string; area(): number; _secret: 1 }
export interface Shape<K = string> extends Base { kind: K; area(): number }
export interface Shape { extra?: boolean }
export declare class Box extends Holder<Base> implements Base { static make(): Box; private x: number; id: string; area(): number }
export declare class Holder<V> { value: V; /** @internal */ hide(): void }
import "./tools.js";
""",
    f"{ROOT}/alpha/tools.d.ts": "import type { Shape } from './shapes';\nexport declare function hidden(s: Shape): void;\nexport declare namespace N { export const c: Shape; interface P { q: typeof c } }\n",
    f"{ROOT}/beta/package.json": json.dumps({"name": "beta", "version": "2.0.0", "exports": {".": [{"node": "./no.js"}, {"import": {"types": "./dist/main.d.mts"}}], "./package.json": "./package.json", "./f/*": {"types": "./dist/f/*.d.ts"}}}),
    f"{ROOT}/beta/dist/main.d.mts": "export interface Thing { t: 1 }\nexport type U = 'a' | `b${string}`;\n",
    f"{ROOT}/beta/dist/f/one.d.ts": "export const one: 1;\n",
    f"{ROOT}/beta/dist/f/deep/two.d.ts": "export const two: 2;\n",
    f"{ROOT}/@s/gamma/package.json": "{ not json",
    f"{ROOT}/npm/package.json": json.dumps({"name": "npm", "version": "1.0.0"}),
    f"{ROOT}/.bin/package.json": "{}",
    f"{ROOT}/bare/package.json": "{}",
    f"{ROOT}/bare/index.d.ts": "export declare let x: number, y: string;\n",
}


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


@pytest.fixture(scope="module")
def alpha():
    return {s["id"]: s for s in graph.build(FILES, f"{ROOT}/alpha")}


def test_scan(found):
    rows = {r.name: r for r in packages.scan(found).collect()}
    assert set(rows) == {"alpha", "beta", "bare"}
    assert rows["alpha"].dependencies == ["@s/gamma", "beta"] and rows["bare"].version == "0.0.0"
    assert packages.exact(packages.scan(found), "beta", "2.0.0").count() == 1
    with pytest.raises(LookupError):
        packages.exact(packages.scan(found), "beta", "9.9.9")


def test_entries():
    tree = manifests.Tree(FILES)
    beta = manifests.read_manifest(FILES[f"{ROOT}/beta/package.json"], "beta")
    entry = manifests.entry_of(tree, f"{ROOT}/beta", beta)
    assert entry.files == [f"{ROOT}/beta/dist/f/one.d.ts", f"{ROOT}/beta/dist/main.d.mts"]
    assert manifests.resolve(tree, "beta/f/one", f"{ROOT}/alpha/index.d.ts") == [f"{ROOT}/beta/dist/f/one.d.ts"]
    assert manifests.resolve(tree, "fs", "x") == ["fs"] and manifests.resolve(tree, "./absent", f"{ROOT}/alpha/index.d.ts") == []
    types = manifests.Manifest("m", "1", [], {"typesVersions": {"<4": {"*": ["old/*"]}, ">=4.0": {".": ["./new.d.ts"]}}})
    assert manifests.entry_of(manifests.Tree({"/m/new.d.ts": "", "/m/old/index.d.ts": ""}), "/m", types).files == ["/m/new.d.ts"]


def test_graph(alpha):
    p = "alpha@1.2.0::"
    make = alpha[f"{p}make"]
    assert make["since"] == "v1.1" and make["deprecated"] == "use make2" and make["js_doc"] == "Makes one."
    assert f"{p}make#2" in alpha
    assert f"{p}Shape" in make["dependencies"] and "node::stream::Readable" in make["dependencies"]
    assert any(d.endswith("::Thing") for d in make["dependencies"])
    shape = alpha[f"{p}Shape"]
    assert shape["signature"].count("\n") >= 1 and shape["merge_provenance"] == ["merge_scope"] and shape["heritage"] == ["Base"]
    assert alpha[f"{p}Shape.id"]["is_inherited"] and alpha[f"{p}Shape.id"]["inherited_from"] == [f"{p}Base.id"]
    assert f"{p}Shape._secret" not in alpha and not alpha[f"{p}Shape.area"]["is_inherited"]
    assert f"{p}Box.prototype.value" in alpha and f"{p}Box.prototype.hide" not in alpha and f"{p}Box.prototype.x" not in alpha
    assert alpha[f"{p}Box.make"]["modifiers"] == ["static"]
    assert alpha[f"{p}tools"]["kind"] == "ExportDeclaration" and alpha[f"{p}tools.hidden"]["re_exported_from"] == "index.d.ts"
    assert alpha[f"{p}shown"]["kind"] == "FunctionDeclaration"
    assert alpha[f"{p}missing"]["re_exported_from"] is None or alpha[f"{p}missing"]["file_path"] == "index.d.ts"
    assert alpha[f"{p}Shape.kind"]["parent_id"] == f"{p}Shape"
    assert alpha[f"{p}index.d.ts::Inner"]["is_internal"]
    assert f"{p}index.d.ts::config.deep.er" in alpha or f"{p}config.deep.er" in alpha
    n = next(s for s in alpha.values() if s["kind"] == "ModuleDeclaration" and s["name"].endswith("N"))
    assert n["surface_dependencies"]
    hops = graph.Package(FILES, f"{ROOT}/alpha", 0, ())
    hops.discover([f"{ROOT}/alpha/index.d.ts"])
    assert list(hops.parsed) == [f"{ROOT}/alpha/index.d.ts"]


def test_cycles_end():
    files = {"/p/package.json": '{"name":"p"}', "/p/index.d.ts": "export * from './b'; export type A = { b: B }; export interface X extends Y {} export interface Y extends X { m: 1 }", "/p/b.d.ts": "export * from './index'; export type B = { a: B & { c: 1 } };"}
    ids = {s["name"] for s in graph.build(files, "/p")}
    assert {"A", "B", "A.b", "B.a", "B.a.c", "X.m"} <= ids


def test_inherited_members_belong_to_the_heir():
    files = {
        "/p/package.json": '{"name":"p"}',
        "/p/index.d.ts": "import { Top } from './base.js';\nexport interface Mid extends Top { own: 1 }\nexport interface Low extends Mid { last(): void }\nexport * from './base.js';",
        "/p/base.d.mts": "export interface Top { shared: string }",
    }
    rows = {s["name"]: s for s in graph.build(files, "/p")}
    assert rows["Top.shared"]["parent_id"] == "p@0.0.0::Top" and not rows["Top.shared"]["is_inherited"]
    assert rows["Mid.shared"]["parent_id"] == "p@0.0.0::Mid" and rows["Mid.shared"]["inherited_from"] == ["p@0.0.0::Top.shared"]
    assert rows["Low.shared"]["parent_id"] == "p@0.0.0::Low" and rows["Low.own"]["parent_id"] == "p@0.0.0::Low"
    assert rows["Low.shared"]["file_path"] == "base.d.mts"  # reached through a specifier of a script


def test_imported_and_named_types_bring_their_members():
    files = {
        "/p/package.json": '{"name":"p"}',
        "/p/index.d.ts": """export type Far = import("./far.js").Remote;
export type Chain = import("./far.js").Outer.Leaf;
declare namespace NS { var box: typeof import("./far").Cls; interface Near { a: 1 } var near: Near }
export declare const box: typeof import("./far").Cls;
/**
 * About a class.
 *
 * More of it.
 */
export declare class Own { plain(): void; /** Told. */ told(): void }
export type Alias = Own;
""",
        "/p/far.d.ts": "export interface Remote { n: number }\nexport namespace Outer { export interface Leaf { flag: boolean } }\nexport declare class Cls { ping(): void }",
    }
    rows = {s["id"].removeprefix("p@0.0.0::"): s for s in graph.build(files, "/p")}
    far = rows["Far.n"]
    assert far["file_path"] == "far.d.ts" and far["additional_files"] == ["index.d.ts"] and far["entry_visibility"] == ["index.d.ts"] and far["parent_id"] == "p@0.0.0::Far"
    assert far["merge_provenance"] == ["merge_scope", "overload_key"]
    assert rows["box.ping"]["file_path"] == "far.d.ts" and rows["index.d.ts::NS.box.ping"]["parent_id"] == "p@0.0.0::index.d.ts::NS.box"
    assert not any(k.startswith(("Chain.", "index.d.ts::NS.near.")) for k in rows)
    assert rows["Own.prototype.plain"]["js_doc"] == "About a class.\nMore of it." and rows["Own.prototype.told"]["js_doc"] == "Told."
    assert rows["Alias.plain"]["kind"] == "MethodDeclaration"


def test_ambient_names_stand_for_runtime_modules():
    text = "declare namespace NodeJS { interface Timer extends events.EventEmitter {} interface Plain { a: 1 } }\nexport declare function wait(t: NodeJS.Timer, p: NodeJS.Plain, o: NodeJS.Other): void;"
    rows = {s["name"]: s for s in graph.build({"/p/package.json": '{"name":"p"}', "/p/index.d.ts": text}, "/p")}
    assert rows["wait"]["dependencies"] == ["node::NodeJS::Other", "node::NodeJS::Plain", "node::events::EventEmitter"]


def test_each_package_is_a_group_with_what_it_may_reach(spark):
    files = {
        "/w/node_modules/a/package.json": '{"name":"a","version":"1.0.0"}', "/w/node_modules/a/index.d.ts": "export * from 'b';\nexport * from '../c/extra';\nexport type A = 1;",
        "/w/node_modules/b/package.json": '{"name":"b","version":"1.0.0"}', "/w/node_modules/b/index.d.ts": "import type { D } from 'd';\nexport interface B { d: D }",
        "/w/node_modules/c/package.json": '{"name":"c","version":"1.0.0"}', "/w/node_modules/c/index.d.ts": "export type C = 1;", "/w/node_modules/c/extra.d.ts": "export type Extra = 2;",
        "/w/node_modules/b/node_modules/d/package.json": '{"name":"d","version":"2.0.0"}', "/w/node_modules/b/node_modules/d/index.d.ts": "export type D = 'inner';",
        "/w/node_modules/d/package.json": '{"name":"d","version":"1.0.0"}', "/w/node_modules/d/index.d.ts": "export type D = 'outer';",
        "/w/node_modules/@s/e/package.json": '{"name":"@s/e","version":"1.0.0"}', "/w/node_modules/@s/e/index.d.ts": "export { B as E } from 'b';",
    }
    found = spark.createDataFrame(list(files.items()), "path string, text string").repartition(5)
    want = sorted((s["id"], s["file_path"], tuple(s["dependencies"])) for folder in {p.rsplit("/", 1)[0] for p in files if p.endswith("package.json")} for s in graph.build(files, folder))
    got = packages.graphs(found)
    assert sorted((r.id, r.file_path, tuple(r.dependencies)) for r in got.collect()) == want
    leads = {tuple(r) for r in packages._wanted(found.withColumn("package_dir", packages.package_of(F.col("path")))).collect()}
    assert ("/w/node_modules/a", "/w/node_modules/c") in leads and ("/w/node_modules/b", "/w/node_modules/b/node_modules/d") in leads
    assert not any(x == "/w/node_modules/c" for x, _ in leads)


def test_stubs():
    out = {s["id"]: s for s in graph.build(FILES, f"{ROOT}/alpha", stubs=["beta"])}
    assert "npm::beta::Thing" in out["alpha@1.2.0::make"]["dependencies"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("export type A<T> = T extends (infer U)[] ? U : Other<T>;", {"Other"}),
        ("export type M<T> = { readonly [K in keyof T as Up<K>]?: T[K] };", {"Up"}),
        ("declare function f(this: Me, { a }: Opts, ...rest: Rest[]): x is Narrow;", {"Me", "Opts", "Rest", "Narrow"}),
        ("export type F = new <T extends C0>(a: T) => asserts a is D;", {"C0", "D"}),
        ("export type L = [first: A, second?: B, ...rest: C[]];", {"A", "B", "C"}),
        ("export type Tpl = `${Foo}-${bar.Baz}`;", {"Foo", "bar.Baz"}),
        ("export let v: typeof import('./m').q | unique symbol;", {"q"}),
        ("export type G = (A | B)[] & { [k: string]: C };", {"A", "B", "C"}),
    ],
)
def test_references(text, want):
    p = declarations.parse(text)
    assert p.skipped == 0 and {r.name for r in p.exports[0].references} == want


def test_directives_and_faults():
    assert declarations.directives("#!x\n// c\n/* b\n*/\n/// <reference path=\"a\" />\n/// <reference types='t' />\nx\n/// <reference path='b'/>") == (["a"], ["t"])
    p = declarations.parse("export type A = ;;\nexport interface B { x: 1 }\nexport type C = {{{")
    assert {"B", "B.x"} <= {e.name for e in p.exports} and p.skipped == 2
    assert declarations.parse("").exports == []


def test_parsed_rows(found):
    rows = packages.parsed(found)
    assert rows.where("name = 'make'").count() == 2
    assert packages.graphs(found).where("package = 'alpha'").count() == len(graph.build(FILES, f"{ROOT}/alpha"))


# --- catalog -----------------------------------------------------------------------------


@pytest.fixture
def filled(spark, found, tmp_path):
    c = catalogs.Catalog(spark, f"file:{tmp_path}/c", buckets=4)
    assert c.table("symbols").count() == 0
    c.save(packages.scan(found), packages.graphs(found), "i1+x")
    return c


def test_save_replaces_and_delete_cascades(spark, filled, found):
    n = filled.table("symbols").count()
    assert filled.status()["ok"] and n == filled.status()["symbols"]
    filled.save(packages.scan(found).where("name = 'beta'"), packages.graphs(found).where("package = 'beta'"), "i1+y")
    assert filled.table("symbols").count() == n
    assert {r.cache_key for r in filled.table("packages", package="beta").collect()} == {"i1+y"}
    assert [r.name for r in filled.misses(packages.scan(found), "i1+x").collect()] == ["beta"]
    assert filled.delete(glob="al*") == 1 and filled.table("symbols", package="alpha").count() == 0
    assert filled.status()["ok"] and filled.vacuum() > 0 and filled.status()["packages"] == 2
    with pytest.raises(PermissionError):
        filled.destroy()
    assert filled.destroy(force=True)


def test_second_writer_loses(spark, filled):
    state, other = filled.state(), filled.state()
    filled._publish(state)
    with pytest.raises(catalogs.Conflict):
        filled._publish(other)


def test_backfill(filled):
    state = filled.state()
    state.schema_version = 1
    filled._publish(state)
    assert filled.migrate([(1, "rebuild", None), (2, "instant", None), (3, "backfill", 2)]) == [2, 3] and filled.state().pending_backfill == 2
    assert filled.pending("i1+x").count() == 3
    steps = {1: lambda df: df.withColumn("since", F.lit("1.0")), 2: lambda df: df.withColumn("js_doc", F.lit("filled"))}
    assert filled.backfill(steps, "i1+x", most=1) == 1 and filled.pending("i1+x").count() == 2
    assert filled.backfill(steps, "i1+x") == 2 and filled.state().pending_backfill is None
    assert filled.table("symbols").where("js_doc <> 'filled' OR since <> '1.0'").count() == 0
    assert api.find(filled, "js_doc:filled", limit=500, internal=True).count() == filled.table("symbols").count()  # the text index follows


def test_newer_catalogs_are_refused(filled):
    state = filled.state()
    state.schema_version = 99
    filled._publish(state)
    with pytest.raises(RuntimeError):
        filled.state()


def test_commands(spark, filled, found):
    c = filled
    assert [r.name for r in api.symbol(c, "make").collect()] == ["make", "make"]
    assert api.overloads(c, "alpha@1.2.0::make").count() == 2
    assert api.show(c, "alpha@1.2.0::Box").first().kind == "ClassDeclaration" and api.show(c, "none").count() == 0
    assert api.snippet(c, "alpha@1.2.0::make").first().js_doc == "Makes one."
    assert [tuple(r) for r in api.packages(c).collect()] == [("alpha", "1.2.0"), ("bare", "0.0.0"), ("beta", "2.0.0")]
    assert [r.dependency for r in api.package_deps(c, "alpha", "1.2.0").collect()] == ["@s/gamma", "beta"]
    assert [r.version for r in api.package_versions(c, "beta").collect()] == ["2.0.0"]
    assert [r.source_package for r in api.source_packages(c, "alpha", "1.2.0").collect()] == ["alpha"]  # a flat install names no other
    page = api.symbols(c, "alpha", "1.2.0", limit=3).collect()
    assert len(page) == 3 and page[0].has_more and page[0].total > 3
    assert api.active_package(packages.scan(found), "beta", [ROOT], c).first().selected
    top = api.find(c, "make").collect()
    assert top[0].name == "make"
    assert {r.name for r in api.find(c, "js_doc:makes").collect()} == {"make"}
    assert api.find(c, "Foo.bar(").count() == 0 and api.find(c, "...").count() == 0
    hits, snippets = api.evidence(c, ["make", "make"], ["Shape"], limit=2)
    assert hits[-1].get("truncated_anchors") and len({h["id"] for h in hits}) == len(hits) and "alpha@1.2.0::make" in snippets
    assert api.sql(c, "SELECT count(*) AS n FROM symbol_dependencies WHERE from_id = 'alpha@1.2.0::make'").first().n >= 2
    assert len(api.sql(c, "SELECT name FROM symbols UNION SELECT name FROM packages", 500)) > 3
    with pytest.raises(ValueError):
        api.sql(c, "SELECT name FROM symbols", 1)
    with pytest.raises(guarded.Refused):
        api.sql(c, "DROP TABLE symbols")
    assert api.sql(c, "SELECT 1 AS x, 2 AS x").columns == ["x", "x__2"]
    assert "symbols" in api.schema(c)


@pytest.mark.parametrize(
    "bad",
    [
        "DROP TABLE symbols", "INSERT INTO symbols VALUES (1)", "CREATE TABLE t AS SELECT 1", "SET x = 1", "CACHE TABLE symbols",
        "WITH t AS (SELECT 7 AS a) INSERT INTO kept SELECT * FROM t", "FROM symbols INSERT INTO kept SELECT 7 INSERT INTO kept SELECT 8", "EXPLAIN INSERT INTO kept VALUES (7)",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT name FROM symbols WHERE name = (SELECT java_method('java.lang.System', 'lineSeparator'))",
        "SELECT * FROM parquet.`/tmp`", "SELECT 1 WHERE EXISTS (SELECT * FROM parquet.`/tmp`)", "SELECT name FROM symbols WHERE name IN (SELECT value FROM text.`/tmp`)", "WITH x AS (SELECT * FROM kept) SELECT * FROM x", "SELECT * FROM spark_catalog.default.kept",
    ],
)
def test_sql_only_reads(spark, bad):
    spark.sql("CREATE TABLE IF NOT EXISTS kept (a INT) USING parquet")
    views = {"symbols": spark.createDataFrame([("a",)], "name string")}
    with pytest.raises(guarded.Refused):
        guarded.read_only(spark, bad, views)
    assert spark.table("kept").count() == 0


def test_sql_reads_and_leaves_views_as_they_were(spark):
    own, given = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("a", 2), ("b", 3)], "name string, n int")
    own.createOrReplaceTempView("symbols")
    run = lambda text: guarded.read_only(spark, text, {"symbols": given, "other": given}).collect()
    assert [tuple(r) for r in run("WITH t AS (SELECT max(n) AS m FROM Symbols) SELECT name FROM symbols, t WHERE n = m;")] == [("b",)]
    assert run("SELECT (SELECT count(*) FROM other) AS n, s.name FROM symbols s JOIN LATERAL (SELECT s.n + 1 AS k) ORDER BY ALL")[1].n == 2
    assert len(run("SELECT * FROM range(3) UNION ALL SELECT n FROM symbols GROUP BY n HAVING n > 2")) == 4
    assert len(run("EXPLAIN SELECT name FROM symbols")) == 1
    assert len(run("SELECT name FROM symbols WHERE n IN (SELECT max(n) FROM other) AND n NOT IN (SELECT 7)")) == 1
    assert spark.table("symbols").columns == ["a"] and not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("symbols")


def test_output():
    rows = [{"a": "x\ty\nz", "b": b"\x01\xff", "c": float("nan")}]
    assert api.printed(rows, "tsv") == "a\tb\tc\nx y z\thex:01ff\tnan"
    assert json.loads(api.printed(rows)) == {"a": "x\ty\nz", "b": "hex:01ff", "c": "nan"}
    assert api.printed([], "json") == "[]"
    good = api.envelope("symbol", lambda: [1])
    assert good["ok"] and good["meta"]["cost"] == "light"
    assert api.envelope("find", lambda: [][0])["ok"] is False
    assert api.suggestions("find", 800, 0) == ["symbol", "evidence"] and api.suggestions("find", 10, 0) == []


# --- size ----------------------------------------------------------------------------------


def _copies(n):
    texts = {"pkg/package.json": '{"name":"pkg","version":"1.0.0"}', "pkg/index.d.ts": "import { U } from 'lib';\nexport interface A { u: U }", "lib/package.json": '{"name":"lib"}', "lib/index.d.ts": "export type U = 1;"}
    return [{f"/w{k}/node_modules/{p}": t for p, t in texts.items()} for k in range(n)]


def test_small_texts_are_parsed_once_and_lists_are_the_callers_own(monkeypatch):
    made, real = [], declarations._File
    monkeypatch.setattr(declarations, "_File", lambda text: made.append(text) or real(text))
    text = "export interface ParsedOnce { x: Y }\nimport { Y } from 'y';"
    first = declarations.parse(text)
    first.exports.clear()
    first.imports.clear()
    assert declarations.parse(text) == real(text).parse() and made == [text]
    long = text + "\n" * declarations.KEPT
    assert declarations.parse(long) == declarations.parse(long) and len(made) == 3


def test_declarations_are_parsed_on_all_cores_whatever_the_files(spark, tmp_path):
    from quarry.plans import ingest_queries

    rows = [(k, f"red{'x' * (k % 3)} bolt", 7, "SMALL") for k in range(50)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = ingest_queries._files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(tuple(r) for r in ingest_queries.QUERIES["s6_directives"](spark, str(tmp_path)).collect()) == [(k, ["./globals.d.ts"]) for k, *_ in rows]
    # rows of many files, some equal, stay beside their own paths
    plain = sorted((r.path, k, e.name) for r in found.where("path LIKE '%.d.ts'").collect() for k, e in enumerate(declarations.parse(r.text).exports))
    assert sorted((r.path, r.seq, r.name) for r in packages.parsed(found).collect()) == plain


def test_copies_of_a_package_are_built_once(monkeypatch):
    made, real = [], graph.build
    monkeypatch.setattr(graph, "build", lambda *a: made.append(a[1]) or real(*a))
    monkeypatch.setattr(graph, "_trees", graph.Kept(1 << 20))
    trees = _copies(3)
    for k, files in enumerate(trees):
        assert graph.table(files, f"/w{k}/node_modules/pkg").to_pylist() == real(files, f"/w{k}/node_modules/pkg", 10, ())
    assert made == ["/w0/node_modules/pkg"]
    # other depth, other stubs, another text, the root's name in a text, a file outside of the root: each on its own
    others = [(trees[1], 0, ()), (trees[1], 10, ("lib",))]
    for more in ({"/w1/node_modules/pkg/index.d.ts": "export type A = 2;"}, {"/w1/node_modules/pkg/index.d.ts": "export * from '/w1/node_modules/lib/index';"}, {"/x/node_modules/y/index.d.ts": ""}):
        others.append(({**trees[1], **more}, 10, ()))
    for files, hops, stubs in others:
        assert graph.table(files, "/w1/node_modules/pkg", hops, stubs).to_pylist() == real(files, "/w1/node_modules/pkg", hops, stubs)
    assert len(made) == 1 + len(others)


def test_kept_rows_are_bounded(monkeypatch):
    kept = graph.Kept(5 * graph.EACH)
    one = graph.table(_copies(1)[0], "/w0/node_modules/pkg").slice(0, 0)
    for k in range(20):
        kept.get(bytes([k]), lambda: one)
    assert len(kept.made) <= 5 and kept.held <= kept.most


def test_package_texts_are_never_broadcast(spark, tmp_path):
    files = [f for tree in _copies(30) for f in tree.items()]
    spark.createDataFrame(files, "path string, text string").write.parquet(f"{tmp_path}/files")  # its size is known, and small
    out = packages.graphs(spark.read.parquet(f"{tmp_path}/files"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and out.where("package = 'pkg'").count() == 30 * 3
