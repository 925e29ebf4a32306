"""Scalar functions and predicates over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as X
from quarry.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}


def _select(name: str, source: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """Registers a projection of ``source``; ``columns`` makes the expressions once a session is there."""

    def query(spark, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*[c.alias(k) for k, c in columns().items()])

    QUERIES[name], ORACLE_SQL[name] = query, sql


_c = F.col
# NULL-free inputs with the shapes that the functions are about, made from the tables


def _dotted() -> Column:
    return F.replace(_c("p_name"), F.lit(" "), F.lit("."))


def _version() -> Column:
    return F.concat(F.lit("v"), _c("p_size").cast("string"), F.lit(".2-rc"))


def _path() -> Column:
    return F.regexp_replace(_c("url"), r"^https?://", "")


_SQL_PATH = "regexp_replace(url, '^https?://', '')"

_select(
    "x1_normalize_signature",
    "documents",
    r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS normalized FROM documents",
    lambda: {
        "doc_id": _c("doc_id"),
        "normalized": X.normalize_signature(_c("text")),
    },
)
_select(
    "x2_dedupe_key",
    "part",
    "SELECT p_partkey, p_type || '::' || p_name || '::' || p_size || '::' || trim(regexp_replace(p_brand, '\\s+', ' ', 'g')) AS dedupe_key FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "dedupe_key": X.dedupe_key(_c("p_type"), _c("p_name"), _c("p_size"), _c("p_brand")),
    },
)
_select(
    "x3_preview",
    "documents",
    r"SELECT doc_id, CASE WHEN length(t) > 320 THEN substr(t, 1, 320) || '...' WHEN t <> '' THEN t END AS preview FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)",
    lambda: {
        "doc_id": _c("doc_id"),
        "preview": X.preview(_c("text")),
    },
)
_select(
    "semver_parse",
    "part",
    "SELECT p_partkey, p_size::BIGINT AS major, 2::BIGINT AS minor, 0::BIGINT AS patch FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "major": X.since_semver(_version())["major"],
        "minor": X.since_semver(_version())["minor"],
        "patch": X.since_semver(_version())["patch"],
    },
)


def _strict() -> Column:
    return F.concat_ws(".", (_c("p_size") % 7).cast("string"), (_c("p_size") % 5).cast("string"), (_c("p_size") % 3).cast("string"))


_select(
    "x5_semver_compare",
    "part",
    "SELECT p_partkey, (p_size % 7, p_size % 5, p_size % 3) < (3, 2, 1) AS older FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "older": X.strict_semver(_strict()) < X.strict_semver(F.lit("v3.2.1")),
    },
)
_select(
    "x6_version_range",
    "part",
    "SELECT p_partkey, (p_size % 7 > 3 OR (p_size % 7 = 3 AND p_size % 5 >= 2)) AS met FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "met": X.in_version_range(_strict(), F.lit(">=3.2.9")),
    },
)


def _spec() -> Column:
    return F.concat(F.element_at(F.array(F.lit("@Scope/"), F.lit("./"), F.lit("node:"), F.lit("C:/"), F.lit(""), F.lit("https://x/")), (_c("p_size") % 6 + 1).cast("int")), _dotted(), F.lit("/sub/x"))


_SQL_SPEC = "(['@Scope/', './', 'node:', 'C:/', '', 'https://x/'])[p_size % 6 + 1]"
_select(
    "x7_package_root",
    "part",
    f"SELECT p_partkey, CASE WHEN {_SQL_SPEC} = '@Scope/' THEN lower('@Scope/' || replace(p_name, ' ', '.')) WHEN {_SQL_SPEC} = '' THEN lower(replace(p_name, ' ', '.')) END AS root FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "root": X.package_root(_spec()),
    },
)
_select(
    "x8_stub_roots",
    "part",
    "SELECT p_partkey, list_sort(list_distinct([lower(p_type), lower(p_brand)])) AS roots FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "roots": X.stub_roots(F.array(_c("p_type"), F.concat(_c("p_brand"), F.lit("/x")), F.upper("p_type"), F.lit(" "))),
    },
)
_select(
    "x9_outside_path",
    "part",
    "SELECT p_partkey, '__outside__' || repeat('/__up__', p_size % 4) || '/' || replace(p_name, ' ', '/') AS path FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "path": X.outside_path(F.concat(F.lit("./"), F.expr("repeat('../', p_size % 4)"), F.replace(_c("p_name"), F.lit(" "), F.lit("/")))),
    },
)
_select(
    "x9_package_relative",
    "part",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '/') ELSE '__outside__/__up__/other/' || replace(p_name, ' ', '/') END AS path FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "path": X.package_relative(F.concat(F.when(_c("p_size") % 2 == 0, "/a/own/").otherwise("/a/other/"), F.replace(_c("p_name"), F.lit(" "), F.lit("/"))), F.lit("/a/own")),
    },
)


def _owned() -> Column:
    return F.concat(F.when(_c("p_size") % 2 == 0, "__outside__/__up__/node_modules/@s/").otherwise("lib/"), F.replace(_c("p_name"), F.lit(" "), F.lit("/")))


def _identity() -> Column:
    return X.source_identity(F.lit("own"), F.lit("1.0.0"), _owned())


_select(
    "path_identity",
    "part",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '@s/' || split_part(p_name, ' ', 1) ELSE 'own' END AS owner,
       CASE WHEN p_size % 2 = 0 THEN NULL ELSE '1.0.0' END AS version,
       CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE 'lib/' || replace(p_name, ' ', '/') END AS path FROM part""",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "owner": _identity()["package"],
        "version": _identity()["version"],
        "path": _identity()["path"],
    },
)
_select(
    "x11_parent_dir",
    "pages",
    f"SELECT page_id, CASE WHEN contains({_SQL_PATH}, '/') THEN regexp_extract({_SQL_PATH}, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir FROM pages",
    lambda: {
        "page_id": _c("page_id"),
        "dir": X.parent_dir(_path()),
    },
)
_select(
    "x36_base_name",
    "pages",
    f"SELECT page_id, regexp_extract({_SQL_PATH}, '([^/]*)$', 1) AS name FROM pages",
    lambda: {
        "page_id": _c("page_id"),
        "name": X.base_name(_path()),
    },
)
_select(
    "dotted_parent_leaf",
    "part",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Base' ELSE split_part(p_name, ' ', 1) END AS parent, split_part(p_name, ' ', 2) AS leaf FROM part""",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "parent": X.dotted_parent(F.when(_c("p_size") % 3 == 0, F.concat(F.lit("Base.prototype."), F.substring_index("p_name", " ", -1))).otherwise(_dotted())),
        "leaf": X.leaf_name(_dotted()),
    },
)
_select(
    "x14_heritage_key",
    "part",
    "SELECT p_partkey, p_type AS base FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "base": X.heritage_key(F.concat(F.lit(" "), _c("p_type"), F.lit(" <"), _c("p_name"), F.lit(", 'k'>"))),
    },
)
_select(
    "x15_namespace_member",
    "part",
    "SELECT p_partkey, split_part(p_name, ' ', 1) AS qualifier, split_part(p_name, ' ', 2) || '.x' AS member FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "qualifier": X.namespace_member(F.concat(_dotted(), F.lit(".x")))["qualifier"],
        "member": X.namespace_member(F.concat(_dotted(), F.lit(".x")))["member"],
    },
)


def _module() -> Column:
    return F.element_at(F.array(F.lit("fs"), F.lit("node:path"), F.lit("bun://sqlite"), F.lit("./own"), F.lit("lodash")), (_c("p_size") % 5 + 1).cast("int"))


_select(
    "x16_external_id",
    "part",
    "SELECT p_partkey, (['node::fs::', 'node::path::', 'bun::sqlite::', NULL, NULL])[p_size % 5 + 1] || p_type AS id FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "id": X.external_id(_module(), _c("p_type")),
    },
)
_select(
    "g8_stub_id",
    "part",
    "SELECT p_partkey, (['node::fs::', 'node::path::', 'bun::sqlite::', NULL, 'npm::lodash::'])[p_size % 5 + 1] || p_type AS id FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "id": X.stub_id(_module(), _c("p_type")),
    },
)
_select(
    "g9_ambient_node_id",
    "part",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'node::NodeJS::' || p_type END AS id FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "id": X.ambient_node_id(F.concat(F.when(_c("p_size") % 2 == 0, "NodeJS.").otherwise("Other."), _c("p_type"))),
    },
)
_select(
    "x19_leading_modifiers",
    "part",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['public', 'static'] ELSE [] END AS modifiers FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "modifiers": X.leading_modifiers(F.concat(F.when(_c("p_size") % 2 == 0, " public static ").otherwise(""), _c("p_name"), F.lit(" readonly x"))),
    },
)


def _raw() -> Column:
    return F.when(_c("p_size") % 4 == 0, "true").when(_c("p_size") % 4 == 1, "false").when(_c("p_size") % 4 == 2, _c("p_name"))


_select(
    "x21_deprecation",
    "part",
    "SELECT p_partkey, p_size % 4 IN (0, 2) AS flag, CASE WHEN p_size % 4 = 2 THEN p_name END AS message FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "flag": X.deprecation_columns(_raw())["flag"],
        "message": X.deprecation_columns(_raw())["message"],
    },
)
_select(
    "json_fields",
    "events",
    "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, '[\"' || event_type || '\"]' AS kinds, [event_type] AS parsed FROM events",
    lambda: {
        "event_id": _c("event_id"),
        "k": X.first_number(_c("props"), ["missing", "k"]),
        "kinds": X.strings_to_json(F.array("event_type")),
        "parsed": X.strings_from_json(X.strings_to_json(F.array("event_type"))),
    },
)


def _kind() -> Column:
    return F.element_at(F.array(F.lit("FunctionDeclaration"), F.lit("ClassDeclaration"), F.lit("SetAccessor"), F.lit("Other")), (_c("p_size") % 4 + 1).cast("int"))


_select(
    "x23_kind_code",
    "part",
    "SELECT p_partkey, ([263, 264, 179, 0])[p_size % 4 + 1]::INT AS code FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "code": X.kind_code(_kind()),
    },
)
_select(
    "sha_digest16",
    "documents",
    "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents",
    lambda: {
        "doc_id": _c("doc_id"),
        "digest": X.digest16(_c("text")),
    },
)
_select(
    "x27_plain_terms",
    "pages",
    "SELECT page_id, nullif(array_to_string(regexp_extract_all(url, '[A-Za-z0-9_]+'), ' '), '') AS terms FROM pages",
    lambda: {
        "page_id": _c("page_id"),
        "terms": X.plain_terms(_c("url")),
    },
)
_select(
    "x29_fence_stripped",
    "events",
    "SELECT event_id, props AS body FROM events",
    lambda: {
        "event_id": _c("event_id"),
        "body": X.fence_stripped(F.when(_c("event_id") % 2 == 0, F.concat(F.lit("```json\n"), _c("props"), F.lit("\n```"))).otherwise(_c("props"))),
    },
)
_select(
    "x31_cost_label",
    "events",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'heavy' WHEN event_type = 'click' THEN 'moderate' ELSE 'light' END AS cost FROM events",
    lambda: {
        "event_id": _c("event_id"),
        "cost": X.cost_label(F.when(_c("event_type") == "view", "evidence").when(_c("event_type") == "click", "find").otherwise("sql")),
    },
)
_select(
    "x32_fill_tilt",
    "part",
    "SELECT p_partkey, round(least(1, greatest(0, (p_size - 10) / 30.0)), 6) AS ratio, round(pow(least(1, greatest(0, (p_size - 10) / 30.0)), 0.62) * 12, 6) AS tilt FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "ratio": F.round(X.fill_ratio(_c("p_size").cast("double"), 10.0, 40.0), 6),
        "tilt": F.round(X.tilt(X.fill_ratio(_c("p_size").cast("double"), 10.0, 40.0), 12.0), 6),
    },
)
_select(
    "f13_declaration_file",
    "part",
    "SELECT p_partkey, p_size % 2 = 0 AS declares FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "declares": X.is_declaration_file(F.concat(_dotted(), F.when(_c("p_size") % 2 == 0, ".d.mts").otherwise(".ts"))),
    },
)
_select(
    "f14_stub_membership",
    "part",
    "SELECT p_partkey, p_type IN ('ECONOMY', 'SMALL') AND p_type <> 'SMALL' AS stub FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "stub": X.is_stub(F.concat(_c("p_type"), F.lit("/x")), F.array(F.lit("economy"), F.lit("small")), F.lit("small")),
    },
)
_select(
    "f16_unshadowed",
    "part",
    "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN [p_type] ELSE [replace(p_name, ' ', '.'), p_type] END AS refs FROM part",
    lambda: {
        "p_partkey": _c("p_partkey"),
        "refs": X.unshadowed(F.array(_dotted(), _c("p_type")), F.array(F.lit("red"))),
    },
)


def _hash_suffix_base(spark, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.groupBy(X.before_hash(_c("p_brand")).alias("base"), F.substring_index("p_brand", "#", -1).alias("suffix")).agg(F.count("*").alias("n"))


QUERIES["hash_suffix_base"] = _hash_suffix_base
ORACLE_SQL["hash_suffix_base"] = "SELECT split_part(p_brand, '#', 1) AS base, split_part(p_brand, '#', -1) AS suffix, count(*) AS n FROM part GROUP BY 1, 2"


def _x33_chart_scale(spark, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    most = sums.agg(F.max("total").alias("most"))
    return sums.join(F.broadcast(most)).select("event_type", F.round(F.col("total") / F.when(F.col("most") != 0, F.col("most")), 6).alias("scale"))  # one row


QUERIES["x33_chart_scale"] = _x33_chart_scale
ORACLE_SQL["x33_chart_scale"] = "SELECT event_type, round(t / max(t) OVER (), 6) AS scale FROM (SELECT event_type, sum(value) AS t FROM events GROUP BY 1)"
_select(
    "x34_unix_seconds",
    "orders",
    "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders",
    lambda: {
        "o_orderkey": _c("o_orderkey"),
        "seconds": F.unix_timestamp(_c("o_orderdate").cast("timestamp")),
    },
)
