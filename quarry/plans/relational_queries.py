"""Lookups, filters, joins, aggregations, windows and sets over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as X
from quarry.operators import globs, lookup, merge, stats
from quarry.plans.tables import table as T

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# --- lookups (Q2-Q11, O2-O5, J1, J3, J5) -------------------------------------------------


@query("exact_name", "SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM part WHERE p_name = 'red plate' AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 20")
def exact_name(s, d):
    rows = lookup.exact_name(T(s, d, "part"), "p_name", "red plate", ["p_partkey"], 20, equals={"p_brand": None, "p_type": "ECONOMY"})
    return rows.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")


@query("show_by_id", "SELECT * FROM documents WHERE doc_id = 17 ORDER BY doc_id LIMIT 1")
def show_by_id(s, d):
    return lookup.first_of(T(s, d, "documents"), "doc_id", 17, "doc_id")


@query("snippet_by_id", r"SELECT doc_id, lang, CASE WHEN length(t) > 320 THEN substr(t, 1, 320) || '...' WHEN t <> '' THEN t END AS snippet FROM (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE doc_id = 23)")
def snippet_by_id(s, d):
    return lookup.first_of(T(s, d, "documents"), "doc_id", 23, "doc_id").select("doc_id", "lang", X.preview(F.col("text")).alias("snippet"))


@query("overload_siblings", "SELECT o.* FROM orders o JOIN (SELECT o_custkey c, o_orderpriority p FROM orders WHERE o_orderkey = 5) a ON o.o_custkey IS NOT DISTINCT FROM a.c AND o.o_orderpriority IS NOT DISTINCT FROM a.p")
def overload_siblings(s, d):
    return lookup.siblings(T(s, d, "orders"), "o_orderkey", 5, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("list_packages", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2")
def list_packages(s, d):
    return T(s, d, "part").select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type")


@query("package_versions", "SELECT DISTINCT p_type FROM part WHERE p_brand = 'Brand#12' ORDER BY 1")
def package_versions(s, d):
    return T(s, d, "part").where("p_brand = 'Brand#12'").select("p_type").distinct().orderBy("p_type")


@query("package_deps", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY n_name")
def package_deps(s, d):
    return T(s, d, "nation").join(T(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").orderBy("n_name")


@query("source_packages", "SELECT DISTINCT o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' ORDER BY 1")
def source_packages(s, d):
    customers = T(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return T(s, d, "orders").join(customers, "o_custkey", "left_semi").select("o_orderpriority").distinct().orderBy("o_orderpriority")


@query(
    "symbols_page",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT count(*) FROM lineitem) AS total, (SELECT count(*) FROM lineitem) > 150 AS has_more
       FROM lineitem ORDER BY 1, 2, 3, 4 LIMIT 100 OFFSET 50""",
)
def symbols_page(s, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return lookup.page(T(s, d, "lineitem").select(*keys), keys, 100, 50)


@query("active_package", "SELECT p_name, p_partkey, p_type, n = 1 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS n FROM part WHERE p_brand = 'Brand#4') WHERE n <= 2")
def active_package(s, d):
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_size", "p_partkey"))
    return T(s, d, "part").where("p_brand = 'Brand#4'").withColumn("n", n).where("n <= 2").select("p_name", "p_partkey", "p_type", (F.col("n") == 1).alias("selected"))


# --- filters (F1-F24) --------------------------------------------------------------------


@query("f1_hit_projection", "SELECT o_orderkey, c_name, o_orderpriority, c_name AS source_name, c_mktsegment AS source_segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def f1_hit_projection(s, d):
    o, c = T(s, d, "orders").where("o_orderstatus = 'F'"), T(s, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_orderpriority", F.col("c_name").alias("source_name"), F.col("c_mktsegment").alias("source_segment"))


@query("optional_filters", "SELECT d.doc_id, d.lang, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0 WHERE d.lang = 'de' AND d.text ILIKE '%und%'")
def optional_filters(s, d):
    clean = T(s, d, "labels").where("toxic = 0").select("doc_id")
    docs = lookup.optional_filters(T(s, d, "documents"), equals={"lang": "de", "source": None}, contains={"text": "und"})
    return docs.join(clean, "doc_id").select("doc_id", "lang", "source")


@query("like_contains", "SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%SUPPLIER#0000_001%'")
def like_contains(s, d):
    return lookup.optional_filters(T(s, d, "supplier"), contains={"s_name": "SUPPLIER#0000_001"}).select("s_suppkey", "s_name")


@query("f4_public_only", "SELECT l.doc_id FROM labels l WHERE l.toxic = 0")
def f4_public_only(s, d):
    return lookup.optional_filters(T(s, d, "labels"), public=~(F.col("toxic") == 1)).select("doc_id")


@query("f6_in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")
def f6_in_list(s, d):
    wanted = T(s, d, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.in_chunks(T(s, d, "orders"), ["o_custkey"], wanted).select("o_orderkey")


@query("f7_row_value_in", "SELECT p_partkey FROM part WHERE (p_brand, p_type) IN (SELECT p_brand, p_type FROM part WHERE p_size = 7)")
def f7_row_value_in(s, d):
    parts = T(s, d, "part")
    return lookup.in_chunks(parts, ["p_brand", "p_type"], parts.where("p_size = 7")).select("p_partkey")


@query("glob_filter", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB 're? [a-p]*t'")
def glob_filter(s, d):
    return T(s, d, "part").where(globs.glob(F.col("p_name"), "re? [a-p]*t")).select("p_partkey", "p_name")


@query(
    "mini_glob",
    """SELECT p_partkey, starts_with(p_name, 'red') AS prefix, ends_with(p_name, 'bolt') AS suffix, starts_with(p_name, 'blue') AND ends_with(p_name, 'ring') AS both_ends,
       contains(p_name, 'e') AND contains(p_name, 'w') AS pieces, true AS everything, false AS stars FROM part""",
)
def mini_glob(s, d):
    c = F.col("p_name")
    globbed = {"prefix": "red*", "suffix": "*bolt", "both_ends": "blue*ring", "pieces": "*w*e*", "everything": "*", "stars": "**"}
    return T(s, d, "part").select("p_partkey", *[globs.mini_glob(c, p).alias(k) for k, p in globbed.items()])


@query("ignore_rules", "SELECT p_partkey, p_name FROM part WHERE NOT ((starts_with(p_name, 'red') AND p_name <> 'red plate') OR p_name = 'blue ring')")
def ignore_rules(s, d):
    rules = globs.ignore_rules("# comment\nred*\n\n!red plate\nblue ring\n")
    return T(s, d, "part").where(~globs.ignored(F.col("p_name"), rules)).select("p_partkey", "p_name")


@query(
    "f9_package_filter",
    """SELECT p_partkey, p_name FROM part WHERE (contains(p_name, 'r')) AND p_type IN (SELECT p_type FROM part WHERE p_size = 1)
       AND NOT starts_with(p_name, 'red') AND NOT ends_with(p_name, 'bolt')""",
)
def f9_package_filter(s, d):
    parts = T(s, d, "part")
    kept = globs.package_filter(parts, "p_name", include_globs=["*r*"], rules=globs.ignore_rules("red*"), exclude_globs=["*bolt"])
    return globs.allowed(kept, "p_type", parts.where("p_size = 1").select(F.col("p_type").alias("name"))).select("p_partkey", "p_name")


@query("f15_builtin_sets", "SELECT p_partkey, p_size % 3 = 0 AS builtin, p_size % 3 = 1 AS runtime FROM part")
def f15_builtin_sets(s, d):
    from quarry.functions import fixed

    name = F.when(F.col("p_size") % 3 == 0, "Promise").when(F.col("p_size") % 3 == 1, "zlib").otherwise(F.col("p_name"))
    return T(s, d, "part").select("p_partkey", name.isin(*fixed.BUILTIN_TYPES).alias("builtin"), name.isin(*fixed.NODE_MODULES).alias("runtime"))


@query("f17_kind_hint", "SELECT p_partkey FROM part WHERE p_size % 3 = 2 OR (p_size % 3 = 0 AND p_size % 4 IN (0, 1)) OR (p_size % 3 = 1 AND p_size % 4 IN (1, 2, 3))")
def f17_kind_hint(s, d):
    size = F.col("p_size")
    hint = F.when(size % 3 == 0, "value").when(size % 3 == 1, "type")
    kind = F.element_at(F.array(F.lit("FunctionDeclaration"), F.lit("ClassDeclaration"), F.lit("InterfaceDeclaration"), F.lit("PropertySignature")), (size % 4 + 1).cast("int"))
    return T(s, d, "part").where(merge.hint_allows(kind, hint)).select("p_partkey")


@query("f18_preferred_inner", "SELECT p_partkey, p_name FROM (SELECT *, max((p_size > 25)::INT) OVER (PARTITION BY p_name, p_type) AS m FROM part) WHERE m = 0 OR p_size > 25")
def f18_preferred_inner(s, d):
    explicit = F.col("p_size") > 25
    return T(s, d, "part").withColumn("any", F.max(explicit).over(Window.partitionBy("p_name", "p_type"))).where(~F.col("any") | explicit).select("p_partkey", "p_name")


@query("f20_row_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 11")
def f20_row_cap(s, d):
    return T(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(10 + 1)


@query(
    "verifier",
    """SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AND NOT contains(lower(text), 'idiot') AS correct,
       list_filter([CASE WHEN NOT contains(lower(text), 'the') THEN 'the' END, CASE WHEN NOT contains(lower(text), 'and') THEN 'AND' END], lambda x: x IS NOT NULL) AS missing,
       list_filter([CASE WHEN contains(lower(text), 'idiot') THEN 'idiot' END], lambda x: x IS NOT NULL) AS found FROM documents""",
)
def verifier(s, d):
    v = stats.verified(F.col("text"), ["the", "AND"], ["idiot"])
    return T(s, d, "documents").select("doc_id", v["correct"].alias("correct"), v["missing"].alias("missing"), v["found"].alias("found"))


@query("f23_skip_reasons", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 5 THEN 'short' WHEN user_id % 2 = 0 THEN 'even' END AS reason FROM events")
def f23_skip_reasons(s, d):
    reason = stats.first_reason([(F.col("event_type") == "error", "failed"), (F.col("value") < 5, "short"), (F.col("user_id") % 2 == 0, "even")])
    return T(s, d, "events").select("event_id", reason.alias("reason"))


@query(
    "f24_pair_eligibility",
    """SELECT user_id, CASE WHEN v IS NULL THEN 'no_baseline' WHEN p IS NULL THEN 'no_treatment' WHEN v = 0 THEN 'empty_baseline' END AS reason
       FROM (SELECT user_id, min(CASE WHEN event_type = 'view' THEN value END) AS v, min(CASE WHEN event_type = 'purchase' THEN value END) AS p FROM events GROUP BY 1)""",
)
def f24_pair_eligibility(s, d):
    pick = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("value")))
    arms = T(s, d, "events").groupBy("user_id").agg(pick("view").alias("v"), pick("purchase").alias("p"))
    return arms.select("user_id", stats.first_reason([(F.col("v").isNull(), "no_baseline"), (F.col("p").isNull(), "no_treatment"), (F.col("v") == 0, "empty_baseline")]).alias("reason"))


# --- joins (J1-J21) ----------------------------------------------------------------------


@query("j1_equi_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_equi_join(s, d):
    return T(s, d, "orders").join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(
    "union_tagged_children",
    """SELECT user_id, event_type AS branch, list_sort(list(event_id)) AS ids FROM events JOIN customer ON user_id = c_custkey WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2""",
)
def union_tagged_children(s, d):
    events = T(s, d, "events").join(T(s, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")
    branches = {k: events.where(F.col("event_type") == k).select("user_id", "event_id") for k in ("view", "click", "error")}
    return lookup.union_tagged(branches).groupBy("user_id", "branch").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("j6_snippet_attach", "SELECT o_orderkey, c_name AS snippet FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def j6_snippet_attach(s, d):
    snippets = T(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("snippet"))
    return T(s, d, "orders").join(snippets, "o_custkey", "left").select("o_orderkey", "snippet")


@query("left_count_keep_empty", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_count_keep_empty(s, d):
    counts = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))  # counted before the join
    return T(s, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("edge_walk", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def edge_walk(s, d):
    lines = T(s, d, "lineitem")
    return lines.join(T(s, d, "part"), lines.l_partkey == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("dangling_edges", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def dangling_edges(s, d):
    known = T(s, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return T(s, d, "lineitem").select("l_partkey").distinct().join(known, "l_partkey", "left_anti")


@query(
    "tiered_resolution",
    """WITH refs AS (SELECT DISTINCT p_name AS ref FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'absent'),
       hits AS (SELECT ref, p_partkey, 1 AS tier FROM refs JOIN part ON p_name = ref AND p_size < 9 UNION ALL SELECT ref, p_partkey, 2 FROM refs JOIN part ON p_type = ref AND p_size < 3
                UNION ALL SELECT ref, p_partkey, 3 FROM refs JOIN part ON p_brand = ref UNION ALL SELECT ref, NULL, 9 FROM refs)
       SELECT ref, p_partkey, tier FROM (SELECT *, min(tier) OVER (PARTITION BY ref) AS m FROM hits) WHERE tier = m""",
)
def tiered_resolution(s, d):
    parts = T(s, d, "part")
    refs = parts.select(F.col("p_name").alias("ref")).union(parts.select("p_type")).union(parts.select("p_brand")).union(s.range(1).select(F.lit("absent"))).distinct()
    hits = [
        refs.join(parts.where("p_size < 9"), F.col("ref") == F.col("p_name")).select("ref", "p_partkey", F.lit(1).alias("tier")),
        refs.join(parts.where("p_size < 3"), F.col("ref") == F.col("p_type")).select("ref", "p_partkey", F.lit(2).alias("tier")),
        refs.join(parts, F.col("ref") == F.col("p_brand")).select("ref", "p_partkey", F.lit(3).alias("tier")),
        refs.select("ref", F.lit(None).cast("long").alias("p_partkey"), F.lit(9).alias("tier")),  # the stub
    ]
    return merge.first_tier(hits[0].union(hits[1]).union(hits[2]).union(hits[3]), ["ref"], "tier")


@query(
    "ranked_parent",
    """SELECT o_custkey, o_orderkey AS parent FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 5 END, o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def ranked_parent(s, d):
    rank = merge.ranked(F.col("o_orderstatus"), ["F", "O"])
    return T(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(rank, "o_orderkey")).alias("parent"))


@query("j11_enclosing_module", "SELECT c_custkey, min(s_suppkey) AS module FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def j11_enclosing_module(s, d):
    modules = T(s, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("module"))
    return T(s, d, "customer").join(modules, "c_nationkey").select("c_custkey", "module")


@query("j12_first_binding", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def j12_first_binding(s, d):
    return T(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("j13_named_reexport", "SELECT p_partkey, coalesce(s_name, 'stub::' || p_name) AS target FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def j13_named_reexport(s, d):
    named = T(s, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return T(s, d, "part").join(named, "p_partkey", "left").select("p_partkey", F.coalesce("s_name", F.concat(F.lit("stub::"), "p_name")).alias("target"))


@query("j14_prefix_members", "SELECT a.n AS alias, b.p_partkey AS member FROM (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS n FROM part) a JOIN part b ON a.p_brand = b.p_brand AND starts_with(b.p_name, a.n || ' ')")
def j14_prefix_members(s, d):
    parts = T(s, d, "part")
    aliases = parts.select("p_brand", F.substring_index("p_name", " ", 1).alias("alias")).distinct()
    hit = parts.join(aliases, "p_brand").where(F.col("p_name").startswith(F.concat("alias", F.lit(" "))))
    return hit.select("alias", F.col("p_partkey").alias("member"))


@query(
    "j15_directory_roots",
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1)) AS path FROM pages), r AS (SELECT DISTINCT '/' || lang AS root FROM documents)
       SELECT page_id, root FROM p JOIN r ON path = root OR starts_with(path, root || '/')""",
)
def j15_directory_roots(s, d):
    path = F.lower(F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1))
    pages = T(s, d, "pages").select("page_id", path.alias("path"))
    roots = T(s, d, "documents").select(F.concat(F.lit("/"), "lang").alias("root")).distinct()
    # every folder above a path is a key: an equi-join in place of a prefix test on all pairs
    steps = F.split("path", "/")
    above = pages.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    return above.join(roots, "root").select("page_id", "root").distinct()


@query("j16_semi", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j16_semi(s, d):
    return T(s, d, "customer").select("c_custkey").join(T(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j17_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j17_anti(s, d):
    return T(s, d, "customer").select("c_custkey").join(T(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "full_outer_parity",
    """SELECT coalesce(a.k, b.k) AS nation, a.n AS left_value, b.n AS right_value, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta
       FROM (SELECT c_nationkey k, count(*) n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey k, count(*) n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k""",
)
def full_outer_parity(s, d):
    a = T(s, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = T(s, d, "supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return stats.one_sided(a, b, "nation", "n")


@query("j19_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def j19_scalar_subquery(s, d):
    orders = T(s, d, "orders")
    bound = orders.agg((F.avg("o_totalprice") * 1.9).alias("bound"))
    return orders.join(F.broadcast(bound), F.col("o_totalprice") > F.col("bound")).select("o_orderkey", "o_totalprice")  # one row


@query("j20_containment", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def j20_containment(s, d):
    return T(s, d, "region").join(T(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query(
    "pairwise_deltas",
    """WITH p AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN value END) AS b, min(CASE WHEN event_type = 'purchase' THEN value END) AS t FROM events GROUP BY 1)
       SELECT count(*) AS pairs, round(avg(t - b), 6) AS mean_delta, count(*) FILTER (t > b) AS treatment_wins, count(*) FILTER (t < b) AS baseline_wins, count(*) FILTER (t = b) AS ties,
              round(avg(b), 6) AS mean_baseline, round(avg(t), 6) AS mean_treatment FROM p WHERE b IS NOT NULL AND t IS NOT NULL""",
)
def pairwise_deltas(s, d):
    pairs = stats.paired(T(s, d, "events"), ["user_id"], "event_type", "view", "purchase", "value")
    out = stats.pairwise(pairs, "baseline", "treatment")
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


# --- aggregations (A1-A23) ---------------------------------------------------------------


@query("a1_count", "SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#12'")
def a1_count(s, d):
    return T(s, d, "part").where("p_brand = 'Brand#12'").agg(F.count("*").alias("n"))


@query("a2_pending_count", "SELECT p_brand, count(*) AS pending FROM part WHERE p_size < 10 GROUP BY 1")
def a2_pending_count(s, d):
    return T(s, d, "part").where("p_size < 10").groupBy("p_brand").agg(F.count("*").alias("pending"))


@query("a4_batch_bound", "SELECT max(o_orderkey) AS bound FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500)")
def a4_batch_bound(s, d):
    return T(s, d, "orders").where("o_orderkey > 100").select("o_orderkey").orderBy("o_orderkey").limit(500).agg(F.max("o_orderkey").alias("bound"))


@query("a5_group_counts", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def a5_group_counts(s, d):
    return T(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query(
    "merge_provenance",
    r"""WITH k AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, * FROM documents)
       SELECT min(doc_id) AS doc_id, count(*) AS declarations, arg_min(lang, doc_id) AS lang, list_sort(list_distinct(list(source))) AS sources, bool_or(n_chars > 4000) AS long FROM k GROUP BY t""",
)
def merge_provenance(s, d):
    docs = T(s, d, "documents").withColumn("key", F.sha2(X.normalize_signature(F.col("text")), 256)).withColumn("long", F.col("n_chars") > 4000).withColumnRenamed("source", "sources")
    out = merge.merged(docs, "key", "doc_id", "text", "lang", any_of=["long"], sets=["sources"])
    return out.select("doc_id", "declarations", "lang", "sources", "long")


@query(
    "a7_declaration_merge",
    """WITH s AS (SELECT p_name, p_brand, p_type, min(p_partkey) AS q FROM part GROUP BY 1, 2, 3), g AS (SELECT p_name, p_brand, string_agg(p_type, chr(10) ORDER BY q) AS p_type FROM s GROUP BY 1, 2)
       SELECT p_name || '::' || p_brand AS key, min(p_partkey) AS p_partkey, count(*) AS declarations, any_value(g.p_type) AS p_type, max(p_size) > 40 AS big FROM part JOIN g USING (p_name, p_brand) GROUP BY 1""",
)
def a7_declaration_merge(s, d):
    parts = T(s, d, "part").withColumn("key", F.concat_ws("::", "p_name", "p_brand")).withColumn("big", F.col("p_size") > 40)
    out = merge.merged(parts, "key", "p_partkey", "p_type", "p_brand", any_of=["big"])
    return out.select("key", "p_partkey", "declarations", "p_type", "big")


@query(
    "a8_merge_key",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || '::' || p_name || '::InterfaceDeclaration' WHEN p_size % 3 = 1 THEN p_name || '::MethodSignature::' || p_type
       ELSE p_name || '::FunctionDeclaration::' || p_brand || '::' || p_type END AS key FROM part""",
)
def a8_merge_key(s, d):
    kind = F.when(F.col("p_size") % 3 == 0, "InterfaceDeclaration").when(F.col("p_size") % 3 == 1, "MethodSignature").otherwise("FunctionDeclaration")
    return T(s, d, "part").select("p_partkey", merge.merge_key(kind, F.col("p_brand"), F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("key"))


@query(
    "identical_fold",
    r"""SELECT doc_id, representative, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS representative, count(*) OVER (PARTITION BY t) AS n FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)) WHERE n > 1""",
)
def identical_fold(s, d):
    """One row a member, with its group's representative: no group is gathered in a row."""
    keyed = T(s, d, "documents").select("doc_id", F.sha2(X.normalize_signature(F.col("text")), 256).alias("key"))  # a digest, not the text, is shuffled
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, "key").select("doc_id", "representative", "n")


@query("a11_provenance_labels", "SELECT p_name, list_sort(list_distinct(list(CASE p_size % 3 WHEN 0 THEN 'identical_fold' WHEN 1 THEN 'merge_scope' ELSE 'overload_key' END))) AS kinds FROM part GROUP BY 1")
def a11_provenance_labels(s, d):
    label = F.when(F.col("p_size") % 3 == 0, "identical_fold").when(F.col("p_size") % 3 == 1, "merge_scope").otherwise("overload_key")
    return T(s, d, "part").groupBy("p_name").agg(F.array_sort(F.collect_set(label)).alias("kinds"))


@query("surface_rollup", "SELECT c_custkey, coalesce(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderpriority IS NOT NULL))), []) AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def surface_rollup(s, d):
    sets = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return T(s, d, "customer").select("c_custkey").join(sets, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.array().cast("array<string>")).alias("priorities"))


@query("a13_merged_heritage", "SELECT p_name, list(p_type ORDER BY q) AS heritage FROM (SELECT p_name, p_type, min(p_partkey) AS q FROM part GROUP BY 1, 2) GROUP BY 1")
def a13_merged_heritage(s, d):
    return merge.first_seen(T(s, d, "part"), ["p_name"], "p_type", "p_partkey").withColumnRenamed("values", "heritage")


@query("a14_index_summary", "SELECT count(*) AS packages, count(*) FILTER (p_size < 10) AS cached, count(*) FILTER (p_size BETWEEN 10 AND 40) AS indexed, count(*) FILTER (p_size > 40) AS unsaved FROM part")
def a14_index_summary(s, d):
    size = F.col("p_size")
    return T(s, d, "part").agg(F.count("*").alias("packages"), F.count_if(size < 10).alias("cached"), F.count_if(size.between(10, 40)).alias("indexed"), F.count_if(size > 40).alias("unsaved"))


@query("a15_package_sums", "SELECT p_brand, count(*) AS symbols, sum(p_size)::BIGINT AS sizes, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1 ORDER BY symbols DESC, p_brand")
def a15_package_sums(s, d):
    return T(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("symbols"), F.sum("p_size").alias("sizes"), F.round(F.sum("p_retailprice"), 2).alias("price")).orderBy(F.desc("symbols"), "p_brand")


_STATS_SQL = """SELECT {keys}, count(*) AS n, round(avg((value > 100)::INT), 6) AS success_rate, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90,
  round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS ci95_low, round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS ci95_high, round(avg(user_id), 6) AS avg_user_id
  FROM events {where} GROUP BY {keys}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("group_stats", _STATS_SQL.format(keys="event_type", where=""))
def group_stats(s, d):
    return _rounded(stats.group_stats(T(s, d, "events"), ["event_type"], "value", F.col("value") > 100, ["user_id"]))


@query("a17_group_by_user", _STATS_SQL.format(keys="user_id, event_type", where="WHERE event_type <> 'error'"))
def a17_group_by_user(s, d):
    return _rounded(stats.group_stats(T(s, d, "events").where("event_type <> 'error'"), ["user_id", "event_type"], "value", F.col("value") > 100, ["user_id"]).drop("avg_user_id").withColumn("avg_user_id", F.col("user_id").cast("double")))


@query(
    "unfinished_calls",
    """SELECT user_id, greatest(count(*) FILTER (event_type = 'signup'), count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'error'), 0) AS unfinished FROM events GROUP BY 1""",
)
def unfinished_calls(s, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = T(s, d, "events").groupBy("user_id").agg(n("signup").alias("running"), n("view").alias("started"), n("click").alias("completed"), n("error").alias("errored"))
    return counts.select("user_id", stats.unfinished_calls(F.lit(None).cast("long"), *[F.col(c) for c in ("running", "started", "completed", "errored")]).alias("unfinished"))


@query("duplicate_audit", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_audit(s, d):
    return stats.surplus(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "multiset_diff",
    """SELECT name, sum(l)::BIGINT AS left_n, sum(r)::BIGINT AS right_n FROM (SELECT p_name AS name, 1 AS l, 0 AS r FROM part WHERE p_size < 30 UNION ALL SELECT p_name, 0, 1 FROM part WHERE p_size > 20) GROUP BY 1 HAVING sum(l) <> sum(r)""",
)
def multiset_diff(s, d):
    parts = T(s, d, "part").withColumnRenamed("p_name", "name")
    return stats.multiset_difference(parts.where("p_size < 30"), parts.where("p_size > 20"), ["name"])


@query("id_diff", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
def id_diff(s, d):
    used = T(s, d, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return T(s, d, "part").select("p_partkey").distinct().join(used, "p_partkey", "left_anti")


@query("topk_share", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def topk_share(s, d):
    return stats.top_share(T(s, d, "events"), "event_type", 3)


@query("a23_upper_median", "SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median FROM events GROUP BY 1")
def a23_upper_median(s, d):
    return stats.upper_median(T(s, d, "events"), ["event_type"], "value")


# --- numbering and picks (W1-W9) ---------------------------------------------------------


@query("homonym_ids", "SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '#' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def homonym_ids(s, d):
    return merge.numbered(T(s, d, "part"), F.col("p_name"), ["p_name"], ["p_partkey"]).select("p_partkey", "id")


@query("w2_internal_ids", "SELECT p_partkey, CASE WHEN n = 1 THEN k ELSE k || '#' || n END AS id FROM (SELECT p_partkey, p_brand || '::' || p_name AS k, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def w2_internal_ids(s, d):
    return merge.numbered(T(s, d, "part"), F.concat_ws("::", "p_brand", "p_name"), ["p_brand", "p_name"], ["p_partkey"]).select("p_partkey", "id")


@query(
    "name_pick_last_first",
    """SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 1 THEN 1 WHEN p_size % 4 = 2 THEN 2 ELSE 3 END,
       CASE WHEN p_size % 4 = 0 THEN -p_partkey ELSE p_partkey END) AS n FROM part) WHERE n = 1""",
)
def name_pick_last_first(s, d):
    kinds = F.element_at(F.array(F.lit("TypeAliasDeclaration"), F.lit("ClassDeclaration"), F.lit("ModuleDeclaration"), F.lit("FunctionDeclaration")), (F.col("p_size") % 4 + 1).cast("int"))
    return merge.picked(T(s, d, "part"), ["p_name"], merge.name_order(kinds, F.col("p_partkey"))).select("p_name", "p_partkey")


@query(
    "w4_parent_rank",
    """SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY CASE p_type WHEN 'SMALL' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 5 END, p_partkey) AS n FROM part) WHERE n = 1""",
)
def w4_parent_rank(s, d):
    kind = F.when(F.col("p_type") == "SMALL", "InterfaceDeclaration").when(F.col("p_type") == "ECONOMY", "TypeAliasDeclaration").otherwise("VariableStatement")
    rank = merge.parent_rank(kind, F.lit("PropertySignature"), F.lit(True))
    return merge.picked(T(s, d, "part"), ["p_name"], [rank, F.col("p_partkey")]).select("p_name", "p_partkey")


@query("w6_keep_first", "SELECT p_name, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1")
def w6_keep_first(s, d):
    return merge.picked(T(s, d, "part"), ["p_name", "p_type"], ["p_size", "p_partkey"]).select("p_name", "p_type", "p_partkey")


@query("w9_first_seen", "SELECT p_brand, list(p_name ORDER BY q) AS names FROM (SELECT p_brand, p_name, min(p_partkey) AS q FROM part GROUP BY 1, 2) GROUP BY 1")
def w9_first_seen(s, d):
    return merge.first_seen(T(s, d, "part"), ["p_brand"], "p_name", "p_partkey").withColumnRenamed("values", "names")


# --- orders (O6-O12) and sets (U1-U6) ----------------------------------------------------


@query("o10_semver_order", "SELECT p_size % 7 AS major, p_size % 5 AS minor, p_size % 3 AS patch, p_partkey FROM part ORDER BY 1, 2, 3, 4 LIMIT 50")
def o10_semver_order(s, d):
    size = F.col("p_size")
    return lookup.top(T(s, d, "part").select((size % 7).alias("major"), (size % 5).alias("minor"), (size % 3).alias("patch"), "p_partkey"), ["major", "minor", "patch", "p_partkey"], 50)


@query("o8_next_pending", "SELECT p_partkey FROM part WHERE p_size < 5 ORDER BY p_partkey LIMIT 1")
def o8_next_pending(s, d):
    return lookup.top(T(s, d, "part").where("p_size < 5").select("p_partkey"), ["p_partkey"], 1)


@query(
    "o12_parity_order",
    """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), m AS (SELECT round(avg(n))::BIGINT AS mean FROM c)
       SELECT c_nationkey, n, n - mean AS delta FROM c, m ORDER BY abs(n - mean) DESC, c_nationkey LIMIT 10""",
)
def o12_parity_order(s, d):
    counts = T(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    mean = counts.agg(F.round(F.avg("n")).cast("long").alias("mean"))
    return counts.join(F.broadcast(mean)).select("c_nationkey", "n", (F.col("n") - F.col("mean")).alias("delta")).orderBy(F.abs("delta").desc(), "c_nationkey").limit(10)  # one row


@query("u3_set_union", "SELECT p_partkey, list_sort(list_distinct([p_type, p_brand, split_part(p_name, ' ', 1), p_type])) AS names FROM part")
def u3_set_union(s, d):
    return T(s, d, "part").select("p_partkey", F.array_sort(F.array_union(F.array("p_type", "p_brand"), F.array(F.substring_index("p_name", " ", 1), "p_type"))).alias("names"))


@query("u4_except_all", "SELECT p_name FROM part WHERE p_size < 30 EXCEPT ALL SELECT p_name FROM part WHERE p_size > 20")
def u4_except_all(s, d):
    parts = T(s, d, "part")
    return parts.where("p_size < 30").select("p_name").exceptAll(parts.where("p_size > 20").select("p_name"))


@query("u5_intersection", "SELECT DISTINCT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u5_intersection(s, d):
    return T(s, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(T(s, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("u6_union", "SELECT p_type AS v FROM part UNION SELECT o_orderpriority FROM orders")
def u6_union(s, d):
    return T(s, d, "part").select(F.col("p_type").alias("v")).union(T(s, d, "orders").select("o_orderpriority")).distinct()
