"""Full-text search, evidence, paths through graphs and recipes over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import iterate, lookup, merge, search
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


# --- text search (S13, K4, Q1, O1) -------------------------------------------------------

_TOKENS = """WITH toks AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t FROM documents),
pos AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks)"""


def _docs(s, d, *columns: str) -> DataFrame:
    return spread(T(s, d, "documents").select("doc_id", *columns))


def _matched(s, d, text: str) -> DataFrame:
    return search.Scan(_docs(s, d, "text"), ["text"]).matches(search.parse(text, ["text"])).select("doc_id")


@query("fts_and", f"{_TOKENS} SELECT doc_id FROM pos WHERE term = 'und' INTERSECT SELECT doc_id FROM pos WHERE term = 'die'")
def fts_and(s, d):
    return _matched(s, d, "und die")


@query("fts_or", f"{_TOKENS} SELECT DISTINCT doc_id FROM pos WHERE term IN ('idiot', 'scum')")
def fts_or(s, d):
    return _matched(s, d, "idiot OR scum")


@query("fts_not", f"{_TOKENS} SELECT doc_id FROM pos WHERE term = 'the' EXCEPT SELECT doc_id FROM pos WHERE term = 'it'")
def fts_not(s, d):
    return _matched(s, d, "the NOT it")


@query("fts_phrase", f"{_TOKENS} SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def fts_phrase(s, d):
    return _matched(s, d, '"of the"')


@query("fts_prefix", f"{_TOKENS} SELECT DISTINCT doc_id FROM pos WHERE starts_with(term, 'lowei')")
def fts_prefix(s, d):
    return _matched(s, d, "lowei*")


@query("fts_near", f"{_TOKENS} SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id WHERE a.term = 'was' AND b.term = 'with' AND abs(a.pos - b.pos) - 1 <= 2")
def fts_near(s, d):
    return _matched(s, d, "NEAR(was with, 2)")


@query(
    "fts_column",
    """WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t FROM conversations) SELECT conv_id, turn FROM t WHERE list_contains(t, 'the') AND role = 'user'""",
)
def fts_column(s, d):
    rows = spread(T(s, d, "conversations"))
    return search.Scan(rows, ["role", "text"]).matches(search.parse("text:the role:user", ["role", "text"])).select("conv_id", "turn")


_BM25 = f"""{_TOKENS}, lens AS (SELECT doc_id, len(t) AS l FROM toks), corpus AS (SELECT count(*) AS n, avg(l) AS mean FROM lens),
tf AS (SELECT term, doc_id, count(*) AS tf FROM pos WHERE term IN ('it', 'for') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
both_terms AS (SELECT doc_id FROM tf GROUP BY 1 HAVING count(*) = 2),
scored AS (SELECT doc_id, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score
           FROM tf JOIN df USING (term) JOIN lens USING (doc_id), corpus WHERE doc_id IN (SELECT doc_id FROM both_terms) GROUP BY 1)"""


@query("bm25_scores", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM scored")
def bm25_scores(s, d):
    return search.Scan(_docs(s, d, "text"), ["text"]).scores(search.parse("it for")).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_indexed", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM scored")
def bm25_indexed(s, d):
    """The same through an inverted index."""
    index = search.build(_docs(s, d, "text"), "doc_id", ["text"])
    return search.scores(index, search.parse("it for")).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("find_ranked", f"{_BM25} SELECT doc_id, source, round(score, 6) AS score FROM scored JOIN documents USING (doc_id) ORDER BY CASE WHEN source = 'src1' THEN 0 WHEN source ILIKE 'src1%' THEN 1 ELSE 2 END, round(score, 6), doc_id LIMIT 20")
def find_ranked(s, d):
    hits = search.Scan(_docs(s, d, "source", "text"), ["text"]).scores(search.parse("it for")).select("doc_id", "source", "score")
    tier = F.when(F.col("source") == "src1", 0).when(F.col("source").ilike("src1%"), 1).otherwise(2)
    rounded = hits.withColumn("score", F.round("score", 6))
    return lookup.top(rounded, [tier, "score", "doc_id"], 20)


@query(
    "evidence",
    f"""{_TOKENS}, hits AS (
      SELECT * FROM (SELECT 0 AS anchor, doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE source = 'src7') WHERE place <= 5
      UNION ALL SELECT * FROM (SELECT 1, doc_id, row_number() OVER (ORDER BY doc_id) FROM (SELECT DISTINCT doc_id FROM pos WHERE term = 'loser')) x(anchor, doc_id, place) WHERE place <= 5),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY anchor, place) AS n FROM hits) WHERE n = 1)
    SELECT anchor, place, f.doc_id, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 80) AS snippet FROM first f JOIN documents d ON d.doc_id = f.doc_id""",
)
def evidence(s, d):
    from pyspark.sql import Window

    docs = T(s, d, "documents")
    exact = lookup.top(docs.where("source = 'src7'").select("doc_id"), ["doc_id"], 5).withColumn("anchor", F.lit(0))
    phrase = lookup.top(_matched(s, d, "loser"), ["doc_id"], 5).withColumn("anchor", F.lit(1))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("doc_id"))
    hits = merge.picked(exact.unionByName(phrase).withColumn("place", place), ["doc_id"], ["anchor", "place"])  # ten rows place most
    snippet = F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, 80)
    return docs.join(F.broadcast(hits), "doc_id").select("anchor", F.col("place").cast("long").alias("place"), "doc_id", snippet.alias("snippet"))


@query("evidence_truncated", "SELECT * FROM (SELECT doc_id::VARCHAR AS id FROM documents WHERE source = 'src2' ORDER BY doc_id LIMIT 2) UNION ALL SELECT '(more)'")
def evidence_truncated(s, d):
    from pyspark.sql import Window

    rows = lookup.top(T(s, d, "documents").where("source = 'src2'").select("doc_id"), ["doc_id"], 2 + 1)  # one over
    n = F.row_number().over(Window.orderBy("doc_id"))
    return rows.withColumn("n", n).select(F.when(F.col("n") > 2, "(more)").otherwise(F.col("doc_id").cast("string")).alias("id"))


# --- graphs (G1, G2, G5-G7) --------------------------------------------------------------

_EDGES_SQL = "edges AS (SELECT DISTINCT l_suppkey AS src, l_suppkey % 7 + l_partkey % 9 AS dst FROM lineitem)"


def _edges(s, d) -> DataFrame:
    return T(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") % 7 + F.col("l_partkey") % 9).alias("dst")).distinct()


def _roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct()


def _hops(cap: int):
    def run(s, d):
        edges = _edges(s, d)
        return iterate.reached(_roots(edges), edges, cap).groupBy("root", "node").agg(F.min("depth").alias("depth"))

    return run


for _cap in (0, 1, 3):
    query(
        f"hop_bfs_{_cap}",
        f"""WITH RECURSIVE {_EDGES_SQL}, walk AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth FROM edges UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < {_cap})
        SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2""",
    )(_hops(_cap))


@query(
    "closure",
    f"""WITH RECURSIVE {_EDGES_SQL}, walk AS (SELECT DISTINCT src AS root, src AS node FROM edges UNION SELECT w.root, e.dst FROM walk w JOIN edges e ON e.src = w.node) SELECT root, node FROM walk""",
)
def closure(s, d):
    edges = _edges(s, d)
    return iterate.reached(_roots(edges), edges).select("root", "node")


@query("revisits", None)
def revisits(s, d):
    edges = _edges(s, d)
    return iterate.revisits(iterate.reached(_roots(edges), edges), edges)


@query("scope_components", None)
def scope_components(s, d):
    lines = T(s, d, "lineitem")
    edges = lines.select(F.concat(F.lit("p"), "l_partkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v"))
    return iterate.components(edges)


@query(
    "merge_scopes",
    """WITH RECURSIVE f AS (SELECT s_suppkey AS path, s_suppkey % 2 = 0 AS m FROM supplier), e AS (SELECT s_suppkey AS a, s_nationkey AS b FROM supplier WHERE s_suppkey % 2 = s_nationkey % 2 AND s_nationkey IN (SELECT path FROM f)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT path AS id, path AS node FROM f UNION SELECT r.id, u.b FROM reach r JOIN u ON u.a = r.node), c AS (SELECT id, min(node) AS rep, count(*) AS n FROM reach GROUP BY 1)
    SELECT path, CASE WHEN NOT m THEN 's:' WHEN n > 1 THEN 'mcc:' ELSE 'm:' END || rep AS scope FROM f JOIN c ON c.id = f.path""",
)
def merge_scopes(s, d):
    supp = T(s, d, "supplier")
    files = supp.select(F.col("s_suppkey").alias("path"), (F.col("s_suppkey") % 2 == 0).alias("is_module"))
    edges = supp.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return iterate.merge_scopes(files, edges)


@query(
    "inherit_flatten",
    """WITH m AS (SELECT 'region' || r_regionkey AS parent, r_name AS leaf, 'r' || r_regionkey AS member FROM region UNION ALL SELECT 'nation' || s_nationkey, 'leaf' || s_suppkey % 5, 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0
      UNION ALL SELECT 'region' || n_regionkey, 'leaf' || n_nationkey % 5, 'n' || n_nationkey FROM nation),
    above AS (SELECT 'customer' || c_custkey AS child, 'nation' || c_nationkey AS anc FROM customer UNION SELECT 'customer' || c_custkey, 'region' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
    own AS (SELECT 'customer' || c_custkey AS child, 'leaf' || c_custkey % 5 AS leaf FROM customer)
    SELECT a.child, m.leaf, list_sort(list_distinct(list(m.member))) AS from_members FROM above a JOIN m ON m.parent = a.anc LEFT JOIN own o ON o.child = a.child AND o.leaf = m.leaf WHERE o.leaf IS NULL GROUP BY 1, 2""",
)
def inherit_flatten(s, d):
    region, nation, supp = T(s, d, "region"), T(s, d, "nation"), T(s, d, "supplier")
    customers = T(s, d, "customer")
    row = lambda parent, leaf, member, internal: [parent.alias("parent"), leaf.alias("leaf"), member.alias("member"), internal.alias("internal"), F.lit(0).alias("seq")]
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    leaf = lambda c: F.concat(F.lit("leaf"), (F.col(c) % 5).cast("string"))
    members = region.select(*row(text("region", "r_regionkey"), F.col("r_name"), text("r", "r_regionkey"), F.lit(False)))
    members = members.unionByName(supp.select(*row(text("nation", "s_nationkey"), leaf("s_suppkey"), text("s", "s_suppkey"), F.col("s_suppkey") % 4 == 0)))
    members = members.unionByName(nation.select(*row(text("region", "n_regionkey"), leaf("n_nationkey"), text("n", "n_nationkey"), F.lit(False))))
    members = members.unionByName(customers.select(*row(text("customer", "c_custkey"), leaf("c_custkey"), text("c", "c_custkey"), F.lit(True))))
    heritage = customers.select(text("customer", "c_custkey").alias("child"), text("nation", "c_nationkey").alias("base"))
    heritage = heritage.unionByName(nation.select(text("nation", "n_nationkey").alias("child"), text("region", "n_regionkey").alias("base")))
    return iterate.inherited(members, heritage).where("child LIKE 'customer%'").select("child", "leaf", "from_members")


@query("g2_edge_kinds", "SELECT c_custkey AS src, c_nationkey::BIGINT AS dst FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier UNION SELECT n_nationkey, n_regionkey FROM nation")
def g2_edge_kinds(s, d):
    parts = [T(s, d, t).select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")) for t, a, b in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("nation", "n_nationkey", "n_regionkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("g4_public_internal", "SELECT p_partkey, p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AS is_internal FROM part")
def g4_public_internal(s, d):
    public = T(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("public", F.lit(True))
    return T(s, d, "part").join(public, "p_partkey", "left").select("p_partkey", F.col("public").isNull().alias("is_internal"))


@query(
    "g12_candidate_priority",
    """SELECT p_partkey, path FROM (SELECT p.p_partkey, c.path, row_number() OVER (PARTITION BY p.p_partkey ORDER BY pri) AS n FROM part p,
      (VALUES (0), (1), (2)) x(pri), LATERAL (SELECT CASE pri WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS path) c
      WHERE (pri = 0 AND p_name IN (SELECT p_name FROM part WHERE p_size = 2)) OR (pri > 0 AND c.path IN (SELECT split_part(p_name, ' ', 2) FROM part WHERE p_size = 4))) WHERE n = 1""",
)
def g12_candidate_priority(s, d):
    parts = T(s, d, "part")
    files = parts.where("p_size = 2").select(F.col("p_name").alias("path")).union(parts.where("p_size = 4").select(F.substring_index("p_name", " ", -1))).distinct()
    tries = parts.select("p_partkey", F.posexplode(F.array("p_name", F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1))).alias("priority", "path"))
    return tries.join(files, "path").groupBy("p_partkey").agg(F.min_by("path", "priority").alias("path"))


# --- recipes and ad hoc SQL (R1-R7, Q13) -------------------------------------------------

_RECIPES = {
    "r1_members": "SELECT n.n_name AS member FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'EUROPE' ORDER BY n.n_name",
    "r2_edge_walk": "SELECT o.o_orderkey, p.p_name FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE o.o_orderkey = 7",
    "r3_public_surface": "SELECT p_name, p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size > 10",
    "r4_overload_siblings": "SELECT b.o_orderkey FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus WHERE a.o_orderkey = 11",
    "r5_inherited_members": "SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE s.s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "r6_anchor_sweep": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) IN ('red bolt', 'blue ring') OR p_name ILIKE '%plate%' ORDER BY p_partkey LIMIT 40",
    "r7_symbol_counts": "SELECT c.c_nationkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 490000 GROUP BY c.c_nationkey",
    "read_only_sql": """WITH ranked AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
                        SELECT o_custkey, o_orderkey FROM ranked WHERE n = 1 EXCEPT SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'""",
    "sql_union_group": "SELECT 'customer' AS kind, count(*) AS n FROM customer UNION SELECT 'supplier', count(*) FROM supplier",
}


def _recipe(sql: str):
    def run(s, d):
        from quarry.plans import guarded

        return guarded.read_only(s, sql, {t: T(s, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})

    return run


for _name, _sql in _RECIPES.items():
    query(_name, _sql)(_recipe(_sql))
