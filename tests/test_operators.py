import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation, globs, iterate, lookup, merge, search, stats
from quarry.sources import catalog as catalogs
from quarry.sources import packages
from quarry.streaming import incremental
from tests.test_sources import FILES


ROWS = [(1, "resume café", "alpha beta gamma"), (2, "Résumé", "alpha gamma"), (3, None, "beta. alpha-gamma delta"), (4, "zeta", None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "id long, title string, body string")


@pytest.fixture(scope="module")
def index(texts):
    return search.build(texts, "id", ["title", "body"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("resume", {1, 2}), ("RESUME cafe", {1}), ("alpha OR zeta", {1, 2, 3, 4}), ("alpha NOT beta", {2}), ('"alpha gamma"', {2, 3}), ('"beta gamma"', {1}), ("gam*", {1, 2, 3}), ("title:alpha", set()),
        ("body:alpha title:resume", {1, 2}), ("(zeta OR cafe) NOT delta", {1, 4}), ("NEAR(alpha gamma, 0)", {2, 3}), ("NEAR(alpha gamma, 1)", {1, 2, 3}), ("alpha + gamma", {2, 3}), ('""', set()), ('"gam" *', {1, 2, 3}),
    ],
)
def test_matches(index, texts, text, want):
    tree = search.parse(text, ["title", "body"])
    assert {r.id for r in search.matches(index, tree).collect()} == want
    assert {r.id for r in search.Scan(texts, ["title", "body"]).matches(tree).collect()} == want
    a, b = search.scores(index, tree), search.Scan(texts, ["title", "body"]).scores(tree)
    assert {r.id: pytest.approx(r.score) for r in a.collect()} == {r.id: r.score for r in b.collect()}


@pytest.mark.parametrize("text", ["alpha AND", "", "(alpha", "foo.bar", "a OR OR b", "nocol:x"])
def test_syntax_faults(text):
    with pytest.raises(search.SyntaxFault):
        search.parse(text, ["title"])


def test_tolerant():
    assert search.tolerant("foo.bar") == search.parse('"foo" "bar"') and search.tolerant("...") is None
    with pytest.raises(search.SyntaxFault):
        search.tolerant("nocol:x", ["title"])


def test_bm25(index):
    got = {r.id: r.score for r in search.scores(index, search.parse("delta")).collect()}
    lengths = [5, 3, 4, 1]
    mean = sum(lengths) / 4
    want = -math.log((4 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / mean))
    assert got == {3: pytest.approx(want)}
    assert all(r.score == pytest.approx(0, abs=1e-5) for r in search.scores(index, search.parse("alpha")).collect())  # in most rows: the floor


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "u long, v long")
    got = {r.id: r.component for r in iterate.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    star = spark.range(1, 3000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    assert iterate.components(star).agg(F.max("component"), F.count("*")).first() == (0, 3000)
    walk = iterate.reached(spark.createDataFrame([(0,)], "node long"), edges.toDF("src", "dst"), hops=2)
    assert {(r.node, r.depth) for r in walk.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_globs(spark):
    names = ["@s/a", "@sx/a", "lodash", "lodash.map", "aXbYc", "ab", "", "a[b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    hit = lambda c: [r.n for r in df.where(c).collect()]
    assert hit(globs.mini_glob(F.col("n"), "@s/*")) == ["@s/a"] and hit(globs.mini_glob(F.col("n"), "lodash/*")) == ["lodash", "lodash.map"]
    assert hit(globs.mini_glob(F.col("n"), "**")) == [] and hit(globs.mini_glob(F.col("n"), "")) == [] and len(hit(globs.mini_glob(F.col("n"), "*"))) == len(names)
    assert hit(globs.mini_glob(F.col("n"), "*b*a*")) == ["aXbYc", "ab", "a[b"] and hit(globs.mini_glob(F.col("n"), "a*b")) == ["ab", "a[b"]
    assert hit(globs.glob(F.col("n"), "a[[]b")) == ["a[b"] and hit(globs.glob(F.col("n"), "a?b*")) == ["aXbYc", "a[b"] and hit(globs.glob(F.col("n"), "[^@l]*")) == ["aXbYc", "ab", "a[b"]
    for bad in ("", "*"):
        with pytest.raises(ValueError):
            globs.glob(F.col("n"), bad)
    assert globs.allowed(df, "n", None) is df and globs.allowed(df, "n", df.limit(0)) is df


def test_merge(spark):
    rows = [(1, "k", "a  b", "f1", None, False, "x"), (2, "k", "a b", "f2", "d2", False, "y"), (3, "k", "c", "f1", "d3", True, "x"), (4, "k", " ", "f3", None, False, None), (5, "m", None, "f1", None, False, "z")]
    out = {r.key: r for r in merge.merged(spark.createDataFrame(rows, "seq long, key string, sig string, file string, doc string, flag boolean, label string"), "key", "seq", "sig", "file", ["doc"], ["flag"], ["label"]).collect()}
    k = out["k"]
    assert (k.sig, k.file, k.additional_files, k.doc, k.flag, k.label, k.declarations) == ("a  b\nc", "f1", ["f2", "f3"], "d2", True, ["x", "y"], 4)
    assert out["m"].additional_files == [] and not out["m"].sig


def test_cap_and_pages(spark):
    df = spark.range(10)
    assert len(lookup.capped(df, 10)) == 10
    with pytest.raises(ValueError):
        lookup.capped(df, 9)
    assert not lookup.page(df, ["id"], 5, 5).first().has_more and lookup.page(df, ["id"], 5, 4).first().has_more


def test_evaluation(spark):
    assert evaluation.first_object('x {"a": "}{", "b": {"c": 1}} y {') == '{"a": "}{", "b": {"c": 1}}'
    assert evaluation.first_object("none") is None and evaluation.json_text("[1]") == "[1]" and evaluation.json_text("say {bad}") == "say {bad}"
    rows = [
        ("1", "base", "t1", "p1", "easy", "r", "done", "", 10.0, True, 4, 2, 1, None, [("a", "running")], None), ("2", "base", "t1", "p1", "easy", "r", "done", "", 30.0, False, 1, 1, 0, 7, None, None),
        ("3", "base", "t2", "p1", "hard", "r", "skipped", "", 99.0, False, 0, 0, 0, None, [], "no"),
    ]
    out = {(r.grouping, r.group_key): r for r in evaluation.summary(spark.createDataFrame(rows, evaluation.RECORD)).collect()}
    base = out[("strategy", "base")]
    assert (base.n, base.success_rate, base.p50, base.p90, base.avg_calls_unfinished) == (2, 0.5, 10.0, 30.0, 4.0)
    assert base.ci95_high == pytest.approx(20 + 1.96 * 10 / math.sqrt(2))
    assert ("difficulty", "hard") not in out and out[("task_id", "t2")].n == 1 and out[("package_id", "p1")].n == 3
    judged = [("t1", "completed", None, 3.0, 4.0, 2.0, 2.0, "treatment", "high"), ("t2", "skipped", None, None, None, None, None, None, None), ("t3", "completed", None, 5.0, 1.0, 1.0, 2.0, "baseline", "low")]
    j = spark.createDataFrame(judged, evaluation.JUDGMENT)
    row = evaluation.pairwise_summary(j).first()
    assert (row.attempted, row.completed, row.skipped, row.mean_delta_correctness, row.correctness_treatment, row.actionability_tie, row.preferred_baseline, row.confidence_high) == (3, 2, 1, -1.5, 1, 1, 1, 1)
    assert [tuple(r) for r in evaluation.skip_reasons(j).collect()] == [("unknown", 1)]
    answers = spark.createDataFrame([('{"declaration_paths": ["a.d.ts"], "why": "x"}',), ('ok: {"declaration_paths": []}',), ("no",), (None,)], "t string")
    assert [r[0] for r in answers.select(evaluation.contract_faults(F.col("t"), ["why"])).collect()] == [[], ["declaration_paths", "why"], ["valid_json"], ["valid_json"]]


def test_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", None)], "k string, v double")
    assert {r.k: r.upper_median for r in stats.upper_median(df.where("v IS NOT NULL"), ["k"], "v").collect()} == {"a": 3.0}
    got = {r.k: r for r in stats.group_stats(df, ["k"], "v", F.col("v") > 2).collect()}
    assert got["a"].p50 == 2.0 and got["b"].p50 is None


def test_streams(spark, tmp_path):
    rows = [("c1", 1, "running", None), ("c1", 3, None, 9), ("c1", 2, "done", None), ("c2", 1, "running", 1)]
    events = spark.createDataFrame(rows, "call_id string, ts long, status string, tokens long")
    want = {("c1", 3, "done", 9), ("c2", 1, "running", 1)}
    folded = lambda df: {(r.call_id, r.events, r.status, r.tokens) for r in df.collect()}
    assert folded(incremental.fold_calls(events, fields=("status", "tokens"))) == want
    events.write.parquet(f"{tmp_path}/e")
    stream = incremental.fold_calls(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), fields=("status", "tokens"))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert folded(spark.table("folded")) == want

    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    files.coalesce(1).write.parquet(f"{tmp_path}/f")
    c = catalogs.Catalog(spark, f"file:{tmp_path}/cat", buckets=2)
    incremental.index(spark.readStream.schema(files.schema).parquet(f"{tmp_path}/f"), c, "k", f"{tmp_path}/cp").awaitTermination(120)
    assert c.table("symbols").count() == packages.graphs(files).join(packages.scan(files).select(F.col("name").alias("package"), "version"), ["package", "version"], "left_semi").count() > 0


def test_unknown_tasks_are_an_error(spark):
    tasks = spark.createDataFrame([("a", "easy"), ("b", "hard")], "task_id string, difficulty string")
    assert evaluation.chosen(tasks, ["a", "b"], ["hard"]).count() == 1 and evaluation.chosen(tasks).count() == 2
    with pytest.raises(LookupError):
        evaluation.chosen(tasks, ["a", "c"])
