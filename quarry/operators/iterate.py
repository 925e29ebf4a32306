"""Tables in the shared folder, and graph operators that iterate over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, where the session names no folder.
LOCAL_SHARED = "file:/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a session on one machine does without that setting; on a cluster its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and
    a lost executor costs nothing that was already written."""
    return _written(df, label)[0]


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _dropped(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def reached(start: DataFrame, edges: DataFrame, hops: int = -1) -> DataFrame:
    """(root, node, depth): nodes within ``hops`` steps, each at its least depth.

    ``start`` has ``node``, ``edges`` (src, dst). 0 hops are the roots alone, -1 all that
    can be reached. A round joins the frontier only and drops what was met before; rounds
    are written to the shared folder.
    """
    seen = stored(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "reach")
    frontier, depth = seen, 0
    while hops < 0 or depth < hops:
        depth += 1
        nodes = frontier.join(edges, frontier.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        frontier = stored(nodes.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def revisits(seen: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from a met node to one that was met no later: what a walk skips (G1)."""
    a = seen.select("root", F.col("node").alias("src"), F.col("depth").alias("d1"))
    b = seen.select(F.col("root").alias("r2"), F.col("node").alias("dst"), F.col("depth").alias("d2"))
    hit = a.join(edges, "src").join(b, ["dst"]).where("root = r2 AND d2 <= d1")
    return hit.select("root", "src", "dst").distinct()


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Re-hangs each node's neighbours (the smaller ones, or the larger) on the least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.where("v < u") if small else both
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = both.join(least, both.u == least.n)
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    else:
        moved = joined.select(F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (u, v) as (id, component), the least id reachable.

    Alternating large-star and small-star steps, each round written to the shared folder.
    Only a count and a checksum of a round reach the driver. Nodes without an edge to
    another node are absent; repeated edges and loops do no harm.
    """
    now, path = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = None
    while True:
        before, (now, path) = path, _written(_stars(_stars(now, small=False), small=True), label)
        _dropped(now.sparkSession, before)
        got = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == mark:
            nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return nodes.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        mark = got


def merge_scopes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, scope) of files (path, is_module): ``s:`` and the least path of a script's component,
    ``mcc:`` and the least of a module's if it has others, else ``m:`` and the path (G5).

    ``edges`` (src, dst) count between two scripts or two modules only.
    """
    kinds = files.select("path", "is_module").distinct()
    a, b = kinds.toDF("src", "m1"), kinds.toDF("dst", "m2")
    same = edges.join(a, "src").join(b, "dst").where("m1 = m2").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    found = components(same, "scopes")
    out = kinds.join(found, kinds.path == found.id, "left")
    prefix = F.when(~F.col("is_module"), "s:").when(F.col("component").isNotNull(), "mcc:").otherwise("m:")
    return out.select("path", F.concat(prefix, F.coalesce("component", "path")).alias("scope"))


def inherited(members: DataFrame, heritage: DataFrame) -> DataFrame:
    """(child, leaf, from_members, source): members that children get from all their ancestors.

    ``members`` (parent, leaf, member, internal, seq), ``heritage`` (child, base). Nearest
    ancestors first; leaves that a child has itself and internal members are skipped;
    ``source`` is the nearest, ``from_members`` all that have the leaf, sorted.
    """
    roots = heritage.select(F.col("child").alias("node")).distinct()
    above = reached(roots, heritage.select(F.col("child").alias("src"), F.col("base").alias("dst"))).where("depth > 0")
    offered = above.join(members.where("NOT internal"), above.node == members.parent).select(F.col("root").alias("child"), "leaf", "member", "depth", "seq")
    own = members.select(F.col("parent").alias("child"), "leaf").distinct()
    missing = offered.join(own, ["child", "leaf"], "left_anti")
    return missing.groupBy("child", "leaf").agg(F.array_sort(F.collect_set("member")).alias("from_members"), F.min_by("member", F.struct("depth", "seq")).alias("source"))
