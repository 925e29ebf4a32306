"""Near-duplicate embeddings by Euclidean p-stable hashing.

Quantised random projections floor((a.v + b) / w) of the normalised vectors, several to a
table, put them in buckets of several tables; vectors that share a bucket are compared by
exact cosine. Buckets are compared in square tiles of bounded size, so no pair is ever a
row: a tile returns, for each vector, how many others it links and one edge to the least
of its tile's component. A pair counts in the first table only that has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scan import mixed
from quarry.llm.shared import components, over_batches, stored, tuned

#: Cells are WIDTH wide. The hashes of a table grow with the logarithm of the vectors, so
#: that about MATES of them share a bucket by chance; the tables, so that a pair at the
#: threshold shares none of its buckets with probability MISS (closer pairs still less).
WIDTH, MATES, MISS, LEAST_HASHES, SEED = 1.5, 16, 0.0005, 6, 41
TILE = 1024


def agreement(cosine: float, width: float = WIDTH) -> float:
    """The probability that unit vectors of this cosine share a cell of one projection."""
    apart = math.sqrt(2 - 2 * cosine)
    if not apart:
        return 1.0
    t = width / apart
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def sizes(n: int, threshold: float, width: float = WIDTH) -> tuple[int, int]:
    """(tables, hashes of each) for ``n`` vectors that are compared with each other."""
    hashes = max(LEAST_HASHES, math.ceil(math.log(max(n, 1) / MATES) / -math.log(agreement(0.0, width))))
    shared = agreement(threshold, width) ** hashes
    return (math.ceil(math.log(MISS) / math.log1p(-shared)) if shared < 1 else 1), hashes


def _projections(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, dim])
    return random.standard_normal((dim, tables * hashes)), random.uniform(0, width, tables * hashes)


def signatures(vectors: np.ndarray, tables: int, hashes: int, width: float = WIDTH) -> np.ndarray:
    """One 32-bit bucket number for each unit vector and table."""
    a, b = _projections(vectors.shape[1], tables, hashes, width)
    cells = np.floor((vectors @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(vectors), tables, hashes)
    key = np.zeros((len(vectors), tables), np.uint64)
    for k in range(hashes):
        key = mixed(key + cells[:, :, k] + np.uint64(k + 1))
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _linked(left: dict, right: dict, table: int, threshold: float, same: bool) -> dict[int, list]:
    """{class: [links, least reached]} of one tile."""
    hit = left["v"] @ right["v"].T >= threshold
    if same:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    if not len(i):
        return {}
    low_l = left["id"].copy()
    low_r = low_l if same else right["id"].copy()
    while True:
        before = low_l.copy(), low_r.copy()
        np.minimum.at(low_l, i, low_r[j])
        np.minimum.at(low_r, j, low_l[i])
        if (low_l == before[0]).all() and (low_r == before[1]).all():
            break
    for t in range(table):  # pairs that share an earlier bucket are counted there
        new = left["sig"][i, t] != right["sig"][j, t]
        i, j = i[new], j[new]
    out: dict[int, list] = {}
    sides = [(left, np.bincount(i, right["n"][j], len(left["id"])), low_l)]
    if not same:
        sides.append((right, np.bincount(j, left["n"][i], len(right["id"])), low_r))
    for side, count, low in sides:
        for k in np.flatnonzero((count > 0) | (low != side["id"])):
            got = out.setdefault(int(side["id"][k]), [0, int(low[k])])
            got[0] += int(count[k])
            got[1] = min(got[1], int(low[k]))
    return out


def links(vectors: DataFrame, threshold: float = 0.93, tables: int | None = None, hashes: int | None = None, width: float = WIDTH, tile: int = TILE) -> DataFrame:
    """(id, links, least) rows: partial counts and edges of classes ``vectors`` (id, label, vec, n).

    ``tables`` and ``hashes`` follow the largest number of vectors of a label and dimension
    (``sizes``) unless given. Buckets and tiles are made of row numbers; vectors join them last.
    """
    tuned(vectors.sparkSession)
    if tables is None or hashes is None:
        most = vectors.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        tables, hashes = sizes(most or 1, threshold, width)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index("vec"))
        lengths, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        sig = np.zeros((len(lengths), tables), np.int32)
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            flat = values[(starts[rows][:, None] + np.arange(dim)).ravel()]
            sig[rows] = signatures(_unit(flat, dim), tables, hashes, width)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * tables), pa.array(sig.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "sig"])

    kind = vectors.schema["vec"].dataType.simpleString()
    made = over_batches(vectors, sign, f"id long, label {vectors.schema['label'].dataType.simpleString()}, vec {kind}, n long, sig array<int>")
    signed = stored(made.withColumn("row", F.monotonically_increasing_id()), "vec-signed")  # row numbers are fixed from here
    rows = signed.select("row", "label", F.size("vec").alias("dim"), F.posexplode("sig").alias("table", "bucket"))
    key = ["label", "dim", "table", "bucket"]
    shared = rows.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / tile).cast("int")
    own = F.pmod(F.xxhash64("row"), blocks).cast("int")
    tiles = rows.join(shared, key).withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row")
    tiles = tiles.join(signed.select("row", "id", "n", "vec", "sig"), "row").drop("row")
    tile_key = [*key, "i", "j"]
    sorted_tiles = tiles.repartition(*tile_key).sortWithinPartitions(*tile_key)
    fields = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settle() -> dict[int, list]:
            _, dim, table, _, i, j = now
            part = pa.Table.from_batches(held).combine_chunks()
            side = {
                "id": part["id"].to_numpy(), "n": part["n"].to_numpy(),
                "v": _unit(part["vec"].combine_chunks().flatten().to_numpy(), dim),
                "sig": part["sig"].combine_chunks().flatten().to_numpy().reshape(-1, tables),
            }
            if i == j:
                return _linked(side, side, table, threshold, True)
            left = part["own"].to_numpy() == i
            return _linked({k: v[left] for k, v in side.items()}, {k: v[~left] for k, v in side.items()}, table, threshold, False)

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in tile_key), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            totals: list[tuple[int, list]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != now:
                    if held:
                        totals += settle().items()
                    now, held = keys[a], []
                held.append(batch.slice(a, b - a))
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in totals]), pa.array([v[0] for _, v in totals]), pa.array([v[1] for _, v in totals])], schema=fields)
        if held and (last := settle()):
            yield pa.RecordBatch.from_arrays([pa.array(list(last)), pa.array([v[0] for v in last.values()]), pa.array([v[1] for v in last.values()])], schema=fields)

    return sorted_tiles.mapInArrow(compare, "id long, links long, least long")


def deduplicated(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **hashing: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors are compared within a label and a dimension only. A null label, and a vector
    that is null, empty, zero, or holds a null or a non-finite component, links with
    nothing. Equal vectors are one class: each copy counts as a link of the others, and
    classes are hashed and compared once. Rows that repeat an id count as vectors of
    their own with one id between them. Rows with a null id link, but name no component.
    """
    v = F.col(vector)
    # single precision stays so on the way, which halves what is dealt out; cosines are of doubles
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    plain = F.transform(v, lambda x: x.cast(kind) + F.lit(0).cast(kind))  # -0.0 becomes 0.0
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable(v) & F.col(label).isNotNull(), plain).alias("vec"), F.col(label).alias("label"))
    name = F.when(F.col("vec").isNotNull(), F.sha2(F.to_json(F.struct("label", "vec")), 256))
    named = base.withColumn("name", name)
    classes = stored(named.where("name IS NOT NULL").groupBy("name").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec")), "vec-classes")
    found = stored(links(classes.where("id IS NOT NULL").select("id", "label", "vec", "n"), threshold, **hashing), "vec-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("u"), F.col("least").alias("v")), "vec")
    results = classes.select("name", "id", "n").join(counts, "id", "left").join(reached, "id", "left")
    results = stored(results.select("name", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vec-results")
    joined = named.select("vec_id", "name").join(results, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: All links of ``embeddings`` at cosine 0.93 and the least id reachable, for DuckDB.
SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT r.u, l.v FROM reach r JOIN linked l ON r.v = l.u
)
SELECT e.vec_id, (SELECT count(*) FROM linked WHERE u = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = e.vec_id
"""
