"""Near-duplicate documents: BagMinHash signatures, bands, exact multiset overlap.

Documents with the same words are one class and are hashed once. Classes that share a
band's bucket are candidates, compared in tiles of bounded size by the exact overlap of
their shingle multisets; a tile returns edges to the least of each component, never pairs.

Two passes keep large groups of near copies linear. The first takes a few bands: a bucket
is dealt out in blocks, and its least member, its representative, is in each. The second
takes all bands, but only buckets whose members are not yet one component: those outside
of the largest component meet all members. No other pair can join components, so the
groups are those of comparing all candidates: no cap, no sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import bagminhash, scan
from quarry.llm.shared import components, over_batches, stored, tuned

#: Classes of similarity 0.8 share a bucket with probability 1 - (1 - 0.8**5)**25 = 0.99995.
WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
#: Classes, and words, of a block of a bucket.
TILE, TILE_WORDS = 512, 1 << 20
#: Bands of the first pass.
FIRST = 5
_FEATURES = 4096
_TILE_KEY = ["band", "key", "i", "j"]


def sequence_names(t: scan.Texts) -> np.ndarray:
    """(text, 2): a 128-bit BLAKE2 digest of each text's words in their order."""
    data = t.data.tobytes()
    names = [hashlib.blake2b(b" ".join(data[a:b].split()), digest_size=16).digest() for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
    return np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h1, h2, words, bands) of each row: a name of its words, their number; ``bands`` is null for texts without words."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, keys, sizes = [], [], []
        for _, _, t in scan.texts_of(batch.column(1)):
            names.append(sequence_names(t))
            keys.append(bagminhash.bands(bagminhash.signatures(t.n, *bagminhash.shingles(t, width), n_bands * rows), rows))
            sizes.append(t.n_words)
        name, size = np.concatenate(names), np.concatenate(sizes).astype(np.int64)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_bands)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).ravel()), mask=pa.array(size == 0))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(size), lists], ["doc_id", "h1", "h2", "words", "bands"])

    return over_batches(source, work, "doc_id long, h1 long, h2 long, words long, bands array<long>")


def overlaps(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the multiset intersections of ``n`` texts: an (n, n) matrix."""
    levels = np.repeat(np.arange(len(count)), count)
    level = np.arange(len(levels)) - np.repeat(np.cumsum(count) - count, count)
    unit = scan.mixed(shingle[levels] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    owner = doc[levels]
    order = np.argsort(unit, kind="stable")
    unit, owner = unit[order], owner[order]
    new = np.ones(len(unit), bool)
    new[1:] = unit[1:] != unit[:-1]
    feature = np.cumsum(new) - 1
    shared = np.bincount(feature)[feature] > 1 if len(feature) else np.zeros(0, bool)
    feature, owner = feature[shared], owner[shared]
    new = np.ones(len(feature), bool)
    new[1:] = feature[1:] != feature[:-1]
    feature = np.cumsum(new) - 1
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(feature[-1]) + 1 if len(feature) else 0, _FEATURES):
        a, b = np.searchsorted(feature, [low, low + _FEATURES])
        x = np.zeros((n, min(_FEATURES, int(feature[b - 1]) - low + 1)), np.float32)
        x[owner[a:b], feature[a:b] - low] = 1
        out += x @ x.T
    return out


def least_reached(hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of the symmetric ``hit`` the least id of its component."""
    least, far = ids.copy(), np.iinfo(np.int64).max
    while True:
        new = np.minimum(least, np.where(hit, least[None, :], far).min(1))
        if (new == least).all():
            return least
        least = new


def edges(tiles: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(u, v) edges of tiles: rows (band, key, i, j, id, text) sorted by tile within partitions.

    A row that repeats another one of its tile says nothing new.
    """
    tuned(tiles.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen = None, [], set()

        def settle() -> list[tuple[int, int]]:
            ids = np.array([h[0] for h in held], np.int64)
            sizes = [len(h[1]) for h in held]
            doc = np.repeat(np.arange(len(held)), sizes)
            common = overlaps(doc, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), len(held))
            weight = np.array([h[2].sum() for h in held], np.float64)
            hit = common >= threshold * (weight[:, None] + weight[None, :] - common) - 1e-9
            hit &= common > 0
            least = least_reached(hit, ids)
            return [(int(a), int(b)) for a, b in zip(ids, least, strict=True) if a != b]

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("band", "key", "i", "j")), strict=True))
            ids = batch.column("id").to_pylist()
            out: list[tuple[int, int]] = []
            for begin, _, t in scan.texts_of(batch.column("text")):
                doc, shingle, count = bagminhash.shingles(t, width)
                bounds, names = np.searchsorted(doc, np.arange(t.n + 1)), sequence_names(t)
                for k in range(t.n):
                    if keys[begin + k] != now:
                        if len(held) > 1:
                            out += settle()
                        now, held, seen = keys[begin + k], [], set()
                    if (own := (ids[begin + k], names[k].tobytes())) in seen:
                        continue
                    seen.add(own)
                    held.append((ids[begin + k], shingle[bounds[k] : bounds[k + 1]], count[bounds[k] : bounds[k + 1]]))
            yield _pairs(out)
        if len(held) > 1:
            yield _pairs(settle())

    return tiles.mapInArrow(compare, "u long, v long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["u", "v"])


def distinct_buckets(keyed: DataFrame) -> DataFrame:
    """(band, key, members, all_words, least) of one bucket, in the first band, for each set of two or more classes.

    ``keyed`` has (id, h1, h2, words, band, key). Several bands often have the same
    members: one bucket of them is enough. Members are classes, not ids: a class is in a
    bucket once, so that nothing cancels in the XORs.
    """
    facts = [F.count("*").alias("members"), F.bit_xor("h1").alias("m1"), F.bit_xor("h2").alias("m2"), F.sum("words").alias("all_words"), F.min("id").alias("least")]
    buckets = keyed.groupBy("band", "key").agg(*facts).where("members > 1")
    return buckets.groupBy("members", "m1", "m2").agg(F.min(F.struct("band", "key", "all_words", "least")).alias("b")).select("b.*", "members")


def _blocks(members: str, words: str, tile: int) -> Column:
    return F.greatest(F.ceil(F.col(members) / tile), F.ceil(F.col(words) / TILE_WORDS)).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def star_tiles(members: DataFrame, tile: int) -> DataFrame:
    """(band, key, i, j, id): each member of a bucket in one block, and the bucket's least in all.

    ``members`` has (band, key, id) and ``distinct_buckets`` of each.
    """
    sized = members.withColumn("blocks", _blocks("members", "all_words", tile))
    own = sized.select("band", "key", _block("blocks").alias("i"), "id")
    rest = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != _block("blocks"))
    least = sized.where("blocks > 1 AND id = least").select("band", "key", F.explode(rest).alias("i"), "id")
    return own.unionByName(least).select("band", "key", "i", F.lit(0).alias("j"), "id")


def rest_tiles(members: DataFrame, tile: int) -> DataFrame:
    """(band, key, i, j, id): in buckets of several components, members outside of the largest one meet all members.

    ``members`` has (band, key, id, words, component). Tile (i, j) has block i of those outside and block j of all.
    """
    sizes = members.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    most = F.max(F.struct("n", "w", "component"))
    sizes = sizes.groupBy("band", "key").agg(most.alias("m"), F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).where("m.n < all_n")
    sizes = sizes.select("band", "key", F.col("m.component").alias("main"), "all_n", "all_w", (F.col("all_n") - F.col("m.n")).alias("n"), (F.col("all_w") - F.col("m.w")).alias("w"))
    sizes = sizes.select("band", "key", "main", _blocks("n", "w", tile).alias("outer"), _blocks("all_n", "all_w", tile).alias("blocks"))
    sizes = stored(sizes, "near-open")  # apart from the join, so that a large bucket's members can be split there
    placed = members.join(sizes.hint("merge"), ["band", "key"])
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    everyone = placed.select("band", "key", F.explode(upto("outer")).alias("i"), _block("blocks").alias("j"), "id")
    outside = placed.where("component <> main").select("band", "key", _block("outer").alias("i"), F.explode(upto("blocks")).alias("j"), "id")
    return everyone.unionByName(outside).distinct()


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, n_bands: int = BANDS, rows: int = ROWS, tile: int = TILE, first: int = FIRST) -> DataFrame:
    """(doc_id, class_id, group_id, kept) for each row of ``docs``.

    ``class_id`` is the least id with the same words in the same order, ``group_id`` the
    least id reachable over links (weighted Jaccard of word shingles of ``threshold`` or
    more), and ``kept`` holds for that one. A text of fewer words than a shingle is one
    shingle. Null, empty and blank texts have no shingles and link with nothing: each is
    its own class. Rows that repeat an id stay or go together, and texts that share an id
    are one node of the graph. Rows with a null id are kept with a null group unless a
    row with an id has the same words.
    """
    own = stored(signed(docs, doc_id, text, width, n_bands, rows), "near-signed")
    worded = own.where("bands IS NOT NULL")
    classes = stored(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.any_value("words").alias("words"), F.any_value("bands").alias("bands")), "near-classes")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def verified(places: DataFrame, label: str) -> DataFrame:
        spread = stored(places, f"near-{label}-tiles")
        tiles = spread.join(wanted, "id").select(*_TILE_KEY, "id", "text").repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)
        return edges(tiles, threshold, width)

    keyed = classes.where("id IS NOT NULL").select("id", "h1", "h2", "words", F.posexplode("bands").alias("band", "key"))
    chosen = stored(distinct_buckets(keyed), "near-buckets")
    members = stored(keyed.drop("h1", "h2").join(chosen.hint("merge"), ["band", "key"]), "near-members")
    wanted = stored(texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "near-texts")  # ids grow with the documents: no size to broadcast
    linked = components(verified(star_tiles(members.where(F.col("band") < first), tile), "first"), "near-first")
    compared = (F.col("band") < first) & (_blocks("members", "all_words", tile) == 1)  # all pairs were
    placed = members.where(~compared).join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = stored(verified(rest_tiles(placed, tile), "rest"), "near-rest")
    if not rest.isEmpty():
        linked = components(linked.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(rest), "near")
    results = classes.select("h1", "h2", "id").join(linked, "id", "left").select("h1", "h2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("group_id"))
    results = stored(results, "near-results")
    joined = own.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("h1")).alias("h1"), "h2").join(results, ["h1", "h2"], "left")
    group = F.coalesce("group_id", "doc_id")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), group.alias("group_id"), F.coalesce(F.col("doc_id") == group, F.col("group_id").isNull()).alias("kept"))


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with their columns unchanged."""
    gone = grouped(docs, doc_id, text).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")


#: What ``grouped(documents)`` returns, by exact overlaps of all shingles, for DuckDB; ids must be distinct.
SQL = """
WITH RECURSIVE toks AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM toks
), shingles AS MATERIALIZED (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c FROM pos WHERE i + 4 <= n OR (n < 5 AND i = 1) GROUP BY 1, 2
), sizes AS (
  SELECT doc_id, sum(c) AS t FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.c, b.c)) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS MATERIALIZED (
  SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 9 * o >= 4 * (a.t + b.t)
), both_ways AS (
  SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, l.v FROM reach r JOIN both_ways l ON r.v = l.u
), found AS (
  SELECT u AS doc_id, min(v) AS group_id FROM reach GROUP BY 1
)
SELECT t.doc_id, CASE WHEN len(w) = 0 THEN t.doc_id ELSE min(t.doc_id) OVER (PARTITION BY w) END AS class_id, group_id, t.doc_id = group_id AS kept
FROM toks t JOIN found f ON f.doc_id = t.doc_id
"""
