import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import bagminhash, embedding_dedup, near_dedup, scan
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(a, b):
    both = sum((a & b).values())
    return both > 0 and both >= 0.8 * sum((a | b).values()) - 1e-9


def family(seed, n, edits):
    """Texts that share a base, each with some words changed."""
    r = random.Random(seed)
    base = words(seed, 300, 3000).split()
    out = []
    for k in range(n):
        t = list(base)
        for _ in range(r.randrange(edits + 1)):
            t[r.randrange(len(t))] = f"e{seed}x{k}x{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [words(1000 + i, 60 + i, 3000) for i in range(60)]
    texts += [t for s in range(6) for t in family(s, 12, 14)]
    texts += [texts[3]] * 5 + [texts[4] + "  \n"] + ["few words", "few words", "few  words", None, "", " ", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize(("tile", "first"), [(512, 5), (4, 5), (3, 1)])
def test_groups_match_brute_force(corpus, tile, first):
    rows, docs = corpus
    bags = {i: bag(t) for i, t in rows}
    ids = sorted(bags)
    want = groups([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(bags[a], bags[b])], ids)
    got = near_dedup.grouped(docs, tile=tile, first=first).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.group_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_one_of_each_group_stays(corpus):
    _, docs = corpus
    grouped = near_dedup.grouped(docs).collect()
    kept = near_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.group_id for r in grouped})


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_dedup.grouped(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[6].group_id == 5 and not by_id[6].kept
    assert all(by_id[k].kept and by_id[k].group_id == k for k in (1, 2, 3, 4, 5, 7, 8, 9))
    assert all(r.kept and r.group_id is None for r in rows if r.doc_id is None)
    assert near_dedup.grouped(no_docs).collect() == []
    same = spark.createDataFrame([(None, words(2, 120)), (3, words(2, 120)), (8, words(2, 120))], "doc_id long, text string")
    assert {(r.doc_id, r.group_id) for r in near_dedup.grouped(same).collect()} == {(None, 3), (3, 3), (8, 3)}


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    off = []
    for _ in range(12):
        k = 50
        a = r.integers(0, 40, k)
        b = np.maximum(0, a + r.integers(-9, 10, k))
        h = r.integers(0, 2**48, k).astype(np.uint64)
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = bagminhash.signatures(2, doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 3000)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.008 and np.abs(off).max() < 0.04


def test_shingles_and_overlaps():
    texts = ["a b c d e a b c d e a b c d e", "a b c d e a b c d e", "x y", "", "x  y"]
    (_, _, t), = scan.texts_of(pa.array(texts))
    doc, shingle, count = bagminhash.shingles(t)
    bags = [bag(x) for x in texts]
    assert [int(count[doc == i].sum()) for i in range(5)] == [sum(b.values()) for b in bags]
    got = near_dedup.overlaps(doc, shingle, count, 5)
    want = np.array([[sum((a & b).values()) for b in bags] for a in bags])
    apart = ~np.eye(5, dtype=bool)  # a text's own shingles count only as far as others share them
    assert (got[apart] == want[apart]).all()


# --- embeddings --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    rows = []
    for c in range(40):
        centre = r.normal(size=16)
        for _ in range(int(r.integers(1, 9))):
            v = centre + r.normal(size=16) * r.choice([0.05, 0.1, 0.2])
            rows.append((len(rows), [float(x) for x in (v * r.uniform(0.1, 50)).astype(np.float32)], int(c % 3)))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(7)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [math.nan] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, rows[0][1], None), (1005, [math.inf] + [1.0] * 15, 1), (1006, [], 1), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), (1009, [1e-30, 2e-30], 1), (5, rows[5][1], rows[5][2])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("tile", [1024, 3])
def test_links_match_brute_force(vectors, tile):
    rows, df = vectors
    good = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(np.float32(v))]
    links = Counter()
    pairs = []
    for x, (i, a, c) in enumerate(good):
        for y, (j, b, e) in enumerate(good):
            if x != y and c == e and len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= 0.93:
                links[x] += 1
                pairs.append((i, j))
    want = groups(pairs, sorted({i for i, _, _ in rows}))
    got = embedding_dedup.deduplicated(df, tile=tile).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.component_id for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted([(i, links[x]) for x, (i, _, _) in enumerate(good)] + [(i, 0) for i, v, c in rows if not any(i == g[0] for g in good)])


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, n_links string, id int")
    assert embedding_dedup.deduplicated(df).collect() == []
    alone = spark.createDataFrame([(None, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [(r.n_links, r.component_id) for r in embedding_dedup.deduplicated(alone).collect()] == [(0, None)]


def test_repeated_ids_do_not_make_buckets_equal(spark):
    hashed = {"1a": (11, 21), "1b": (12, 25), "2a": (13, 28), "2b": (99, 31), "3": (70, 81)}
    buckets = {(0, 5): ("1a", "1b", "3"), (1, 6): ("2a", "2b", "3"), (2, 7): ("2a", "2b", "3"), (3, 8): ("3",)}
    rows = [(int(k[0]), *hashed[k], 9, *b) for b, own in buckets.items() for k in own]
    keyed = spark.createDataFrame(rows, "id long, h1 long, h2 long, words long, band int, key long")
    assert {(r.band, r.key, r.members, r.least) for r in near_dedup.distinct_buckets(keyed).collect()} == {(0, 5, 3, 1), (1, 6, 3, 2)}


def test_hash_twins_are_two_classes(spark):
    """Words and texts that agree under every polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    word = lambda a, b: "".join(b if x else a for x in bits)
    rows = [(1, word("a", "b")), (2, word("b", "a")), (3, " ".join(word("p", "q"))), (4, " ".join(word("q", "p")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dedup.grouped(docs).collect()} == {(k, k) for k in range(1, 5)}
    assert {r.group_id for r in near_dedup.grouped(docs.where("doc_id < 3")).collect()} == {1, 2}
    (_, _, t), = scan.texts_of(pa.array([rows[0][1] + " " + rows[1][1]]))
    assert len(set(t.word_hashes().tolist())) == 2


def test_hashes_depend_on_the_bytes_alone():
    r = random.Random(4)
    parts = [bytes(r.randrange(33, 127) for _ in range(n)).decode() for n in [1, 7, 8, 9, 63, 64, 65, 511, 512, 513, 5000]]
    (_, _, t), = scan.texts_of(pa.array([" ".join(parts), "  " + " ".join(reversed(parts))]))
    h = t.word_hashes().tolist()
    assert h[: len(parts)] == h[len(parts) :][::-1] and len(set(h)) == len(parts)
    for k, x in enumerate(parts):
        (_, _, alone), = scan.texts_of(pa.array([x]))
        assert alone.word_hashes().tolist() == [h[k]]


def test_tile_rows_grow_with_the_near_copies(spark, monkeypatch):
    """Texts of one family, that many buckets share: rows sent to tiles are in proportion to the texts."""
    counts = []
    real = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, label: (out := real(df, label), counts[-1].__setitem__(label, out.count()) if label.endswith("-tiles") else None)[0])
    for n in (300, 900):
        counts.append({})
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(family(77, n, 5))], "doc_id long, text string")
        got = near_dedup.grouped(docs, tile=32).collect()
        assert {r.group_id for r in got} == {0}
    few, many = (sum(c.values()) for c in counts)
    assert many < 4 * few and many < 8 * 900


def test_text_labels_do_not_run_into_vectors(spark):
    rows = [(1, "a,1.0", [2.0]), (2, "a", [1.0, 2.0]), (3, "a", [1.0, 2.0]), (4, 'a"', [1.0, 2.0])]
    got = embedding_dedup.deduplicated(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (2, 1, 2), (3, 1, 2), (4, 0, 4)]


def test_candidates_of_a_vector_grow_far_slower_than_the_vectors():
    r, each = np.random.default_rng(1), []
    for n in (5_000, 40_000):
        v = r.normal(size=(n, 64))
        sig = embedding_dedup.signatures(v / np.linalg.norm(v, axis=1, keepdims=True), *embedding_dedup.sizes(n, 0.93))
        members = [np.unique(column, return_counts=True)[1] for column in sig.T]
        each.append(sum(int((m * (m - 1)).sum()) for m in members) / n)
    assert each[1] < 2.5 * each[0]


@pytest.mark.parametrize("n", [1, 5_000, 10_000_000])
def test_recall_at_the_threshold(n):
    r, k = np.random.default_rng(2), 3000
    a, b = r.normal(size=(2, k, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    tables, hashes = embedding_dedup.sizes(n, 0.93)
    x, y = embedding_dedup.signatures(a, tables, hashes), embedding_dedup.signatures(b, tables, hashes)
    assert (x == y).any(1).mean() > 0.995
    assert abs((embedding_dedup.signatures(a, 200, 1) == embedding_dedup.signatures(b, 200, 1)).mean() - embedding_dedup.agreement(0.93)) < 0.01
