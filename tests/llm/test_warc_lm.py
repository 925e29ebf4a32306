import gzip
import hashlib
import io
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.llm import attention, lm_scoring, passages, warc
from quarry.llm.queries import tokenizer_file
from tests import oracle
from tests.llm.conftest import words

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é</p>"), (3, None, "<p>one</p>"), (4, "http://a/4 x\r\ny", None), (5, "u", ""), (6, "u", "<p>one</p>"),
    (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "u", "y" * 3_000_000), (8, "u", "y" * 3_000_000), (None, "u", "<p>two é</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", b"clash") for p in PAGES], "page_id long, url string, html string, record_type string, payload binary").repartition(3)


def test_round_trip(pages):
    archives = warc.write(pages, archive_bytes=200)
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES)
    got = warc.read(archives).collect()
    last = {}
    for i, _, html in PAGES:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        response = i == last[html or ""]
        want[(i, len(data), "response" if response else "revisit", None if response else last[html or ""], data if response else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert {r.url for r in got if r.page_id == 4} == {"http://a/4%20x%0D%0Ay"} and {r.url for r in got if r.page_id == 3} == {None}


def test_small_payloads_are_all_responses(pages):
    assert {r.record_type for r in warc.read(warc.write(pages, min_bytes=11)).where("payload_bytes < 11").collect()} == {"response"}


def test_sql_agrees(spark, tmp_path, pages):
    pages.where("page_id IS NOT NULL").select("page_id", "url", "html").coalesce(1).write.parquet(f"{tmp_path}/p")
    con = oracle.connection("/nowhere")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    out = warc.read(warc.write(spark.read.parquet(f"{tmp_path}/p")), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert oracle.difference(out, con, warc.SQL) is None


def test_a_page_longer_than_a_batch_of_the_reader(spark):
    rows = [(1, "a", "x"), (2, "b", "<p>é</p>" * 3_000_000), (3, "c", "y"), (4, "d", None)]
    got = {r.page_id: r for r in warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == warc.digest(data) and bytes(got[i].payload) == data


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none)).collect() == []


def test_each_record_is_a_member():
    a, b = (warc.member(warc.Page(k, "u", b"x" * k), "1970-01-01T00:00:00Z") for k in (3, 200_000))
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    found = [warc.record(pieces) for pieces in warc.members(io.BytesIO(a + b))]
    assert [(r["page_id"], r["payload_bytes"]) for r in found] == [(3, 3), (200_000, 200_000)]
    assert found[0]["payload_digest"] == __import__("base64").b32encode(hashlib.sha1(b"xxx").digest()).decode()


@pytest.mark.parametrize("fault", ["payload", "length", "cut", "trailing"])
def test_faults_are_found(fault):
    data = gzip.decompress(warc.member(warc.Page(1, "u", b"payload here"), "1970-01-01T00:00:00Z"))
    if fault == "payload":
        data = data.replace(b"payload here", b"payload hare")
    elif fault == "length":
        data = re.sub(rb"(Content-Length: )(\d+)\r\n\r\nHTTP", lambda m: m[1] + str(int(m[2]) - 1).encode() + b"\r\n\r\nHTTP", data)
    elif fault == "trailing":
        data += b"more"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = press.compress(data) + press.flush()
    if fault == "cut":
        packed = packed[:-20]
    with pytest.raises(ValueError):
        [warc.record(p) for p in warc.members(io.BytesIO(packed))]


# --- language-model scores ---------------------------------------------------------------


def test_gradients():
    c = attention.classes([np.array([1, 2, 3, 4, 5, 6, 7] * 20)], 50)
    m = attention.Model(c)
    r = np.random.default_rng(1)
    m.top, m.leaf = r.normal(size=m.top.shape) / 5, r.normal(size=m.leaf.shape) / 5
    for k in attention._NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))
    inputs, targets, _ = attention.windows([np.array([1, 2, 3, 4, 5, 6, 7] * 6), np.array([5, 1])], c)
    _, g = m.gradients(inputs, targets)
    for k in attention._NAMES:
        w = getattr(m, k)
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        w[at] += 1e-3
        up = m.gradients(inputs, targets)[0]
        w[at] -= 2e-3
        down = m.gradients(inputs, targets)[0]
        w[at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=1e-5)


def test_gradients_stay_finite():
    texts = [np.array([1, 2, 3, 4, 5, 6, 7] * 20), np.zeros(0, np.int64)]
    for scale in (1e3, -1e3):
        m = attention.Model(attention.classes(texts, 50))
        m.top += np.float32(scale)
        m.leaf[:, ::2] += np.float32(scale)
        m.query *= np.float32(scale)
        loss, g = m.gradients(*attention.windows(texts, m.classes)[:2])
        assert math.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())


class _Watched(np.ndarray):
    """Notes the rows of what is multiplied with it."""

    seen: list[int] = []

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        if ufunc is np.matmul:
            self.seen.append(max(len(np.asarray(x)) for x in inputs))
        if "out" in kwargs:
            kwargs["out"] = tuple(np.asarray(x) for x in kwargs["out"])
        return getattr(ufunc, method)(*map(np.asarray, inputs), **kwargs)


def test_gradients_pass_each_input_through_its_layers_once():
    r = np.random.default_rng(3)
    texts = [r.integers(0, 300, n) for n in (5000, 40, 0)]
    m = attention.Model(attention.classes(texts, 300))
    m.top, m.leaf = (r.normal(size=x.shape).astype(np.float32) for x in (m.top, m.leaf))
    inputs, targets, _ = attention.windows(texts, m.classes)
    loss, g = m.gradients(inputs, targets)
    for k in ("query", "key", "value", "out", "shift"):
        setattr(m, k, getattr(m, k).view(_Watched))
    _Watched.seen.clear()
    watched, same = m.gradients(inputs, targets)
    assert _Watched.seen and max(_Watched.seen) <= len(m.embed) < targets.size
    assert watched == pytest.approx(loss) and all(np.allclose(g[k], same[k], atol=1e-6) for k in g)
    assert loss == pytest.approx(-m.each(texts).mean() + m.classes.within[targets[targets >= 0]].mean(), rel=1e-4)


def test_probabilities_sum_to_one_and_are_causal():
    r = np.random.default_rng(0)
    c = attention.classes([r.integers(0, 300, 5000)], 300)
    m = attention.Model(c)
    m.top, m.leaf = (r.normal(size=x.shape).astype(np.float32) for x in (m.top, m.leaf))
    start = r.integers(0, 300, 40)
    before = c.inputs[start[-1]]
    # of all continuations by one id, the ends included: P(start + id...) / P(start...) sums to one
    inputs, _, _ = attention.windows([start], c)
    shown = m.forward(inputs)["shown"].reshape(-1, attention.WIDTH + 1)
    place = shown[24 + (40 - 24)]  # the input after all of ``start``
    top = np.exp(place @ m.top + c.top[before])
    top /= top.sum()
    total = 0.0
    for i in range(301):
        leaf = np.exp(place @ m.leaf[c.group[i]] + c.leaf[before, c.group[i]])
        total += top[c.group[i]] * leaf[c.slot[i]] / leaf.sum() * math.exp(c.within[i])
    assert total == pytest.approx(1, abs=1e-3)
    other = start.copy()
    other[30:] = (other[30:] + 1) % 300
    a, b = (m.forward(attention.windows([x], c)[0])["shown"][:30] for x in (start, other))
    assert np.allclose(a, b, atol=1e-6)


def test_every_id_is_scored_once():
    c = attention.classes([np.arange(40)], 40)
    texts = [np.arange(n) % 40 for n in (0, 1, 23, 24, 25, 47, 48, 100)]
    inputs, targets, text = attention.windows(texts, c)
    for k, x in enumerate(texts):
        own = targets[text == k].ravel()
        assert own[own >= 0].tolist() == [*x, 40]
        assert (inputs[text == k][0, : attention.WINDOW - attention.STRIDE] == -1).all()
    m = attention.Model(c)
    alone = np.concatenate([m.log_probabilities([x]) for x in texts])
    assert np.allclose(alone, m.log_probabilities(texts), atol=1e-4)


def test_scoring_takes_attention_weights_from_a_table(monkeypatch):
    r = np.random.default_rng(5)
    texts = [r.integers(0, 300, n) for n in (0, 1, 7, 24, 25, 60_000)]
    c = attention.classes(texts, 300)
    m = attention.Model(c)
    for k in attention._NAMES:
        setattr(m, k, getattr(m, k) + r.standard_normal(getattr(m, k).shape).astype(np.float32) * 0.1)
    inputs, targets, _ = attention.windows(texts[:5] + [texts[5][:500]], c)
    real = targets.ravel() >= 0
    assert np.allclose(m.shown()(inputs)[real], m.forward(inputs)["shown"][real, : attention.WIDTH], atol=1e-4)
    sizes, real = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: sizes.append(np.size(x)) or real(x, *a, **b))
    out = m.each(texts)
    assert np.isfinite(out).all()
    table = (c.n_inputs + 1) ** 2 + attention.STRIDE * attention.WINDOW
    assert sum(sizes) - table <= len(out) * (attention.CLASSES + attention.SLOTS + 1)  # those of the output alone
    m.query *= 1000  # far apart: the weights stay finite
    assert np.isfinite(m.each(texts[:5])).all()


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def based(rows, train):
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows]
    counts = Counter(w for (i, _), x in zip(rows, tokens, strict=True) if train(i) for w in x)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for (i, _), x in zip(rows, tokens, strict=True)]


@pytest.mark.parametrize("common", [1 << 17, 5])
def test_base_matches_plain_counting(spark, common):
    rows = [(i, words(i, 30 + i, 500) + " ÉÀ Same SAME") for i in range(120)] + [(200, None), (201, ""), (202, "Ünseen only"), (5, "again 5"), (5, "again 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = lm_scoring.scored(docs.repartition(3), F.col("doc_id") % 3 != 0, tokenizer_file(), common=common).collect()
    want = based(rows, lambda i: i % 3 != 0)
    plain = lambda x: sorted((i, n, k, t, round(b, 6)) for i, n, k, t, b in x)
    assert plain((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == plain(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 5 and r.n_tokens == 3}) == 1


def test_model_learns(spark):
    docs = spark.createDataFrame([(i, " ".join(["the cat sat on the mat"] * 20) if i % 2 else words(i, 60, 5000)) for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.scored(docs, F.col("doc_id") < 150, tokenizer_file()).collect()}
    odd = [got[i].score / got[i].n_tokens for i in range(151, 200, 2)]
    even = [got[i].score / got[i].n_tokens for i in range(150, 200, 2)]
    assert max(even) < min(odd) and np.mean(odd) > -0.5


def test_odd_rows_lm(spark, odd_docs, no_docs):
    rows = lm_scoring.scored(odd_docs, F.lit(True), tokenizer_file(), text_bytes=1000).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) for r in rows)
    assert lm_scoring.scored(no_docs, F.lit(True), tokenizer_file()).collect() == []
    none = lm_scoring.scored(odd_docs, F.lit(False), tokenizer_file()).collect()
    assert {r.train_tokens for r in none} == {0} and {r.base_score for r in none} == {0.0}


def test_model_learns_from_texts_outside_the_sample(spark):
    rows = [(i, words(i, 60, 5000)) for i in range(120)]
    first = [r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").where("doc_id < 100").orderBy(F.xxhash64(F.lit("sample"), "doc_id")).limit(3).collect()]
    cats = [(i, t if i >= 100 or i in first else "the cat sat on the mat " * 10) for i, t in rows] + [(200, "mat on the cat sat the " * 10)]
    score = lambda x: {r.doc_id: r.score for r in lm_scoring.scored(spark.createDataFrame(x, "doc_id long, text string").repartition(3), F.col("doc_id") < 100, tokenizer_file(), rows=3).collect()}
    without, learnt = score([*rows, cats[-1]]), score(cats)
    assert learnt[200] > without[200] + 1


def _ids_of(spark, texts, parts=1):
    encode = lm_scoring.Encoder(tokenizer_file())
    own = [encode(lm_scoring._lower(t)) for t in texts]
    kind = lm_scoring._kind(encode.plain.get_vocab_size() + 1)
    return own, spark.createDataFrame([(x.astype(kind).tobytes(),) for x in own], "ids binary").repartition(parts), encode.plain.get_vocab_size()


def test_counts_cover_all_training_ids_however_dealt_out(spark):
    texts = [words(i, 40 + i, 300) for i in range(60)] + ["", None]
    found = []
    for parts in (1, 5):
        own, ids, vocabulary = _ids_of(spark, texts, parts)
        found.append(lm_scoring.classes_of(ids, vocabulary))
    a, b = found
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("inputs", "group", "slot", "within", "top", "leaf"))
    follow = Counter()
    for x in own:
        before = vocabulary
        for i in [*x.tolist(), vocabulary]:
            follow[a.inputs[before], a.group[i], a.slot[i]] += 1
            before = i
    row = attention.flat(own, vocabulary)
    got = attention.pairs(row, a).reshape(a.n_inputs, attention.CLASSES, attention.SLOTS)
    assert got.sum() == len(row) and all(got[k] == n for k, n in follow.items())


def _numbers(m):
    return np.concatenate([getattr(m, k).ravel() for k in attention._NAMES]).astype(float)


def test_layers_learn_from_texts_outside_the_sample(spark, monkeypatch):
    begun, real = [], attention.trained

    def trained(texts, c):
        begun.append((len(texts), real(texts, c, steps=20), real(texts, c, steps=20)))
        return begun[-1][1]

    monkeypatch.setattr(attention, "trained", trained)
    rows = [(i, words(i % 7, 150, 60)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lm_scoring.scored(docs, F.col("doc_id") < 70, tokenizer_file(), rows=3).count()
    encode = lm_scoring.Encoder(tokenizer_file())
    (n, model, begin), all_ids = begun[0], [encode(t) for _, t in rows]
    assert n == 3 and not np.array_equal(_numbers(model), _numbers(begin))
    assert model.log_probabilities(all_ids[:70]).sum() > begin.log_probabilities(all_ids[:70]).sum()


def test_layers_are_the_mean_of_passes_through_all_ids_however_dealt_out(spark):
    texts = [words(i % 9, 60 + i, 80) for i in range(50)] + ["", None]
    own, ids, vocabulary = _ids_of(spark, texts)
    c, kind = lm_scoring.classes_of(ids, vocabulary), lm_scoring._kind(vocabulary + 1)
    rows = spark.createDataFrame([(k, x.astype(kind).tobytes()) for k, x in enumerate(own)], "doc_id long, ids binary")
    n = sum(len(x) + 1 for x in own)
    found = []
    for shard_ids, parts in ((n // 9, 1), (n // 9, 7)):  # ten shards in four rounds
        m = attention.Model(c)
        lm_scoring.learn(rows.repartition(parts), m, kind, shard_ids)
        found.append(_numbers(m))
    assert np.allclose(*found, rtol=0, atol=1e-6)
    hashes = [r[0] for r in rows.select(F.xxhash64("doc_id", "ids")).collect()]
    shards = -(-n // (n // 9))
    m, seen = attention.Model(c), 0
    for k in range(lm_scoring.ROUNDS):
        start, moves, sizes = _numbers(m), [], []
        for shard in range(k, shards, lm_scoring.ROUNDS):
            held = [own[i] for i in sorted(range(len(own)), key=hashes.__getitem__) if hashes[i] % shards == shard]
            parts = [[]]
            for x in held:
                if sum(len(y) + 1 for y in parts[-1]) >= 2 * (n // 9):
                    parts.append([])
                parts[-1].append(x)
            for part in filter(None, parts):
                m.put(start)
                attention.passed(m, part)
                moves.append(_numbers(m) - start)
                sizes.append(sum(len(x) + 1 for x in part))
        m.put(start + (np.average(moves, 0, sizes) if sizes else 0))
        seen += sum(sizes)
    assert seen == n and np.allclose(_numbers(m), found[0], rtol=0, atol=1e-5)
    none = attention.Model(c)
    lm_scoring.learn(rows.where("false"), none, kind)
    assert np.array_equal(_numbers(none), _numbers(attention.Model(c)))


def test_cuts_and_hashes_follow_the_ids_alone():
    r = np.random.default_rng(3)
    passage = r.integers(0, 5000, 400)
    texts = [np.concatenate([r.integers(0, 5000, n), passage, r.integers(0, 5000, 7)]) for n in (0, 1, 50)] + [np.zeros(0, np.int64)]
    row = attention.flat(texts, 60_000)
    stops = np.cumsum([len(x) + 1 for x in texts])
    starts, hashes = passages.cut(row, stops - 1, 60_000)
    bounds = [*starts.tolist(), len(row)]
    stretches = [tuple(row[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert sum(map(len, stretches)) == len(row) and set(stops - 1) <= {b - 1 for b in bounds}
    assert len(set(stretches)) == len(set(hashes.tolist())) == len(set(zip(stretches, hashes.tolist(), strict=True)))
    shared = [s for s, n in Counter(stretches).items() if n == 3]
    assert sum(map(len, shared)) > 250


def _plainly_scored(rows, train, model, vocabulary, encode):
    """Scores by loops over places and dictionaries."""
    c = model.classes
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    texts = [[*encode(lm_scoring._lower(t)).tolist(), vocabulary] for _, t in rows]

    def logs(ids):
        seen, out = [vocabulary, *ids[:-1]], []
        for p, i in enumerate(ids):
            low = max(0, p // attention.STRIDE * attention.STRIDE - (attention.WINDOW - attention.STRIDE))
            h = [model.embed[c.inputs[x]].astype(float) for x in seen[low : p + 1]]
            a = np.array([h[-1] @ model.query @ (x @ model.key) / math.sqrt(attention.WIDTH) + model.bias[len(h) - 1 - k] for k, x in enumerate(h)])
            z = np.exp(soft(a)) @ np.array([x @ model.value for x in h])
            before = model.embed[c.inputs[seen[p - 1]]] if p > low or low else model.embed[-1]
            mid = h[-1] + z @ model.out + before @ model.shift
            top = mid + np.maximum(np.append(mid, 1) @ model.up, 0) @ model.down
            shown = np.append(top / math.sqrt((top**2).mean() + 1e-5), 1)
            k, at = c.group[i], c.inputs[seen[p]]
            out.append(soft(shown @ model.top + c.top[at])[k] + soft(shown @ model.leaf[k] + c.leaf[at, k])[c.slot[i]] + c.within[i])
        return out

    def stretches(ids):
        flat = np.array(ids)
        bounds = [*passages.cut(flat, np.array([len(ids) - 1]), vocabulary)[0].tolist(), len(ids)]
        return list(zip(bounds, bounds[1:], strict=False))

    cuts = [[tuple(x[a:b]) for a, b in stretches(x)] for x in texts]
    counts = Counter(s for (i, _), own in zip(rows, cuts, strict=True) if train(i) for s in own)
    n, v = sum(counts.values()), len(counts)
    once, twice = (sum(k == x for x in counts.values()) for k in (1, 2))
    d = min(max(once / max(once + 2 * twice, 1), passages.LEAST), passages.MOST)
    out = []
    for (i, _), ids, own in zip(rows, texts, cuts, strict=True):
        p, mine, score = np.exp(logs(ids)), Counter(own), 0.0
        for (a, b), s in zip(stretches(ids), own, strict=True):
            others = counts[s] - (mine[s] if train(i) else 0)
            score += math.log10(max(others - d, 0) * (others > 0) / n + d * v / n * p[a:b].prod())
        out.append((i, score))
    return out


def test_score_matches_plain_loops(spark, monkeypatch):
    rows = [(i, words(i % 9, 12 + i % 5, 60)) for i in range(40)] + [(40, None), (41, ""), (42, "Ünd more ✓")]
    rows += [(43, words(77, 90, 200)), (44, words(77, 90, 200)), (45, words(77, 90, 200) + " tail")]
    kept, real = [], attention.trained
    monkeypatch.setattr(attention, "trained", lambda texts, c: kept.append(real(texts, c, steps=40)) or kept[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_scoring.scored(docs, F.col("doc_id") % 4 != 0, tokenizer_file()).collect()}
    encode = lm_scoring.Encoder(tokenizer_file())
    for i, want in _plainly_scored(rows, lambda i: i % 4 != 0, kept[0], encode.plain.get_vocab_size(), encode):
        assert got[i] == pytest.approx(want, rel=2e-4, abs=2e-3), i


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_texts_score_above_the_base_and_copies_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = lm_scoring.scored(docs, ~held_out, tokenizer_file()).join(docs, "doc_id").select("*", held_out.alias("held"), F.count("*").over(Window.partitionBy("text")).alias("copies")).where("n_tokens > 30").toPandas()
    held = out[out.held]
    assert held.score.sum() > held.base_score.sum()
    each = out.score / out.n_tokens
    bound = each[out.copies == 1].quantile(0.9)
    assert (each[out.copies > 1] > bound).mean() > 0.75
