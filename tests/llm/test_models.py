"""Toxicity, quality and language models, and the samples they learn from."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, quality_model, scan, toxicity, training
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def judged(spark):
    """Toxic texts hold one of five words; bad texts are full of signs."""
    r, rows, labels = random.Random(5), [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = words(i, r.randrange(40, 160))
        if bad:
            text = " ".join(w + "###" for w in text.split())
        if toxic:
            parts = text.split()
            for w in r.sample(["grumble", "fiend", "vileness", "zounds", "scallywag"], 2):
                parts.insert(r.randrange(len(parts)), w)
            text = " ".join(parts)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "target", "folds", "held_out"), [(toxicity, "toxic", 3, 1), (quality_model, "quality", 4, 2)])
def test_held_out_accuracy(judged, module, target, folds, held_out):
    docs, labels = judged
    model = module.trained(docs, labels)
    fold = training.fold("doc_id", folds) == held_out
    rows = module.scored(docs, model).join(labels, "doc_id").where(fold).select("score", target).collect()
    assert len(rows) > 80
    assert np.mean([(r.score >= 0.7) == (r[target] == 1) for r in rows]) > 0.97
    again = module.scored(docs.repartition(5), module.trained(docs.repartition(4), labels.repartition(2)))
    a = {r.doc_id: r.score for r in module.scored(docs, model).collect()}
    assert all(abs(a[r.doc_id] - r.score) < 1e-6 for r in again.collect())


def test_held_out_labels_are_never_seen(judged):
    docs, labels = judged
    fold = training.fold("doc_id", 3) == 1
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.trained(docs, labels), toxicity.trained(docs, turned)
    assert (a.codes == b.codes).all() and (a.weights == b.weights).all()


def test_odd_rows(spark, judged, odd_docs, no_docs):
    docs, labels = judged
    odd_labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_model):
        out = module.scored(odd_docs, module.trained(docs, labels.unionByName(odd_labels)))
        assert out.columns.count("score") == 1
        rows = out.collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.scored(no_docs, module.trained(no_docs, labels.limit(0))).collect() == []
        assert all(0 <= r.score <= 1 for r in module.scored(odd_docs, module.trained(odd_docs, odd_labels)).collect())
    assert toxicity.clean_rows(docs, labels).columns == docs.columns


def test_label_model_finds_the_class_and_counts_copies_once():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.2
    votes = [(truth & (r.random(4000) < 0.6)) | (r.random(4000) < 0.004) for _ in range(6)]
    alone, known = toxicity.label_model(np.stack(votes, 1))
    assert np.mean((alone > 0.5) == truth) > 0.97 and (known.leader == -1).all()
    assert abs(known.rates[1, 0, 1] - 0.6) < 0.08 and known.rates[0, 0, 1] < 0.02
    echo = votes[0] & (r.random(4000) < 0.9)  # mostly repeats the first voter
    posterior, known = toxicity.label_model(np.stack([*votes, echo], 1))
    assert known.leader.tolist() == [-1] * 6 + [0]
    assert abs(known.rates[1, 1, 6] - 0.9) < 0.05 and abs(known.rates[0, 1, 6] - 0.9) < 0.2
    one = np.zeros((2, 7), np.float32)
    one[:, 0] = 1
    one[1, 6] = 1
    first, both = known.evidence(one)
    assert abs(both - first) < 0.3 < first
    assert np.abs(posterior - alone).max() < 0.2


def test_codes_that_share_low_bits_all_count():
    codes = np.array([5, 5 + (1 << 22), 5 + (1 << 40)], np.uint64)
    slots, shift = toxicity._table(codes)
    assert slots[(codes >> shift) & np.uint64((1 << 22) - 1)].tolist() == [0, 1, 2]


def test_toxicity_scores_match_plain_sums(judged):
    docs, labels = judged
    model = toxicity.trained(docs, labels)
    texts = ["grumble FIEND!! zounds", "plain words only", "", "Fiends fiendish", None]
    slow = []
    for text in texts:
        text = text or ""
        words_ = re.findall(r"[A-Za-z\u0080-\uffff]+", text)
        (_, _, t), = scan.texts_of(pa.array([" ".join(x.lower()[:w] if w else x.lower() for w in (0, *toxicity.PREFIXES) for x in words_ if not w or len(x) > w)]))
        widths = [w for w in (0, *toxicity.PREFIXES) for x in words_ if not w or len(x) > w]
        names = {int(c) for c in scan.mixed(t.word_hashes() + np.array(widths, np.uint64))}
        on = [k for k, c in enumerate(model.codes.tolist()) if c in names]
        shapes = [sum(k < model.lexicon for k in on) >= 2, "!!" in text, sum("A" <= c <= "Z" for c in text) > sum("a" <= c <= "z" for c in text)]
        slow.append(1 / (1 + math.exp(-(model.bias + sum(model.weights[on]) + sum(w for w, s in zip(model.weights[len(model.codes) :], shapes, strict=True) if s)))))
    (_, _, t), = scan.texts_of(pa.array(texts))
    assert model.scores(t, toxicity._table(model.codes)) == pytest.approx(slow, rel=1e-5)
    assert slow[0] > 0.7 > slow[1]


def test_factorisation_identity():
    t = next(scan.texts_of(pa.array(["a b c a", "", "dd ee"])))[2]
    rows = quality_model.inputs(t)
    r = np.random.default_rng(1)
    n = quality_model._N + len(quality_model.STATISTICS) + quality_model.SIZE_CLASSES
    model = quality_model.Model(0.3, r.normal(size=n), r.normal(size=(n, quality_model.RANK)))
    got = model.parts(rows)[0]
    for d in range(3):
        on = rows.doc == d
        x = np.zeros(n)
        x[rows.at[on]] = rows.x[on]
        used = np.flatnonzero(x)
        pairs = sum((model.v[i] @ model.v[j]) * x[i] * x[j] for i in used for j in used if i < j)
        assert got[d] == pytest.approx(0.3 + model.w @ x + pairs, rel=1e-5)


def test_chain_marginals_match_enumeration():
    r = np.random.default_rng(2)
    sizes = [0, 1, 5, 3, 0]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores, transitions = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    for block in (1, 2, 32):
        got = language.marginals(scores, bounds, transitions, block)
        for a, b in zip(bounds, bounds[1:], strict=False):
            total, want = 0.0, np.zeros((b - a, 3))
            for path in np.ndindex(*[3] * (b - a)):
                start = np.exp(transitions).mean(0)[path[0]] if path else 1.0
                p = start * np.exp(sum(scores[a + i, k] for i, k in enumerate(path)) + sum(transitions[j, k] for j, k in zip(path, path[1:], strict=False)))
                total += p
                for i, k in enumerate(path):
                    want[i, k] += p
            assert np.allclose(got[a:b], want / total)


@pytest.fixture(scope="module")
def tongues(spark):
    stems = {"xx": "ka ko ki ku mo".split(), "yy": "sel ter lin ver".split(), "zz": "ñao ñie ürg öss".split()}
    r, rows = random.Random(3), []
    for i in range(300):
        lang = list(stems)[i % 3]
        rows.append((i, " ".join("".join(r.choices(stems[lang], k=r.randrange(1, 4))) for _ in range(40)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark, tongues, odd_docs, no_docs):
    model = language.trained(tongues)
    held = training.fold("doc_id", 5) == 0
    rows = language.identified(tongues.where(held), model).collect()
    assert len(rows) > 30 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    mixed = spark.createDataFrame([(1, "kako kiku moka " * 10 + "selter linver " * 3)], "doc_id long, text string")
    (got,) = language.identified(mixed, model).collect()
    assert got.lang_pred == "xx" and 0.7 < got.score < 0.95
    by_id = {r.doc_id: r for r in language.identified(odd_docs, model).collect()}
    assert [by_id[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4
    assert by_id[8].lang_pred != "und" and by_id[4].lang_pred in ("xx", "yy", "zz")
    assert language.identified(no_docs, model).collect() == []
    assert {r.lang_pred for r in language.identified(odd_docs, language.trained(no_docs)).collect()} == {"und"}


def test_sample_is_bounded_and_does_not_depend_on_order(judged):
    docs, labels = judged
    a = training.sample(docs, labels, "toxic", training.fold("doc_id", 3) != 1, rows=50)
    b = training.sample(docs.repartition(7), labels.repartition(3), "toxic", training.fold("doc_id", 3) != 1, rows=50)
    assert a.num_rows == 50 and a.to_pylist() == b.to_pylist()
    small = training.sample(docs, labels, "toxic", F.lit(True), rows=500, text_bytes=5_000)
    assert 0 < sum(map(len, small["text"].to_pylist())) <= 5_000


def test_a_text_over_the_bound_does_not_end_the_sample(spark):
    order = [r.doc_id for r in spark.range(40).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64(F.lit("sample"), "doc_id")).collect()]
    for at in (0, 7):
        long = order[at]
        docs = spark.createDataFrame([(i, "x" * (2_000 if i == long else 20)) for i in order], "doc_id long, text string")
        labels = docs.select("doc_id", F.lit(1).alias("toxic"))
        assert training.sample(docs, labels, "toxic", F.lit(True), rows=39, text_bytes=1_000)["text"].to_pylist() == ["x" * 20] * 39


def test_models_are_the_same_with_a_text_beyond_the_bound(spark, judged, tongues):
    """A 30 MB text that comes first in the sample's order changes no prediction of the others."""
    docs, labels = judged
    first = [r.doc_id for r in spark.range(5_000, 500_000).select(F.col("id").alias("doc_id")).where(training.fold("doc_id", 60) == 8).orderBy(F.xxhash64(F.lit("sample"), "doc_id")).limit(1).collect()][0]
    long = docs.limit(1).select(F.lit(first).cast("long").alias("doc_id"), F.repeat(F.lit("grumble ka "), 30 * (1 << 20) // 11).alias("text"))
    for module, target in ((toxicity, "toxic"), (quality_model, "quality")):
        more = labels.unionByName(spark.createDataFrame([(first, 0, 1)], "doc_id long, quality int, toxic int"))
        a, b = module.trained(docs, labels), module.trained(docs.unionByName(long), more)
        x, y = ({r.doc_id: r.score for r in module.scored(docs, m).collect()} for m in (a, b))
        assert x == y, target
    a, b = language.trained(tongues), language.trained(tongues.unionByName(long.withColumn("lang", F.lit("yy"))))
    x, y = ([(r.doc_id, r.lang_pred, r.score) for r in language.identified(tongues, m).orderBy("doc_id").collect()] for m in (a, b))
    assert x == y and {r[1] for r in x} == {"xx", "yy", "zz"}
