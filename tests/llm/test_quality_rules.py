import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import quality_rules, scan
from tests import oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(text):
    words = WORD.findall(text)
    grams = lambda n: list(zip(*(words[k:] for k in range(n)), strict=False))
    inside = {}
    for n in (3, *quality_rules.NGRAM_LIMITS):
        counts = Counter(grams(n))
        inside[n] = {i + k for i, g in enumerate(grams(n)) if counts[g] > 1 for k in range(n)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    shares = [sum(len(words[i]) for i in inside[n]) / max(chars, 1) for n in quality_rules.NGRAM_LIMITS]
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside[3]), shares


def measured(texts):
    out = []
    for _, _, t in scan.texts_of(pa.array(texts, pa.string()), 200):
        m = quality_rules.measures(t)
        out += [(int(m["n_words"][i]), int(m["word_chars"][i]), int(m["n_symbols"][i]), int(m["n_dup_lines"][i]), int(m["n_repeat_words"][i]), (m["dup_ngram_chars"][i] / max(m["word_chars"][i], 1)).tolist()) for i in range(t.n)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab é#|\n\t\r 語")), max_size=80), min_size=1, max_size=6))
def test_measures_match_plain_counting(texts):
    for got, text in zip(measured(texts), texts, strict=True):
        want = plainly(text)
        assert got[:5] == want[:5]
        assert np.allclose(got[5], want[5])


def test_odd_rows(spark, odd_docs, no_docs):
    out = quality_rules.measure(odd_docs)
    assert "kept" in out.columns and out.columns.count("kept") == 1 and "score" in out.columns
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[4].n_words == 60_000 and by_id[4].kept
    assert len([r for r in rows if r.doc_id == 4]) == 2
    assert by_id[10].n_dup_lines == 1
    assert quality_rules.measure(no_docs).collect() == []
    kept = quality_rules.kept_rows(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_verdict(spark):
    clean = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, clean), (2, clean + "\n" + " ".join(["again and again so"] * 60)), (3, " ".join(f"w{i}###" for i in range(100))), (4, "header line here\n" + clean + "\nheader line here")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.measure(docs).collect()} == {1: True, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("length", [5, 6, 7, 8, 9, 10, 40])
def test_coverage_alone_decides(length):
    """Passages of some length that stand twice, among words that stand once: the base rule passes them all."""
    fresh = (f"word{i}" for i in itertools.count())
    take = lambda n: " ".join(itertools.islice(fresh, n))

    def text(passages):
        parts = [take(length) for _ in range(passages)]
        return take(200) + " " + " ".join(f"{x} {take(length)} {x} {take(length)}" for x in parts)

    many = 1 + 120 // length
    (_, _, t), = scan.texts_of(pa.array([text(many), text(0) + take(200), text(1) if length <= 5 else take(400)]), 1 << 30)
    m = quality_rules.measures(t)
    failed, kept = quality_rules.verdicts(m, quality_rules.NGRAM_LIMITS)
    assert not failed.any() and kept.tolist() == [False, True, True]
    m["dup_ngram_chars"][:] = 0
    m["dup_line_chars"][:] = 0
    assert quality_rules.verdicts(m, quality_rules.NGRAM_LIMITS)[1].all()


def test_repeated_lines_alone_decide():
    lines = [" ".join(f"{c}{k}" for k in range(4)) for c in "abcdefghijklmnopqrstuvw"]  # under five words: no n-gram repeats
    doubled = "\n".join(f"{x}\nl{k} m{k} n{k} o{k} p{k}" for k, x in enumerate(lines)) + "\n" + "\n".join(f"{x}\nq{k} r{k} s{k} t{k} u{k}" for k, x in enumerate(lines))
    (_, _, t), = scan.texts_of(pa.array([doubled]))
    m = quality_rules.measures(t)
    assert not m["dup_ngram_chars"].any() and m["n_dup_lines"].tolist() == [23]
    failed, kept = quality_rules.verdicts(m, quality_rules.NGRAM_LIMITS)
    assert not failed.any() and not kept.any()


def test_sql_agrees(spark, tmp_path):
    fresh = (f"word{i}" for i in itertools.count())
    take = lambda n: " ".join(itertools.islice(fresh, n))
    passage, rows = take(30), [None, "", take(49), take(50)]
    rows += [take(60 + 20 * k) + "\n" + passage + "\n" + take(20) + "\n" + passage for k in range(20)]
    rows += ["short line here\n" * k + take(70) for k in range(1, 14)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = oracle.connection("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    out = quality_rules.measure(spark.read.parquet(f"{tmp_path}/documents"), keep=["doc_id"])
    assert 5 < out.where("NOT base_failed AND NOT kept").count() < 25
    assert oracle.difference(out, con, quality_rules.SQL) is None
