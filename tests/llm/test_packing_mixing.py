import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, scan
from quarry.llm.queries import tokenizer_file
from tests import oracle
from tests.llm.conftest import words


def one_by_one(counts, capacity):
    """Best-two-fit a sequence at a time, without multiplicities."""
    left = Counter(counts)
    out = []
    while left:
        used, gap = [], capacity
        while fits := [k for k in left if k <= gap]:
            k = max(fits)
            used.append(k)
            left[k] -= 1
            left += Counter()
            gap -= k
        if gap:
            room, best = gap + used[-1], None
            for a in left:
                for b in left:
                    if b <= a and a + b <= room and a + b > (sum(best) if best else used[-1]) and (a != b or left[a] > 1):
                        best = (a, b)
            if best:
                left[used.pop()] += 1
                for k in best:
                    used.append(k)
                    left[k] -= 1
                left += Counter()
        out.append(tuple(sorted(used)))
    return Counter(out)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_the_greedy_one(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 61): r.randrange(1, 30) for _ in range(r.randrange(1, 14))}
    planned = packing.plan(counts, 60)
    placed = Counter()
    for used, times in planned:
        assert sum(used) <= 60 and times > 0
        for k in used:
            placed[k] += times
    assert placed == Counter(counts)
    want = one_by_one(counts, 60)
    assert sum(times for _, times in planned) == sum(want.values())


def test_two_fit_beats_plain_greedy():
    # greedy alone fills 6 + 3 and leaves 1 open; 6 + 2 + 2 is full
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]


def test_cut():
    assert list(packing.cut(5, 4)) == [(0, 1), (1, 4)]
    assert list(packing.cut(8, 4)) == [(0, 4), (4, 4)]
    assert list(packing.cut(4, 4)) == [(0, 4)]
    assert list(packing.cut(1, 4)) == [(0, 1)]


def test_pack_round_trip(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_file()
    plain = Tokenizer.from_file(path)
    special = spark.createDataFrame([(20, "a<|endoftext|>b", "en", "s", 1, 1.0, None, 1, 1, "x")], odd_docs.schema)
    docs = odd_docs.unionByName(special)
    out = packing.pack(docs, path, with_ids=True)
    rows = out.collect()
    want = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, (start, length) in enumerate(packing.cut(len(ids))):
            want[(r.doc_id, k, start, tuple(ids[start : start + length]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    total = sum(r.length for r in rows)
    assert len(sequences) == -(-total // packing.CAPACITY)
    assert out.columns.count("sequence_id") == 1
    assert packing.pack(no_docs, path).collect() == []


def test_many_equal_lengths(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(3000)], "doc_id long, text string")
    out = packing.pack(docs, tokenizer_file(), capacity=10)
    assert out.count() == 3000
    places = out.groupBy("sequence_id", "offset").count()
    assert places.agg(F.max("count")).first()[0] == 1


def test_mix_matches_sql(spark, tmp_path):
    rows = [(i, words(i, 5 + i % 90) if i % 11 else None, None if i % 13 == 0 else "en", None if i % 17 == 0 else f"s{i % 4}" if i % 3 else "hot", i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = oracle.connection("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert oracle.difference(mixing.mixed(spark.read.parquet(f"{tmp_path}/d")), con, mixing.SQL) is None


def test_mix_meets_its_targets(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "big" if i % 3 else "small") for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.mixed(docs, {"big": 1.0, "small": 3.0}, epochs=2.0)
    got = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got["big"] == pytest.approx(3000, rel=0.08) and got["small"] == pytest.approx(9000, rel=0.05)
    some = out.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).select("n").toPandas().n
    zero = 2000 - len(some)
    assert zero / 2000 == pytest.approx(np.exp(-4.5), abs=0.01)  # Poisson with mean 4.5
    assert some.var() + 0 == pytest.approx(4.5, rel=0.15)
    huge = mixing.mixed(docs.limit(40), {"big": 1e6, "small": 1e-9}, epochs=200.0)
    assert huge.where("source = 'big'").groupBy("doc_id").count().agg(F.avg("count")).first()[0] == pytest.approx(40 * 200 / 27, rel=0.1)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mixed(odd_docs, epochs=5.0)
    assert out.columns.count("copy") == 1
    rows = out.collect()
    assert rows and {r.source for r in rows} <= {"s", None}
    four = Counter(r.copy for r in rows if r.doc_id == 4)
    assert all(n == 2 for n in four.values())  # a repeated row is copied as often
    assert mixing.mixed(no_docs).collect() == []
    assert mixing.mixed(odd_docs, {}).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_file())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abcs'  \t\n\r.,-7語é  　\x1c\x85")), max_size=30), min_size=1, max_size=8))
def test_ids_are_those_of_the_tokenizer(encoder, texts):
    texts = [*texts, "<|endoftext|> a", "a b a b"]
    got = [x for _, _, t in scan.texts_of(pa.array(texts), 40) for x in encoder.each(t)]
    assert encoder.fast is not None
    assert [x.tolist() for x in got] == [encoder.plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_file_whose_merges_are_not_by_rank_goes_the_plain_way(tmp_path):
    import json

    from tokenizers import Tokenizer

    own = json.loads(Tokenizer.from_file(tokenizer_file()).to_str())
    a, b = (own["model"]["vocab"]["".join(m)] for m in own["model"]["merges"][:2])
    own["model"]["merges"][:2] = own["model"]["merges"][1::-1]
    assert a < b
    path = tmp_path / "turned.json"
    path.write_text(json.dumps(own))
    encoder = packing.Encoder(str(path))
    assert encoder.fast is None and encoder("the cat  sat").tolist() == encoder.plain.encode("the cat  sat", add_special_tokens=False).ids
