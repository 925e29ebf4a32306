import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import packing
from quarry.llm.queries import QUERIES
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean, toxic, junk and near-copied documents."""
    r, root, rows, labels = random.Random(8), tmp_path_factory.mktemp("sf"), [], []
    for i in range(240):
        text = words(i, r.randrange(80, 200), 4000)
        toxic, junk = i % 6 == 0, i % 7 == 0
        if toxic:
            text += " " + " ".join(r.choices(["grumble", "fiend", "zounds"], k=3))
        if junk:
            passage = words(9000 + i, 25, 4000)
            text = f"{passage} {text} {passage}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    near = words(5001, 300, 4000).split()
    for k in range(5):
        copy = list(near)
        copy[17 * k] = f"changed{k}"
        rows.append((1000 + k, " ".join(copy), "en", "s0", 1))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    toxic_free, good, single, mixed, packed = ids
    assert {i for i in toxic_free if i < 1000} == {i for i in range(240) if i % 6}
    assert {i for i in good if i < 1000} == {i for i in range(240) if i % 6 and i % 7}
    assert [i for i in single if 1000 <= i < 2000] == [1000] and set(single) <= set(good)
    assert set(mixed) <= set(single) and 0.6 < len(mixed) / len(single) < 1.5
    assert set(packed) == set(mixed)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= packing.CAPACITY


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 50


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
