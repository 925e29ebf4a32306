"""One thin query for each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import embedding_dedup, language, lm_scoring, mixing, near_dedup, packing, quality_model, quality_rules, toxicity, training, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_poisson_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op3_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identified(docs.select("doc_id", "text"), language.trained(docs, folds=5, held_out=0))
    return found.select("doc_id", (training.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.trained(docs, _table(spark, sf_dir, "labels"), "quality", folds=4, held_out=2)
    return _judged(quality_model.scored(docs, model), 4, 2)


def op5_p_stable_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicated(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, _table(spark, sf_dir, "labels"), "toxic", folds=3, held_out=1)
    return _judged(toxicity.scored(docs, model), 3, 1)


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


def op8_sequential_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.grouped(_table(spark, sf_dir, "documents"))


def op10_causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = training.fold("doc_id", 7) == 2
    scored = lm_scoring.scored(docs, ~held_out, tokenizer_file())
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _judged(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", (training.fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_replication": op1_poisson_replication,
    "op2_repetition_coverage": op2_repetition_coverage,
    "op3_chain_crf": op3_chain_crf,
    "op4_factorisation_machine": op4_factorisation_machine,
    "op5_p_stable_hashing": op5_p_stable_hashing,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_sequential_warc": op8_sequential_warc,
    "op9_bagminhash": op9_bagminhash,
    "op10_causal_attention": op10_causal_attention,
}

ORACLE_SQL: dict[str, str] = {
    "op1_poisson_replication": mixing.SQL,
    "op2_repetition_coverage": quality_rules.SQL,
    "op5_p_stable_hashing": embedding_dedup.SQL,
    "op8_sequential_warc": warc.SQL,
    "op9_bagminhash": near_dedup.SQL,
}
