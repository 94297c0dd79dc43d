"""The registered queries of this subpackage: op1 ... op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, media_audio, mixing, packing, sharding, simhash, suffix_dedup, token_counts, topk_search, toxicity
from .common import table, tokenizer_path
from .oracles import ORACLES


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.external_shuffle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *sharding.ADDED)


def op3_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra), tokenizer_path("byte_bpe_50k.json")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk_search.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)
    return out.select("query_id", "rank", "vec_id", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_labelled(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_audio.store_audio(table(spark, sf_dir, "documents"))
    return media_audio.decode_audio(stored)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
