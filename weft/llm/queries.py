"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, chat, decontaminate, flac, hilbert, langid, linededup, minhash, sstable, toxicity
from weft.plans.lineage import stored
from weft.plans.tables import table

BYTE_BPE = "byte_bpe_50k.json"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digests(rows.unionByName(more))


def op2_line_site_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op3_langid_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.report(table(spark, sf_dir, "documents"), shards=40)


def op5_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate_ngram_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_flac_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(flac.store_media(table(spark, sf_dir, "documents")), "flac-media", codec="zstd")
    return flac.media_features(media)


def op9_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op10_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)
    return sstable.digest_shards(manifest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_line_site_frequency": op2_line_site_frequency,
    "op3_langid_family_svm": op3_langid_family_svm,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_toxicity_counterfactual": op5_toxicity_counterfactual,
    "op6_decontaminate_ngram_set": op6_decontaminate_ngram_set,
    "op7_bpe_rank_array": op7_bpe_rank_array,
    "op8_flac_column": op8_flac_column,
    "op9_minhash_tensored": op9_minhash_tensored,
    "op10_sstable_shards": op10_sstable_shards,
}

ORACLE: dict[str, str] = {"op1_chat_windows": chat.SQL, "op2_line_site_frequency": linededup.SQL, "op6_decontaminate_ngram_set": decontaminate.SQL}
