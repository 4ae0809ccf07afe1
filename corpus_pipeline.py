"""The training-corpus pipeline: five operators, one after another.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``, whatever further ones there are and whatever
their names.

Results for odd input: documents with null or empty texts, or texts without a
letter, go at the first stage; a null source is one more host; rows of one id
are one document to the near-duplicate stage, which keeps one of them, and
rows without an id all stay; a text that loses all its lines stays as an empty
one, like no other; equal documents are near-duplicates; benchmark items
without text match nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, decontaminate, langid, linededup, minhash
from weft.llm.arrow import fresh
from weft.plans.lineage import stored
from weft.plans.tables import table

#: Shingle words and percent of similarity of the near-duplicate stage.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: A prediction below this score is a rejection.
LEAST_LANGUAGE_SCORE = 0.1
VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, or that no language's machine accepts."""
    model = langid.train(docs, ~langid.held_out())
    lang, score = (fresh(c, docs.columns) for c in ("lang", "score"))
    found = langid.identify(docs, model, docs.columns, lang, score)
    kept = found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each source's boilerplate lines; ``n_chars`` follows the text."""
    cleaned = linededup.deduplicate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return minhash.deduplicate(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), action="drop")


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digest_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

#: SVM training, MinHash and BPE are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
