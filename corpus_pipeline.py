"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a table
with the columns of documents; the last returns packed pieces. Scratch tables of a stage are deleted
when the next begins, since its result has been written by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontamination, jaccard_join, language_id, packing, shared, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has less of the likelihood than this is rejected.
LEAST_SCORE = 0.5
#: Near copies share 0.8 or more of their runs of five words.
NEAR = jaccard_join.Likeness(5, 8, 10)
_SCOPE = "pipeline"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or that no language fits clearly, go."""
    shared.release(spark, _SCOPE)
    with shared.scope(_SCOPE):
        docs = shared.only(docs, *COLUMNS)
        judged = language_id.predict(spark, docs, language_id.fit(spark, docs))
        return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    shared.release(spark, _SCOPE)
    with shared.scope(_SCOPE):
        return jaccard_join.one_of_each(spark, shared.only(docs, *COLUMNS), NEAR).select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what repeats, but for one place of it; those of which nothing stays go, since others hold all of them."""
    shared.release(spark, _SCOPE)
    with shared.scope(_SCOPE):
        cut = suffix_dedup.remove_repeats(spark, shared.only(docs, *COLUMNS), as_text=True, keep_first=True)
        kept = cut.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
        size = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
        return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", size.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    shared.release(spark, _SCOPE)
    with shared.scope(_SCOPE):
        benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        return decontamination.clean_documents(spark, shared.only(docs, *COLUMNS), benchmark).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    shared.release(spark, _SCOPE)
    with shared.scope(_SCOPE):
        return packing.pack(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("suffix_dedup", remove_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: SQL has no language models, tokenizers or edit distances over windows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared.shared_dir(spark)}/loomstone-run-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
