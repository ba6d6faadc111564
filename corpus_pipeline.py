"""The corpus pipeline: language, quality, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last returns the pieces of the packed sequences. ``run``
stores every stage under ``spark.checkpoint.dir`` before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.llm import jaccard, langid, mixing, packing, quality
from arbitra.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of no clear language."""
    train = docs.where(~langid.held_out(F.col("doc_id")))
    filters = langid.fit(train)
    return langid.clear(docs.select(*COLUMNS), filters, langid.norms(train, filters))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are outliers of their language and source."""
    bad = quality.judge(docs.select(*COLUMNS)).where("NOT kept").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked texts, that with the smallest id; rows are told apart by id and text."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources weigh as the square root of their size."""
    return mixing.mix(docs.select(*COLUMNS), alpha=0.5).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token sequences."""
    return packing.pack(packing.pieces(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

# Fitted filters, iterated covariances and token ids are not expressible in SQL: tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
