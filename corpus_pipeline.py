"""Corpus cleaning in five stages, each over all that the one before kept.

quality rules -> quality classifier -> near duplicates -> repeated passages ->
packing. Every stage but the last returns the columns of documents; the last
returns the packing plan (doc_id, n_tokens, bucket, batch, place, padding).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.op2_quality_rules import quality_rules
from tallybook.llm.op3_suffix_dedup import PASSAGE, suffix_dedup
from tallybook.llm.op5_length_buckets import length_buckets
from tallybook.llm.op6_site_quality import site_quality
from tallybook.llm.op8_ngram_jaccard import NearDuplicates
from tallybook.llm.runtime import shared_dir


def passing_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's fences let pass."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def good_sites(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is high enough, given their text and site."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality(docs, labels).filter("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group of near duplicates."""
    return NearDuplicates(docs).keepers()


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less what strings of PASSAGE bytes (about 50 words) repeat; n_chars follows the text."""
    cut = suffix_dedup(docs, length=PASSAGE).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and batches within a token budget."""
    return length_buckets(docs)


STAGES = [
    ("quality_rules", passing_rules),
    ("quality_classifier", good_sites),
    ("near_duplicates", one_of_each),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: Sketches, components and the bucket search are beyond one SQL statement; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's rows are written to the shared folder and read again by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
