"""From raw documents to packed training sequences: five stages, each an operator of ``plumbline.llm``.

Every stage takes all that its predecessor kept. Quality drops rejected documents; line dedup rewrites texts;
near duplicates leave the smallest doc_id of a group; decontamination drops documents that hold benchmark items;
packing returns one row for each piece of a document.

Defined cases, for every stage: a null text is kept and packed as the empty text; null doc_ids are kept (they can be
linked with nothing); rows that repeat a doc_id are judged each for itself by quality and line dedup, and go or stay
together in the two stages that drop by doc_id; null sources and languages are a site of their own; other columns, of any
name, pass through unchanged up to packing; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontam, linededup, ngram_join, packing, quality
from plumbline.llm.store import gone_at_exit, shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(docs).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
# Tokenising, tiling and the fitted classifier are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{name}")
        docs = spark.read.parquet(gone_at_exit(spark, f"{work}/{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
