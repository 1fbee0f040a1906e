"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Part of the training-data operators; nothing imports it but the driver's entry.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm._shared import staged
from quizloom.llm.line_dedup import dedup_lines
from quizloom.llm.mixing import mix_sources
from quizloom.llm.ngram_join import ngram_jaccard_join
from quizloom.llm.packing import pack_documents
from quizloom.llm.toxicity import toxicity_scores


#: Columns of documents that stages read or change.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def _any_columns(stage):
    """The stage on tables with columns of any further names: they go through it under names that no operator uses."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = {c: f"further{k}" for k, c in enumerate(docs.columns) if c not in KNOWN}
        out = stage(spark, docs.withColumnsRenamed(inner) if inner else docs, sf_dir)
        return out.withColumnsRenamed({v: k for k, v in inner.items() if v in out.columns}) if inner else out

    return run_stage


@_any_columns
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of toxicity, the last of the chain, reaches 0.5 go."""
    scored = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(scored.where(F.element_at("_p", -1) < 0.5), docs)


@_any_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, exactly or, from 8 words on, but for one word; a document of which nothing is left goes too; n_chars follows the text."""
    out = dedup_lines(docs).where((F.col("_gone") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _columns(out, docs)


@_any_columns
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows without an id stay."""
    found = ngram_jaccard_join(docs, count_links=False).where("component_id = doc_id").select(F.col("doc_id").alias("_keep"))
    kept = docs.join(found, docs["doc_id"] == F.col("_keep"), "left_semi")
    return kept.unionByName(docs.where("doc_id is null"))


@_any_columns
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once; small sources up to twice as often as the largest."""
    return _columns(mix_sources(docs, max_repetition=2.0, cover=True), docs)


@_any_columns
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("packing", packing)]

#: The classifier chain, the shingle join and the tokenizer can't be said in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
