"""From raw documents to packed training sequences: five stages, each over all that the last kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotflow.llm import language, lines, packing, simhash, toxicity
from slotflow.llm.common import fresh, quoted
from slotflow.session import shared_folder

SIZE = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier accepts."""
    return _passing(docs, language.identify(F.col("text"), language.fit(docs)), "accepted", True)


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _passing(docs, toxicity.score(F.col("text"), model), "predicted", 0)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of three-line windows that occurred before; n_chars follows the text."""
    cut = lines.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints."""
    return simhash.keep_first(docs, shingle=4, bits=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most ``SIZE`` tokens."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), size=SIZE, end=0)
    return packing.pack(cut, size=SIZE).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("toxicity", clean_speech),
    ("line_dedup", line_dedup),
    ("simhash_neardup", near_duplicates),
    ("packing", pack),
]

#: Compression, learned scores and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each kept is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _passing(docs: DataFrame, judged: Column, field: str, value: object) -> DataFrame:
    """Rows and columns of ``docs`` where a field of the judgement has the value."""
    name = fresh("judged", docs.columns)
    return docs.withColumn(name, judged).where(F.col(name)[field] == F.lit(value)).select(*(quoted(c) for c in docs.columns))
