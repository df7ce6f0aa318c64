"""The corpus pipeline: stages over documents, each written as Parquet and read again.

quality_rules keeps the documents that pass and takes lines above the limits out of them; near_dedup keeps the document
of least id of each group (similarity of 0.8 on five-word shingles); mask_personal_data masks spans; mix_to_weights
repeats documents to the sources' targets; pack_sequences returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm import mixing, packing, pii, quality, simhash
from itemloom.llm.common import written
from itemloom.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, without the lines above the limits; those of null text go.

    Here a line counts once for each text of a host: copies are the next stage's work, which must find one to keep. Extra
    columns are dropped; repeated rows are all judged alike; an empty table gives an empty one.
    """
    kept = quality.quality(docs.select(*COLUMNS), document=F.xxhash64("text")).filter("kept")
    return _documents(kept.withColumn("text", F.col("clean_text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, see simhash.near_dedup: rows of null key stay, rows with one key and
    different texts are different documents, equal rows are one."""
    return simhash.near_dedup(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data masked; null text stays null, repeated rows repeat."""
    return _documents(pii.redact(pii.find_spans(docs.select(*COLUMNS))))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says, see mixing.mix; a null source is a source of its own."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, see packing.pack_documents: null text is empty, repeated rows are packed each."""
    return packing.pack_documents(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mask_personal_data", mask_personal_data), ("mix_to_weights", mix_to_weights), ("pack_sequences", pack_sequences)]

#: SQL cannot tokenise or fingerprint; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
