"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's result to the
shared folder and reads it as the next stage's docs. All stages but the last give the columns of documents, whatever
further columns there are. Null texts count as empty in every stage; ties, repeated rows and null ids are rows like
others; very long texts are read whole; of an empty table each stage makes an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.near_dups import drop_near_duplicates
from tessera.llm.packing import pack
from tessera.llm.pii import with_surrogates
from tessera.llm.quality import keep_documents
from tessera.llm.queries import BYTES, PASSAGE, PII_KEY
from tessera.llm.repeats import without_repeats

#: Chunks of text that a worker remembers: other stages run beside workers that wait with what they remember.
CHUNKS = 300_000


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where a stage changes it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go; so do null and empty texts, which have no words."""
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the least id, null ids last. Null and empty texts are one class."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of over 50 words and bytes of 400-byte strings that occur more than once are cut, the first occurrence too; null texts stay null."""
    return _counted(without_repeats(docs, words=PASSAGE))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; null texts stay null."""
    return _counted(with_surrogates(docs, PII_KEY).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens, a row for each piece; null and empty texts are their end id alone."""
    return pack(docs, public_tokenizers.path(BYTES), chunks=CHUNKS)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("repeated passages", repeated_passages), ("personal data", personal_data), ("packing", packing)]

#: SQL can express neither the signatures nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
