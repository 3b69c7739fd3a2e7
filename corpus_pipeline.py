"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

1. language ID: documents without a language (no text, no letters) go.
2. near-dedup: of each group of near copies the smallest doc_id stays. Groups
   are joined over links, and copies need not resemble the one that stays.
3. decontamination: documents with a benchmark passage go.
4. secret scans: secrets in the texts are replaced by a mask; no document goes.
5. packing: the places of all pieces in sequences of 1024 tokens.

Rows with a null doc_id pass stage 3, which decides by doc_id; rows that repeat a
doc_id share its fate there. Columns beyond those of ``documents`` are kept
up to stage 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import decontam, language, packing, secrets, simhash
from boxloom.runtime import write_table


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone``."""
    name = _unused(docs, "gone_id")
    return docs.join(gone.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id") == F.col(name), "left_anti")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = language.predictor(language.sample(docs))(F.col("text"))
    name = _unused(docs, "told")
    return docs.withColumn(name, told).where(F.col(name)["lang"] != "und").drop(name)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("best-fit packing", pack),
]
#: Language models, SimHash and tokenizers are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
