"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import decontaminate, minhash, mixing, quality, sharding
from fleetpulse.llm.tables import stored, table
from fleetpulse.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 8
#: The mix and the robust estimates are not expressible in SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    configure(spark)
    return quality.keep_good(docs.select(*COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    configure(spark)
    return minhash.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    configure(spark)
    marked = decontaminate.find_passages(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.where("not contaminated").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each run of words taken in one pass over its source."""
    configure(spark)
    docs = docs.select(*COLUMNS)
    return mixing.mixed_texts(docs, *mixing.mix(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard and slot they were written to."""
    configure(spark)
    written, offsets = sharding.external_shuffle(docs.select(*COLUMNS), SHARDS)
    return sharding.slots(written, offsets).select(*COLUMNS, "shard", "slot")


STAGES = [("quality rules", quality_stage), ("near duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("sharding", sharding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
