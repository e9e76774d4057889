"""A corpus pipeline of the training-data operators: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontam, langid, minhash, mixing, sharding, simhash
from tideline.llm.common import ensure_checkpoint_dir, stored, table

#: Multiples of a domain's present expected tokens: clean text stays as it is, toxic text goes.
MIX = {"q0_t0": 1.0, "q1_t0": 1.0, "q0_t1": 0.0, "q1_t1": 0.0}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known with a posterior of one half or more; the others go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by SimHash, and of what that leaves by sketches of five-word shingles (0.8 or more)."""
    return minhash.keep_representatives(stored(simhash.keep_representatives(docs)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, in whole copies."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), MIX, relative=True, nearest=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard."""
    return sharding.place(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: Training and tree search are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again by the next stage."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint(eager=True)
    return STAGES[-1][1](spark, docs, sf_dir)
