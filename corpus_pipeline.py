"""Five stages from raw documents to training shards; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontaminate, language, mixing, sharding, simhash
from shelfmark.plans.lineage import shared_dir
from shelfmark.sources.manifest import remove

#: A text goes if less than half of its bytes occurred in the training texts, as its script is unknown then; texts without a letter go
#: in any case. A low probability alone is no reason: clean texts of mixed words have one.
LEAST_KNOWN_BYTES = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. Null and letterless texts go; repeated rows share a fate; no rows give none."""
    return language.keep_known(docs, language.learn(docs), LEAST_KNOWN_BYTES)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near duplicates. Null texts are empty, and all alike; ids that are
    null come last, ids that repeat stand for each of their texts."""
    return simhash.drop_similar(docs)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates, whatever their ids. Null and empty texts stay; very long texts are looked at whole."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all or up to three times. A null source is a source; a null text has no words."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; each copy that the mix made is a row of its own."""
    return sharding.shard_ring(docs).drop("size", "text_crc32")


STAGES = [("language_id", keep_identified), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark_texts), ("mixing", mix), ("sharding", shard)]

#: Training a network and linking fingerprints can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps goes through a table in the shared folder, which goes once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
