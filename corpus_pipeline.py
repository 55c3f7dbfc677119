"""The corpus pipeline: score, deduplicate, decontaminate, mix and shard documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and reread as the next stage's docs. All but the last keep the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphtide.llm import decontaminate, minhash, mixing, sharding, toxicity
from glyphtide.llm.common import release, settle, settled_tables, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.distinct_documents(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs, mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, n_shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: No stage but the benchmark's exact part has a SQL form: the classifier is fitted,
#: and sampling, mixing and propagation depend on hash functions DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = table(spark, sf_dir, "documents"), len(settled_tables(spark))
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # The stage is written, so its own tables, and what it was made from, can go.
        release(spark, began)
    return STAGES[-1][1](spark, docs, sf_dir)
