"""The corpus pipeline: five stages over ``documents``, each one of the operators of graphloom.llm.

A stage takes (spark, docs, sf_dir) and gives what stays of ``docs``, with the columns of documents; the
last adds the shard and the place in it. ``run`` writes each stage's result as Parquet into the shared
folder, reads it again and removes the one before, so a lost executor never costs an earlier stage.

Defined cases, for every stage: extra columns pass through, whatever their names, but the last stage replaces those named
like the ones it adds; an empty table gives an empty result; null ids are ids like any other. Each stage's docstring says
what becomes of null and empty texts and of repeated rows; very long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, minhash, mixing, quality, sharding
from graphloom.llm.common import remove, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels of those at hand, gives the highest grade.

    Null texts and those without a token go; equal texts are judged alike, repeated rows each stay or go; without labels all with a token stay.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.select_quality(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every class of near-duplicates.

    A null text or one without a word is a class by itself and stays; of rows that are equal in id and text one stays.
    """
    return minhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null texts and those without a letter hold none and stay; repeated rows stay or go together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, repeated so that the languages' tokens meet their weights.

    Null and empty texts have no tokens and stay; rows that are equal in id and text come equally often. Without a language nothing is repeated.
    """
    return mixing.mix(docs, mixing.TARGETS, "lang")


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard and their place in it. The slot map is kept in the shared folder and edited by the next run on the table.

    A null text has the size 1; rows that are equal in id and text lie in one virtual slot, each in its own place.
    """
    return sharding.shard_by_slots(docs, sharding.N_SHARDS, store=sharding.map_folder(spark, f"pipeline {sf_dir}"))[0]


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_languages),
    ("sharding", put_into_shards),
]

#: Trained models and signatures are beyond SQL. The tests hold each stage's decisions against brute force: all pairs, substring
#: search, held-out labels, totals and loads.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
