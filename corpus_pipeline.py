"""From raw documents to packed training sequences: each stage calls one operator of ``tracewell.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import jaccard, mixing, packing, pii, toxicity
from tracewell.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labelled ones of its input, scores 0.5 or more go.

    Null and empty texts score 0 and stay, as do all documents where no label tells both kinds apart. Repeated rows go
    or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels, held_out_fold=None))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays, once; rows without id stay.

    Null and empty texts, and texts without a word, have no duplicates. Of rows with one id and several texts the one
    stays that the operator compared, that with the smallest set digest, none first; of rows equal in both the first by
    their other columns.
    """
    named = docs.where("doc_id is not null")
    stays = jaccard.join(docs).where("doc_id = group_id").select("doc_id").distinct()
    kept = named.join(stays, "doc_id", "left_semi").select(*docs.columns).withColumn("__h", F.xxhash64("text"))
    several = named.groupBy("doc_id").agg((F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("__several")).where("__several").select("doc_id")
    mixed = named.join(several, "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("__h"))
    keys = jaccard.sets(mixed.select(F.col("__h").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("__h")).agg(F.min("key").alias("__key"))
    compared = mixed.join(keys, "__h").groupBy("doc_id").agg(F.min_by("__h", F.struct("__key", "__h")).alias("__chosen"))
    one = kept.join(compared, "doc_id", "left").where("__chosen is null or __chosen = __h")
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType, T.VariantType))]
    once = one.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(*plain)).alias("__row")).select("__row.*")
    return once.unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind in brackets; null and empty texts and repeated rows stay as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: rows follow it from file to file and within files.

    A null source is one of its own; null and empty texts and repeated rows are documents like others.
    """
    whole = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))
    return mixing.mix(whole).repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens, numbered along the order of the mix.

    A null or empty text is its end token alone; repeated rows are documents of their own.
    """
    return packing.pack_in_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
