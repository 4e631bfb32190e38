"""Memories, vectors and access logs as projections of general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import times

MEMORY = ("id", "agent", "scope", "role", "content", "created_at", "rule_id", "status", "valid_from", "valid_to", "superseded_by")
START = "2024-01-01 00:00:00"
NOW = "2024-02-01T00:00:00.000Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(minutes: F.Column):
    return times.as_text(F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + minutes * 60))


def mem_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as memories: system turns are rules, and some user turns are superseded by the next."""
    t = table(spark, sf_dir, "conversations").withColumn("body", F.coalesce("text", F.lit("")))
    n = (F.col("conv_id") + F.col("turn")) % 5
    rule = F.col("role") == "system"
    content = F.when(rule, F.col("body")).when(n == 0, F.concat(F.lit("Decided: "), "body")).when(n == 1, F.concat("body", F.lit("\n- TODO "), F.substring("body", 1, 40))).otherwise(F.col("body"))
    t = t.withColumn("id", F.format_string("c%06d-%03d", "conv_id", "turn")).withColumn("created_at", _at(F.col("conv_id") * 60 + F.col("turn")))
    order = W.partitionBy("conv_id", "role").orderBy("turn")
    old = (F.col("conv_id") % 3 == 0) & (F.col("role") == "user")
    return t.select(
        "id",
        F.concat(F.lit("agent"), (F.col("conv_id") % 4).cast("string")).alias("agent"),
        F.concat(F.lit("s"), (F.col("conv_id") % 7).cast("string")).alias("scope"),
        F.when(rule, "rule").otherwise(F.col("role")).alias("role"),
        content.alias("content"),
        "created_at",
        F.when(rule, F.format_string("r%06d", "conv_id")).alias("rule_id"),
        F.when(rule, F.when(F.col("conv_id") % 2 == 1, "retired").otherwise("active")).alias("status"),
        F.lit(None).cast("string").alias("valid_from"),
        F.when(old, F.lead("created_at").over(order)).alias("valid_to"),
        F.when(old, F.lead("id").over(order)).alias("superseded_by"),
    )


def mem_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as current notes, scoped by language."""
    t = table(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    return t.select(
        F.format_string("d%06d", "doc_id").alias("id"), F.lit("importer").alias("agent"), F.col("lang").alias("scope"), F.lit("note").alias("role"), F.coalesce("text", F.lit("")).alias("content"),
        _at(F.col("doc_id")).alias("created_at"), *[null.alias(c) for c in MEMORY[6:]],
    )


def _doc_number():
    return F.substring("id", 2, 18).cast("long")


def mem_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mem_docs with credentials, terminal codes and reminders added to some."""
    n = _doc_number() % 17
    text = F.col("content")
    new = (
        F.when(n == 0, F.concat(text, F.lit(" ghp_" + "A" * 30)))
        .when(n == 1, F.concat(text, F.lit(" Bearer " + "b" * 20)))
        .when(n == 2, F.concat(F.lit("\x1b[31m<system-reminder>hidden</system-reminder>"), text))
        .otherwise(text)
    )
    return mem_docs(spark, sf_dir).withColumn("content", new)


def mem_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mem_docs, every odd one negated."""
    return mem_docs(spark, sf_dir).withColumn("content", F.when(_doc_number() % 2 == 1, F.concat(F.lit("it is not "), "content")).otherwise(F.col("content")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id, model, embedding; every tenth vector and the next are twins."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    twin = t.where("vec_id % 10 = 0").select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("twin"))
    return t.join(twin, "vec_id", "left").select(F.format_string("d%06d", "vec_id").alias("memory_id"), F.lit("m").alias("model"), F.coalesce("twin", "embedding").cast("array<double>").alias("embedding"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts: views of memories."""
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.crossJoin(F.broadcast(docs)).select(F.format_string("d%06d", F.col("event_id") % F.col("n")).alias("id"), times.as_text(F.col("ts").cast("timestamp")).alias("ts"))
