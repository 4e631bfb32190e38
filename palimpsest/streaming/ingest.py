"""Continuous ingestion of growing logs: each run takes what is new, and known ids are ignored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.operators.facts import first_of
from palimpsest.sources import files

#: What a store holds at least; one that nothing has come to yet can be read by it.
STORED = "id string, session string, source_id string, role string, text string, created_at string, scope string, part int"
#: Folders that sessions are dealt to in a store, so that a batch reads the ids of its own alone.
PARTS = 64


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, schema: str, to_turns: Callable[[DataFrame], DataFrame], harness: str, scope: str, prefix: str = "memory") -> int:
    """Read the log files below ``source`` that are new since the last run and append their turns to the Parquet ``store``.

    to_turns makes turns (session, source_id, role, text, created_at, and ordinal if their order isn't the read
    rows') of the read rows. Ids are made of harness, session and source id, so replays and repeats add nothing,
    the first of equal ids counts, and a batch that is tried again after a failure finds what it has written.
    Returns the number of batches.
    """
    done: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        done.append(number)
        turns = to_turns(batch)
        order = F.col("ordinal") if "ordinal" in turns.columns else F.monotonically_increasing_id()
        turns = turns.withColumn("_at", order).withColumn("id", ids.turn_id(F.lit(harness), F.col("session"), F.col("source_id"), prefix))
        new = first_of(turns, "id", order=[F.col("_at")]).drop("_at", "ordinal")
        new = new.withColumn("scope", F.lit(scope)).withColumn("part", F.pmod(F.xxhash64("session"), F.lit(PARTS)).cast("int"))
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS numbers at most
        try:
            known = batch.sparkSession.read.parquet(store).where(F.col("part").isin(parts)).select("id")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            known = None  # the first batch finds no store
        (new if known is None else new.join(known, "id", "left_anti")).write.mode("append").partitionBy("part").parquet(store)

    q = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    files.make_folder(spark, store)
    return len(done)
