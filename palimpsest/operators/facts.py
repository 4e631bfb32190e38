"""Facts: short marked statements taken from memories, and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as tx
from palimpsest.operators import postings
from palimpsest.operators.postings import Index
from palimpsest.operators.search import CURRENT, Validity, by_score, scored, with_rank

#: How a fact begins, the bullets before it, its least length, and the most of one memory.
MARKERS = (
    "decided:", "decision:", "todo", "fixme", "note:", "rule:", "fix:", "fixed:", "chose:", "chosen:", "rejected:",
    "constraint:", "gotcha:", "warning:", "never ", "always ", "must ", "do not ", "don't ",
)
BULLETS = r"^(?:- |\* |• )"
LEAST_CHARS, MOST_FACTS = 12, 8


def facts_of(text: Column) -> Column:
    """A text's facts in order: marked lines and sentences, without repeats."""
    sentence = r"(?<=[.!?]) (?=\p{Lu})"
    units = F.flatten(F.transform(F.split(text, "\r?\n"), lambda line: F.when(F.size(F.split(line, sentence)) > 1, F.concat(F.array(line), F.split(line, sentence))).otherwise(F.array(line))))
    bare = F.transform(units, lambda u: F.regexp_replace(F.regexp_replace(tx.trimmed(u), BULLETS + r"\s*", ""), r"(?U)^\s+", ""))
    marked = F.filter(bare, lambda u: F.lower(u).rlike("^(?:" + "|".join(MARKERS) + ")") & (F.char_length(u) >= LEAST_CHARS))
    return F.slice(F.array_distinct(marked), 1, MOST_FACTS)


def extract(memories: DataFrame, prefix: str = "memory") -> DataFrame:
    """id, memory_id, scope, fact, created_at of the facts of current memories that aren't rules."""
    rows = memories.where("valid_to IS NULL AND rule_id IS NULL")
    each = rows.select(F.col("id").alias("memory_id"), "scope", "created_at", F.explode(facts_of(F.col("content"))).alias("fact"))
    return each.select(ids.keyed("fact", F.col("memory_id"), F.col("fact"), prefix=prefix).alias("id"), "memory_id", "scope", "fact", "created_at")


def report(memories: DataFrame) -> DataFrame:
    """scanned, facts, memories_with_facts in one row."""
    rows = memories.where("valid_to IS NULL AND rule_id IS NULL").select(F.size(facts_of(F.col("content"))).alias("n"))
    return rows.agg(F.count("*").alias("scanned"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.count_if(F.col("n") > 0).alias("memories_with_facts"))


def candidates(facts: DataFrame, memories: DataFrame, query: str, scope: str | None = None, validity: Validity = CURRENT, limit: int = 20, index: Index | None = None) -> DataFrame:
    """id, score, rank of memories by the best of their matching facts; the limit counts memories.

    With an index of the facts (id, fact) only its postings of the query's terms are read; a memory has MOST_FACTS
    facts at most, so the best memories are among the best MOST_FACTS times as many facts.
    """
    alive = memories.where(validity.holds() & F.col("rule_id").isNull())
    if scope is not None:
        alive = alive.where(F.col("scope") == scope)
    if index is None:
        hits = scored(facts.select("id", "memory_id", "fact"), query, text="fact").select(F.col("memory_id").alias("id"), "score").join(alive.select("id"), "id")
    else:
        known = facts.select("id", "memory_id").join(alive.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        hits = postings.best(index, query, MOST_FACTS * limit, known).join(known, "id").select(F.col("memory_id").alias("id"), "score")
    best = hits.groupBy("id").agg(F.max(F.round("score", 10)).alias("score"))
    return with_rank(best, *by_score(), limit=limit)


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the greatest ``order``."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def first_of(rows: DataFrame, *key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
