"""Writes as folds of append-only logs: ingestion, supersession, rules, moves between scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as tx
from palimpsest.operators import grid as gx
from palimpsest.operators.facts import first_of


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows that a join meets by a shuffle, however few they are: a broadcast goes through the driver, and writes make many joins."""
    return rows.hint("merge")


def first_turns(turns: DataFrame) -> DataFrame:
    """One row for each id: that of least ``ordinal``."""
    return first_of(turns, "id", order=[F.col("ordinal")])


def insert_or_ignore(memories: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns that a store lacks, first of each id."""
    return first_turns(turns).join(memories.select("id"), "id", "left_anti")


def ingest_report(memories: DataFrame, turns: DataFrame, scope: str) -> DataFrame:
    """inserted, skipped_existing, in_other_scopes in one row."""
    once = turns.groupBy("id").agg(F.count("*").alias("n"))
    met = once.join(memories.select("id", F.col("scope").alias("found")), "id", "left")
    new = F.col("found").isNull()
    return met.agg(F.count_if(new).alias("inserted"), F.coalesce(F.sum(F.when(new, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("skipped_existing"), F.coalesce(F.sum(F.when(F.col("found") != scope, F.col("n"))), F.lit(0)).alias("in_other_scopes"))


def other_scopes(memories: DataFrame, turns: DataFrame, scope: str) -> DataFrame:
    """scope, n: turns that exist already, by the scope they were found in, if another."""
    met = turns.select("id").join(memories.select("id", "scope"), "id")
    return met.where(F.col("scope") != scope).groupBy("scope").agg(F.count("*").alias("n"))


def superseded(base: DataFrame, log: DataFrame) -> DataFrame:
    """base with the first entry (id, valid_to, superseded_by, seq) of the log for each id applied."""
    first = log.groupBy("id").agg(F.min_by(F.struct("valid_to", "superseded_by"), "seq").alias("s"))
    rows = base.drop("valid_to", "superseded_by").join(first, "id", "left")
    return rows.withColumn("valid_to", F.col("s.valid_to")).withColumn("superseded_by", F.col("s.superseded_by")).drop("s")


def supersede_outcome(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """target, scope, outcome of requests (target, scope) to supersede a memory."""
    m = memories.select(F.col("id").alias("target"), F.col("scope").alias("own"), "rule_id", "valid_to")
    found = requests.join(shuffled(m), "target", "left")
    outcome = F.when(F.col("own").isNull() | (F.col("own") != F.col("scope")), "not-found").when(F.col("rule_id").isNotNull(), "target-is-rule").when(F.col("valid_to").isNotNull(), "already-superseded").otherwise("superseded")
    return found.select("target", "scope", outcome.alias("outcome"))


def chain(memories: DataFrame) -> DataFrame:
    """id, head, depth of superseded memories: the version that is current at the end of each chain.

    Links are followed by doubling: after k rounds each has taken 2^k steps, and rounds end when all have arrived.
    """
    links = memories.where("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("head"), F.lit(1).alias("depth")).checkpoint()
    while True:
        far = links.select(F.col("id").alias("k"), F.col("head").alias("h"), F.col("depth").alias("d"))
        new = links.join(far, F.col("head") == F.col("k"), "left").select("id", F.coalesce("h", "head").alias("head"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("k").isNotNull().alias("moved")).checkpoint()
        if new.where("moved").isEmpty():
            return new.select("id", "head", "depth")
        links = new.select("id", "head", "depth")


def rules(events: DataFrame) -> DataFrame:
    """scope, rule_id, text, agent, created_at, updated_at, status from rule events (op add, retire or purge; seq).

    Adding keeps the first time and revives a retired rule. Purging drops a rule that is retired, and only
    events after the last purge that took effect count. Events follow each other by seq; their ts may run back.
    """
    key = ["scope", "rule_id"]
    before = W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op") != "purge", F.col("op")), ignorenulls=True).over(before)
    took = (F.col("op") == "purge") & (state == "retire")
    rows = events.withColumn("took", F.when(took, F.col("seq")))
    rows = rows.withColumn("purged", F.coalesce(F.max("took").over(W.partitionBy(*key)), F.lit(-1)))
    live = rows.where((F.col("seq") > F.col("purged")) & (F.col("op") != "purge"))
    adds = F.col("op") == "add"
    out = live.groupBy(*key).agg(
        F.max_by(F.when(adds, F.col("text")), F.when(adds, F.col("seq"))).alias("text"), F.max_by(F.when(adds, F.col("agent")), F.when(adds, F.col("seq"))).alias("agent"),
        F.min_by("ts", F.when(adds, F.col("seq"))).alias("created_at"), F.max_by("ts", "seq").alias("updated_at"), F.max_by("op", "seq").alias("op"),
    )
    return out.select(*key, "text", "agent", "created_at", "updated_at", F.when(F.col("op") == "add", "active").otherwise("retired").alias("status"))


def retire_outcome(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """scope, rule_id, outcome of requests to retire a rule."""
    known = memories.where("rule_id IS NOT NULL").select("scope", "rule_id", "id", "status")
    outcome = F.when(F.col("id").isNull(), "not-found").when(F.col("status") == "retired", "already-retired").otherwise("retired")
    return requests.join(known, ["scope", "rule_id"], "left").select("scope", "rule_id", outcome.alias("outcome"))


def purge_outcome(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """scope, rule_id, outcome of requests to purge a rule; only retired ones go."""
    known = memories.where("rule_id IS NOT NULL").select("scope", "rule_id", "id", "status")
    outcome = F.when(F.col("id").isNull(), "not-found").when(F.col("status") == "retired", "purged").otherwise("not-retired")
    return requests.join(known, ["scope", "rule_id"], "left").select("scope", "rule_id", outcome.alias("outcome"))


def _chosen(memories: DataFrame, source: str, selection: DataFrame | None) -> DataFrame:
    """The source scope's memories, or those of the selected ids among them that aren't rules."""
    rows = memories.where(F.col("scope") == source)
    if selection is None:
        return rows
    return rows.where("rule_id IS NULL").join(shuffled(selection.select("id").distinct()), "id", "left_semi")


def rescope_counts(memories: DataFrame, facts: DataFrame, source: str, selection: DataFrame | None = None) -> DataFrame:
    """memories, rules, facts that moving a scope, or the selected ids of it, would move, in one row."""
    moved = _chosen(memories, source, selection)
    rows = moved.agg(F.count_if(F.col("rule_id").isNull()).alias("memories"), F.count_if(F.col("rule_id").isNotNull()).alias("rules"))
    mine = facts.join(moved.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return rows.crossJoin(F.broadcast(mine.agg(F.count("*").alias("facts"))))


def rescope_conflicts(memories: DataFrame, target: str, source: str, selection: DataFrame | None = None) -> DataFrame:
    """rule_id of rules that would move into a scope which holds one of that id."""
    moved = _chosen(memories, source, selection).where("rule_id IS NOT NULL").select("rule_id").distinct()
    held = memories.where((F.col("scope") == target) & F.col("rule_id").isNotNull()).select("rule_id").distinct()
    return moved.join(shuffled(held), "rule_id")


def rescoped(memories: DataFrame, source: str, target: str, selection: DataFrame | None = None) -> DataFrame:
    """Memories with those of the source (or of the selected ids among them) in the target scope.

    A single conflict refuses the whole move: then all stay where they are.
    """
    conflicts = rescope_conflicts(memories, target, source, selection).agg(F.count("*").alias("_conflicts"))
    moved = _chosen(memories, source, selection).select("id", F.lit(True).alias("_moves")).distinct()
    rows = memories.join(moved, "id", "left").crossJoin(F.broadcast(conflicts))
    go = F.coalesce("_moves", F.lit(False)) & (F.col("_conflicts") == 0)
    return rows.withColumn("scope", F.when(go, target).otherwise(F.col("scope"))).select(*memories.columns)


def facts_rescoped(facts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts in the scopes to which their memories have moved (before, after: id, scope)."""
    was = before.select("id", F.col("scope").alias("_was"))
    moved = after.join(was, "id").where(F.col("scope") != F.col("_was")).select(F.col("id").alias("memory_id"), F.col("scope").alias("_to"))
    return facts.join(moved, "memory_id", "left").withColumn("scope", F.coalesce("_to", "scope")).select(*facts.columns)


def session_selection(turns: DataFrame, harness: str, session: str, prefix: str = "memory") -> DataFrame:
    """id of the memories that ingesting a session's turns (session, source_id) gave."""
    mine = turns.where(F.col("session") == session)
    return mine.select(ids.turn_id(F.lit(harness), F.col("session"), F.col("source_id"), prefix).alias("id")).distinct()


#: The columns of a memory and their types, in the order in which versions of the store have added them.
MEMORY_SCHEMA = (
    ("id", "string"), ("agent", "string"), ("scope", "string"), ("role", "string"), ("content", "string"), ("created_at", "string"), ("rule_id", "string"), ("updated_at", "string"), ("status", "string"),
    ("valid_from", "string"), ("valid_to", "string"), ("superseded_by", "string"), ("last_accessed_at", "string"), ("access_count", "int"),
)


def migrated(memories: DataFrame) -> DataFrame:
    """Memories of any older store with all columns of today: those that it lacks are null. One that lacks the first six is refused."""
    lacking = [c for c, _ in MEMORY_SCHEMA[:6] if c not in memories.columns]
    if lacking:
        raise ValueError(f"not a store of memories: no {', '.join(lacking)}")
    have = set(memories.columns)
    return memories.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in MEMORY_SCHEMA], *[c for c in memories.columns if c not in dict(MEMORY_SCHEMA)])


def remembered(entries: DataFrame, now: str) -> DataFrame:
    """New memories of entries (agent, scope, role, content), each with a random id and the instant ``now``."""
    return migrated(entries.select(ids.random_id().alias("id"), "agent", "scope", "role", "content", F.lit(now).alias("created_at")))


def remember(store: str, entries: DataFrame, now: str) -> None:
    """Append new memories to a Parquet store."""
    remembered(entries, now).write.mode("append").parquet(store)


def rules_block(rules_of_scopes: DataFrame) -> DataFrame:
    """scope, block: each scope's active rules as Markdown, by rule id."""
    entry = F.concat(F.lit("### `"), "rule_id", F.lit("`\n\n"), tx.trimmed(F.col("content")), F.lit("\n\n*Added "), "created_at", F.lit(" by "), "agent", F.lit(".*\n\n"))
    lines = rules_of_scopes.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("rule_id", entry.alias("entry")))).alias("e"))
    return lines.select("scope", F.concat(F.lit("## Rules of "), "scope", F.lit(" ("), F.size("e").cast("string"), F.lit(")\n\n"), F.array_join(F.transform("e", lambda x: x["entry"]), "")).alias("block"))


def _chapter() -> Column:
    esc = tx.texinfo_escaped
    return F.concat(F.lit("@chapter Message by "), esc(F.col("agent")), F.lit(" ("), esc(F.col("role")), F.lit(") at "), "created_at", F.lit("\n"), esc(F.col("content")), F.lit("\n\n"))


def chapters(history: DataFrame) -> DataFrame:
    """scope, place, text: the chapters of each scope's archive, a row each, with place from 0.

    Messages are ranked by ranges over all scopes, so no scope meets in one task.
    """
    rows = history.where("role <> 'rule'").select("scope", "created_at", "id", _chapter().alias("text"))
    rows = gx.ranked(rows, "scope", "created_at", "id").select("scope", "rank", "text")
    first = rows.groupBy("scope").agg(F.min("rank").alias("first"))
    return rows.join(first, "scope").select("scope", (F.col("rank") - F.col("first")).alias("place"), "text")


#: Chapters of one part of an archive.
PART_CHAPTERS = 10_000


def _head(n: Column, through: Column) -> Column:
    title = tx.texinfo_escaped(F.col("scope"))
    return F.concat(F.lit("\\input texinfo\n@documentencoding UTF-8\n@settitle Chat history for scope: "), title, F.lit("\n@c Messages: "), n.cast("string"), F.lit("\n@c Through: "), through, F.lit("\n\n@node Top\n@top Chat history for scope: "), title, F.lit("\n\n"))


def archive_parts(history: DataFrame, size: int = PART_CHAPTERS) -> DataFrame:
    """scope, part, document: each scope's archive in parts of ``size`` chapters from 0; end to end they are what ``archive`` gives.

    The first part has the header, the last the trailer. A row holds one part, so a scope may be of any size.
    """
    rows = chapters(history).withColumn("part", F.floor(F.col("place") / size))
    ends = history.where("role <> 'rule'").groupBy("scope").agg(F.count("*").alias("n"), F.max("created_at").alias("through"))
    parts = rows.groupBy("scope", "part").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("c")).join(ends, "scope")
    body = F.array_join(F.transform("c", lambda x: x["text"]), "")
    head = F.when(F.col("part") == 0, _head(F.col("n"), F.col("through"))).otherwise("")
    tail = F.when(F.col("part") == F.floor((F.col("n") - 1) / size), "@bye\n").otherwise("")
    return parts.select("scope", "part", F.concat(head, body, tail).alias("document"))


def write_archives(history: DataFrame, path: str, size: int = PART_CHAPTERS) -> None:
    """Write the parts as text files ``scope=.../part=.../``; in order of part a scope's files are its archive."""
    parts = archive_parts(history, size).withColumn("part", F.format_string("%08d", F.col("part").cast("long")))
    parts.repartition("scope", "part").write.partitionBy("scope", "part").option("lineSep", "").text(path)


def archive(history: DataFrame) -> DataFrame:
    """scope, document: a scope's history as Texinfo, one chapter for each message.

    One document holds one scope, so its messages meet in one row, as in the file it is written to. That
    row bounds a scope by what an array and a string can hold (2 GB); ``archive_parts`` has no such bound.
    """
    rows = history.where("role <> 'rule'").groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", _chapter().alias("c")))).alias("m"))
    head = _head(F.size("m"), F.element_at("m", -1)["created_at"])
    return rows.select("scope", F.concat(head, F.array_join(F.transform("m", lambda x: x["c"]), ""), F.lit("@bye\n")).alias("document"))
