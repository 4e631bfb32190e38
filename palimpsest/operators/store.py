"""A store of memories with commits: versions, optimistic writers, and an index that each commit keeps in step.

A version is a small manifest that names change sets, each a Parquet folder of whole rows (new ones, or old ones as they
are from now on, or marks of those that go), and the segments of the full-text index. A commit computes its rows
from the version that it read, writes them, and creates the next manifest, which only one writer can do; another
starts over from what is there then. So readers see whole versions, and each version can be read again. Reading
merges: of each id the latest row counts. ``compact`` writes one change set for all, dealt by validity: current
memories lie in files of their own, old ones in those of the month that closed them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import lifecycle as lx
from palimpsest.operators.postings import Index, Segment
from palimpsest.operators.search import Validity
from palimpsest.sources import files

COLUMNS = tuple(c for c, _ in lx.MEMORY_SCHEMA)
ROWS = ", ".join(f"{c} {kind}" for c, kind in lx.MEMORY_SCHEMA)
#: Folders tell current memories (OPEN) from old ones, and those by the month in which they were superseded.
STORED = f"{ROWS}, gone boolean, closed string"
OPEN = "open"
ALL = Validity(all=True)


class Conflict(RuntimeError):
    """Other writers came first as often as a commit may be tried."""


@dataclass(frozen=True)
class Version:
    """number; changes (path, number) oldest first; segments of the index; txns: the last number that each named writer has committed."""

    number: int = 0
    changes: tuple[tuple[str, int], ...] = ()
    segments: tuple[Segment, ...] = ()
    txns: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Version:
        d = json.loads(text)
        return cls(d["number"], tuple((p, n) for p, n in d["changes"]), tuple(Segment(**s) for s in d["segments"]), d["txns"])


@dataclass(frozen=True)
class Store:
    """The store below a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:010d}.json"

    def version(self, number: int | None = None) -> Version:
        """The latest version, or one of that number; version 0 is empty."""
        if number is None:
            found = [n for n in files.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
            number = int(found[-1].removesuffix(".json")) if found else 0
        return Version.from_json(files.read_text(self.spark, self._manifest(number))) if number else Version()

    def _rows(self, changes: tuple[tuple[str, int], ...]) -> DataFrame:
        each = [self.spark.read.schema(STORED).parquet(p).withColumn("number", F.lit(n)) for p, n in changes]
        return reduce(DataFrame.unionAll, each) if each else self.spark.createDataFrame([], f"{STORED}, number int")

    def memories(self, version: Version | int | None = None, validity: Validity = ALL) -> DataFrame:
        """The memories of a version (the latest) as they are in it: all of them, the current ones, or those valid at an instant.

        The first change set is read as it is but for the ids that later ones hold, so only those are grouped. Of it,
        current reads skip the folders of old memories, and those of an instant the months before it.
        """
        v = version if isinstance(version, Version) else self.version(version)
        base, later = v.changes[:1], v.changes[1:]
        rows = self._rows(base).where("NOT gone")
        if not validity.all:
            kept = F.col("closed") == OPEN
            rows = rows.where(kept if validity.as_of is None else kept | (F.col("closed") >= validity.as_of[:7]))
        rows = rows.where(validity.holds())
        if later:
            new = self._rows(later)
            last = new.groupBy("id").agg(F.max_by(F.struct(*COLUMNS[1:], "gone"), "number").alias("r")).select("id", "r.*")
            last = last.where("NOT gone").where(validity.holds())
            rows = rows.join(lx.shuffled(new.select("id")), "id", "left_anti").select(*COLUMNS).unionByName(last.select(*COLUMNS))
        return rows.select(*COLUMNS)

    def index(self, version: Version | int | None = None) -> Index:
        """The full-text index of a version's memories (id, content)."""
        v = version if isinstance(version, Version) else self.version(version)
        return Index(self.spark, f"{self.path}/index", v.segments)

    def commit(self, change: Callable[[DataFrame], DataFrame], txn: tuple[str, int] | None = None, tries: int = 10) -> Version:
        """Apply a change to the latest version and return the version that holds it.

        change: from the memories as they are to whole rows of those that are new or different, with a column
        ``gone`` for those that go. It is computed anew when another writer comes first. A change without rows
        makes no version. txn: a writer's name and its number of this change, which is applied once, whatever fails and
        is tried again.
        """
        for _ in range(tries):
            v = self.version()
            if txn and v.txns.get(txn[0], -1) >= txn[1]:
                return v
            number, path = v.number + 1, f"{self.path}/changes/{uuid.uuid4().hex}"
            before = self.memories(v)
            rows = change(before)
            rows = lx.migrated(rows).select(*COLUMNS, F.coalesce("gone", F.lit(False)).alias("gone") if "gone" in rows.columns else F.lit(False).alias("gone"))
            write_changes(rows, path)
            written = self.spark.read.schema(STORED).parquet(path)
            if written.isEmpty():
                files.delete(self.spark, path)
                if not txn:
                    return v
                new = replace(v, number=number)
            else:
                index = self._indexed(v, before, written)
                new = replace(v, number=number, changes=(*v.changes, (path, number)), segments=index.segments)
            if txn:
                new = replace(new, txns=v.txns | {txn[0]: txn[1]})
            if files.create(self.spark, self._manifest(number), new.to_json()):
                return new
            for left in (path, *[s.path for s in new.segments if s not in v.segments]):  # nobody has read them
                files.delete(self.spark, left)
        raise Conflict(f"{tries} commits to {self.path} came second")

    def _indexed(self, v: Version, before: DataFrame, rows: DataFrame) -> Index:
        """The index after a change: texts that it leaves as they are cost nothing."""
        old = before.select("id", F.col("content").alias("old"), F.lit(True).alias("was"))
        met = rows.select("id", "content", "gone").join(lx.shuffled(old), "id", "left").where("was IS NULL OR gone OR content IS DISTINCT FROM old")
        met = met.select("id", F.coalesce("content", F.lit("")).alias("text"), F.coalesce("old", F.lit("")).alias("old"), "gone", F.coalesce("was", F.lit(False)).alias("was"))
        if met.isEmpty():
            return self.index(v)
        return self.index(v).changed(met.where("NOT gone").select("id", "text"), met.where("was").select("id", F.col("old").alias("text"))).merged()

    def compact(self, tries: int = 10) -> Version:
        """A version with the same memories and index in one change set, dealt by validity and sorted by scope and time.

        Older versions stay readable; what only they name isn't deleted.
        """
        for _ in range(tries):
            v = self.version()
            path = f"{self.path}/changes/{uuid.uuid4().hex}"
            write_changes(self.memories(v).withColumn("gone", F.lit(False)), path, sort=True)
            new = replace(v, number=v.number + 1, changes=((path, v.number + 1),))
            if files.create(self.spark, self._manifest(new.number), new.to_json()):
                return new
            files.delete(self.spark, path)
        raise Conflict(f"{tries} compactions of {self.path} came second")

    # What users do, each as one commit.

    def remember(self, entries: DataFrame, now: str, ident: str | None = None) -> Version:
        """Add entries (agent, scope, role, content) under random ids, or under those of their column ``ident``."""
        rows = lx.remembered(entries, now) if ident is None else lx.migrated(entries.withColumns({"id": F.col(ident), "created_at": F.lit(now)}))
        return self.commit(lambda _: rows)

    def ingest(self, turns: DataFrame, txn: tuple[str, int] | None = None) -> Version:
        """Add memories whose ids the store lacks; of those that repeat an id the first (least ``ordinal``) counts."""
        first = lx.first_turns(turns) if "ordinal" in turns.columns else turns.dropDuplicates(["id"])
        return self.commit(lambda old: first.join(lx.shuffled(old.select("id")), "id", "left_anti"), txn)

    def supersede(self, requests: DataFrame, now: str) -> Version:
        """Close the memories that requests (target, scope, superseded_by) may close, at ``now``; others stay (see ``supersede_outcome``)."""

        def change(old: DataFrame) -> DataFrame:
            fit = lx.supersede_outcome(old, requests.select("target", "scope")).where("outcome = 'superseded'").select(F.col("target").alias("id"))
            by = requests.groupBy(F.col("target").alias("id")).agg(F.min("superseded_by").alias("by"))
            return old.join(lx.shuffled(fit.distinct()), "id", "left_semi").join(lx.shuffled(by), "id").withColumns({"valid_to": F.lit(now), "superseded_by": F.col("by")}).drop("by")

        return self.commit(change)

    def set_rules(self, events: DataFrame) -> Version:
        """Apply rule events (scope, rule_id, agent, op, text, ts, seq from 0): each rule is folded from what the store holds and the events after it."""

        def change(old: DataFrame) -> DataFrame:
            asked = events.select("scope", "rule_id").distinct()
            known = old.where("rule_id IS NOT NULL").join(lx.shuffled(asked), ["scope", "rule_id"], "left_semi")
            added = known.select("scope", "rule_id", "agent", F.lit("add").alias("op"), F.col("content").alias("text"), F.col("created_at").alias("ts"), F.lit(0).alias("seq"))
            touched = F.coalesce("updated_at", "created_at")
            retired = known.where("status = 'retired'").select("scope", "rule_id", "agent", F.lit("retire"), F.lit(None).cast("string"), touched, F.lit(1))
            later = events.select(added.columns).withColumn("seq", F.col("seq") + 2)
            now = lx.rules(added.unionAll(retired).unionByName(later))
            ident = F.coalesce("id", F.concat_ws(":", F.lit("rule"), "scope", "rule_id"))
            rows = asked.join(lx.shuffled(known.select("scope", "rule_id", "id", "last_accessed_at", "access_count")), ["scope", "rule_id"], "left").withColumn("id", ident)
            rows = rows.join(lx.shuffled(now.withColumn("there", F.lit(True))), ["scope", "rule_id"], "left").withColumn("gone", F.col("there").isNull())
            return rows.select("id", "agent", "scope", F.lit("rule").alias("role"), F.coalesce("text", F.lit("")).alias("content"), "created_at", "rule_id", "updated_at", "status", "last_accessed_at", "access_count", "gone")

        return self.commit(change)

    def touch(self, log: DataFrame) -> Version:
        """Count accesses (id, ts) on the memories that they name."""
        seen = log.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("at"))

        def change(old: DataFrame) -> DataFrame:
            rows = old.join(lx.shuffled(seen), "id")
            count = (F.coalesce("access_count", F.lit(0)) + F.col("n")).cast("int")
            return rows.withColumns({"access_count": count, "last_accessed_at": F.greatest("last_accessed_at", "at")}).drop("n", "at")

        return self.commit(change)

    def rescope(self, source: str, target: str, selection: DataFrame | None = None) -> Version:
        """Move a scope, or selected ids of it; a rule that the target has too refuses the whole move."""

        def change(old: DataFrame) -> DataFrame:
            mine = lx._chosen(old, source, selection)
            conflicts = lx.rescope_conflicts(old, target, source, selection).agg(F.count("*").alias("conflicts"))
            return mine.crossJoin(F.broadcast(conflicts)).where("conflicts = 0").drop("conflicts").withColumn("scope", F.lit(target))

        return self.commit(change)

    def forget(self, idents: DataFrame) -> Version:
        """Take memories (id) away."""
        return self.commit(lambda old: old.join(lx.shuffled(idents.select("id").distinct()), "id", "left_semi").withColumn("gone", F.lit(True)))


def write_changes(rows: DataFrame, path: str, sort: bool = False) -> None:
    """Write rows as a change set, in folders by ``closed``: OPEN, or the month of valid_to."""
    rows = rows.select(*COLUMNS, "gone", F.coalesce(F.substring("valid_to", 1, 7), F.lit(OPEN)).alias("closed"))
    if sort:
        rows = rows.repartitionByRange("closed", "scope", "created_at", "id").sortWithinPartitions("closed", "scope", "created_at", "id")
    rows.write.partitionBy("closed").parquet(path)
