"""Full-text ranking by BM25, and validity slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import times
from palimpsest.operators import postings
from palimpsest.operators.postings import Index

K1, B, LEAST_IDF = postings.K1, postings.B, postings.LEAST_IDF


@dataclass(frozen=True)
class Validity:
    """Which versions count: current ones, those valid at an instant, or all.

    The instant is ISO 8601 with an offset (or Z) in any precision; it is compared in the form in which memories hold
    theirs. What isn't an instant is refused.
    """

    as_of: str | None = None
    all: bool = False

    def __post_init__(self):
        if self.as_of is not None and self.all:
            raise ValueError("as_of and all exclude each other")
        if self.as_of is not None:
            object.__setattr__(self, "as_of", times.instant(self.as_of))

    def holds(self) -> Column:
        if self.all:
            return F.lit(True)
        if self.as_of is None:
            return F.col("valid_to").isNull()
        return (F.coalesce("valid_from", "created_at") <= self.as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > self.as_of))


CURRENT = Validity()


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with the columns behind a generator, so that what reads them several times doesn't compute them anew."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _line(text: str) -> Column:
    """The terms of a text between blanks."""
    return F.concat(F.lit(" "), F.array_join(tx.terms(F.col(text)), " "), F.lit(" "))


def scored(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    """Those rows that hold a phrase of the query, with score (greater is better).

    Lengths and phrase counts come from all rows, whatever is filtered afterwards; they reach the join as
    one row. Each row's terms are made once per scan and aren't shuffled.
    """
    phrases = tx.phrases_of(query)
    if not phrases:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
    fs = [f"_f{i}" for i in range(len(phrases))]
    # A lookahead counts occurrences that overlap as well.
    found = {f: F.regexp_count("_line", F.lit(f"(?= {' '.join(p)} )")) for f, p in zip(fs, phrases, strict=True)}
    counted = _once(_once(rows, _line=_line(text)), **found, _n=F.regexp_count("_line", F.lit(" ")) - 1 - F.when(F.col("_line") == "  ", 1).otherwise(0)).drop("_line")
    stats = counted.agg(F.count("*").alias("_all"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f) > 0).alias(f"_d{f}") for f in fs])
    hits = counted.where(" OR ".join(f"{f} > 0" for f in fs)).crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("_n") / F.col("_avg"))
    score = F.lit(0.0)
    for f in fs:
        df = F.col(f"_d{f}")
        idf = F.ln((F.col("_all") - df + 0.5) / (df + 0.5))
        score = score + F.when(idf <= 0, LEAST_IDF).otherwise(idf) * F.col(f) * (K1 + 1) / (F.col(f) + norm)
    return hits.withColumn("score", score).select(*rows.columns, "score")


def with_rank(rows: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows of an order, with rank from 0; only they meet in one task."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)


def by_score() -> tuple[Column, Column]:
    return F.round("score", 10).desc(), F.col("id").asc()


def search(memories: DataFrame, query: str, scope: str | None = None, validity: Validity = CURRENT, limit: int = 20, index: Index | None = None) -> DataFrame:
    """The best ``limit`` memories for a query, rules included: rank, score and the memories' columns.

    With an index of the memories only its postings of the query's terms are read, in those blocks that can reach
    the limit, and no text but the best ones'; without one all texts are.
    """
    if index is None:
        hits = scored(memories, query).where(validity.holds())
        if scope is not None:
            hits = hits.where(F.col("scope") == scope)
        return with_rank(hits, *by_score(), limit=limit)
    alive = memories.where(validity.holds())
    if scope is not None:
        alive = alive.where(F.col("scope") == scope)
    best = with_rank(postings.best(index, query, limit, alive), *by_score(), limit=limit)
    return memories.join(F.broadcast(best), "id").select(*memories.columns, "score", "rank")


def matching(memories: DataFrame, query: str, text: str = "content", index: Index | None = None) -> DataFrame:
    """Memories that hold a phrase of the query, by their index if there is one."""
    if index is not None:
        return memories.join(postings.matching(index, query), "id", "left_semi")
    any_of = "|".join(" ".join(p) for p in tx.phrases_of(query))
    return memories.where(_line(text).rlike(f" (?:{any_of}) ") if any_of else F.lit(False))


def recall(memories: DataFrame, scope: str, limit: int = 50, validity: Validity = CURRENT) -> DataFrame:
    """The newest ``limit`` memories of a scope, with place from 0 in ascending time."""
    rows = memories.where((F.col("scope") == scope) & validity.holds())
    top = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy("created_at", "id")) - 1)


def export_history(memories: DataFrame, scope: str) -> DataFrame:
    """All versions of a scope but rules, in ascending time."""
    return memories.where((F.col("scope") == scope) & (F.col("role") != "rule")).orderBy("created_at", "id")


def get(memories: DataFrame, ident: str, validity: Validity = Validity(all=True)) -> DataFrame:
    return memories.where((F.col("id") == ident) & validity.holds()).limit(1)
