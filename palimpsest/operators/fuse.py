"""Reciprocal-rank fusion, token budgets, and context assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import facts as fx
from palimpsest.operators import search as sx
from palimpsest.operators import vectors as vx
from palimpsest.operators.postings import Index
from palimpsest.operators.search import CURRENT, Validity

K, CHANNEL_LIMIT = 60.0, 50


def fuse(channels: dict[str, DataFrame], k: float = K) -> DataFrame:
    """id, score: the sum of 1 / (k + rank) over the channels (id, rank from 0)."""
    each = [c.select("id", "rank") for c in channels.values()]
    return reduce(DataFrame.unionAll, each).groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def channels_of(memories: DataFrame, facts: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, model: str, scope: str | None = None, validity: Validity = CURRENT, index: Index | None = None, fact_index: Index | None = None) -> dict[str, DataFrame]:
    """The ranked lists of a hybrid search; rules leave the full-text one after its limit. index: of the memories; fact_index: of the facts."""
    found = {
        "fts": sx.search(memories, query, scope, validity, CHANNEL_LIMIT, index).where("rule_id IS NULL").select("id", "rank"),
        "facts": fx.candidates(facts, memories, query, scope, validity, CHANNEL_LIMIT, fact_index).select("id", "rank"),
    }
    if vectors is not None and vector is not None:
        found["vector"] = vx.topk(vectors, memories, vector, model, scope, validity, CHANNEL_LIMIT).select("id", "rank")
    # Ranks close up where rules have left.
    order = sx.W.orderBy("rank")
    return found | {"fts": found["fts"].withColumn("rank", F.row_number().over(order) - 1)}


def hybrid(memories: DataFrame, channels: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """The fused order's first ``limit`` memories, with rank and score."""
    return memories.join(F.broadcast(sx.with_rank(fuse(channels), *sx.by_score(), limit=limit)), "id")


def channel_counts(channels: dict[str, DataFrame]) -> DataFrame:
    """channel, n."""
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("n")).select(F.lit(c).alias("channel"), "n") for c, df in channels.items()])


def gate(vectors: DataFrame, model: str) -> DataFrame:
    """model, n_vectors, mode: hybrid if the model has any vector, else fts."""
    return vectors.agg(F.count_if(F.col("model") == model).alias("n_vectors")).select(F.lit(model).alias("model"), "n_vectors", F.when(F.col("n_vectors") > 0, "hybrid").otherwise("fts").alias("mode"))


class NoVectors(ValueError):
    """A hybrid search was asked for by name, but the model has no vector."""


def mode(vectors: DataFrame, model: str, asked: str = "auto") -> str:
    """hybrid or fts: as asked, or (auto) hybrid if the model has any vector. To ask for hybrid without one is an error."""
    if asked not in ("auto", "hybrid", "fts"):
        raise ValueError(f"no such mode: {asked}")
    some = asked != "fts" and not vectors.where(F.col("model") == model).select("model").limit(1).isEmpty()
    if asked == "hybrid" and not some:
        raise NoVectors(f"no vector of {model}")
    return "hybrid" if some else "fts"


def packed(rows: DataFrame, budget: int, priority: str, spent: DataFrame | None = None) -> DataFrame:
    """rows with cost and included: taken in ascending priority if the cost fits what remains, else passed over.

    rows is a limited list of candidates, which one fold goes through in order. spent: one row of column
    spent, what of the budget is gone before.
    """
    row = F.struct(*rows.columns)
    line = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(priority).alias("p"), "id", tx.tokens_about(F.col("content")).alias("cost"), row.alias("row")))).alias("line"))
    left = F.lit(budget)
    if spent is not None:
        line, left = line.crossJoin(F.broadcast(spent)), F.lit(budget) - F.col("spent")
    kind = rows.select(row.alias("row")).schema["row"].dataType.simpleString()
    zero = F.struct(F.greatest(left, F.lit(0)).cast("long").alias("left"), F.array().cast(f"array<struct<row:{kind},cost:bigint,included:boolean,nth:int>>").alias("out"))
    fold = F.aggregate(
        "line",
        zero,
        lambda acc, x: F.struct(
            F.when(x["cost"] <= acc["left"], acc["left"] - x["cost"]).otherwise(acc["left"]).alias("left"),
            F.concat(acc["out"], F.array(F.struct(x["row"].alias("row"), x["cost"].alias("cost"), (x["cost"] <= acc["left"]).alias("included"), F.size(acc["out"]).alias("nth")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return line.select(F.inline(fold)).select("row.*", "cost", "included", "nth")


def budget_report(done: DataFrame, budget: int, channel: str) -> DataFrame:
    """requested, estimated, included, dropped, dropped_ids (in order, comma-joined), channel, candidates."""
    dropped = F.array_sort(F.collect_list(F.when(~F.col("included"), F.struct("nth", "id"))))
    return done.agg(
        F.lit(budget).alias("requested"), F.coalesce(F.sum(F.when(F.col("included"), F.col("cost"))), F.lit(0)).alias("estimated"), F.count_if("included").alias("included"),
        F.count_if(~F.col("included")).alias("dropped"), F.array_join(F.transform(dropped, lambda x: x["id"]), ",").alias("dropped_ids"), F.lit(channel).alias("channel"), F.count("*").alias("candidates"),
    )


def budget_recall(memories: DataFrame, scope: str, budget: int, limit: int = 50) -> DataFrame:
    """A recall's memories with cost and included, the newest first to be taken."""
    rows = sx.recall(memories, scope, limit).withColumn("priority", -F.col("place"))
    return packed(rows, budget, "priority")


def budget_search(memories: DataFrame, query: str, budget: int, limit: int = 20, index: Index | None = None) -> DataFrame:
    """A search's memories with cost and included, the best first to be taken."""
    return packed(sx.search(memories, query, limit=limit, index=index), budget, "rank")


def context(memories: DataFrame, facts: DataFrame, scope: str, budget: int, query: str | None = None, limit: int = 50, index: Index | None = None, fact_index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """A scope's active rules, and its candidates with cost and included.

    Rules count in full even beyond the budget, and candidates share what remains. Without a query these
    are the newest; with one, the fused order of recency, full text and facts. Rules take places of the
    limits before they leave.
    """
    rules = active_rules(memories).where(F.col("scope") == scope)
    recent = sx.recall(memories, scope, limit).where("rule_id IS NULL")
    recent = recent.withColumn("rank", F.row_number().over(sx.W.orderBy(F.desc("place"))) - 1)
    if query and query.strip():
        found = channels_of(memories, facts, None, query, None, "", scope, index=index, fact_index=fact_index)
        order = fuse({"recency": recent, **found})
        rows = memories.join(F.broadcast(order), "id").withColumn("priority", -F.round("score", 10))
    else:
        rows = recent.withColumn("priority", F.col("rank").cast("double"))
    spent = rules.agg(F.coalesce(F.sum(tx.tokens_about(F.col("content"))), F.lit(0)).alias("spent"))
    return rules, packed(rows, budget, "priority", spent)


def active_rules(memories: DataFrame) -> DataFrame:
    return memories.where("rule_id IS NOT NULL AND (status IS NULL OR status <> 'retired')")
