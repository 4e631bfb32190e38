"""Grid views of records, and measures of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx


def filtered(rows: DataFrame, needle: str) -> DataFrame:
    """Rows of which a cell contains the text, whatever its case; an empty one keeps all."""
    if not needle:
        return rows
    hit = F.lit(False)
    for c in rows.columns:
        hit = hit | F.contains(F.lower(tx.cell(F.col(c))), F.lit(needle.lower()))
    return rows.where(hit)


def sort_key(value: Column, numeric: bool) -> list[Column]:
    """A total order of cells: numbers, then text, then empty ones."""
    text = tx.cell(value)
    rank = F.when(text == "", 2).when(F.lit(numeric), 0).otherwise(1)
    return [rank, value.cast("double") if numeric else F.lit(None).cast("double"), text]


def is_numeric(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")


def ordered(rows: DataFrame, column: str, *tie: str) -> DataFrame:
    return rows.orderBy(*sort_key(F.col(column), is_numeric(rows, column)), *tie)


def ranked(rows: DataFrame, column: str, *tie: str) -> DataFrame:
    """All rows with rank from 0 in the order of ``ordered``.

    Rows are sorted by ranges and checkpointed with their range and place; a range's rank begins where the
    ranges before it end. Only the ranges' counts meet in one task.
    """
    done = ordered(rows, column, *tie).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    done = done.withColumn("_range", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = done.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))
    return done.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_nth")).drop("_range", "_at", "_nth", "_start")


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts' rows under all their columns, with their section's name."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("section", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def projected(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns that exist, in that order, once each."""
    return rows.select(*dict.fromkeys(c for c in fields if c in rows.columns))


def quality(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """kind, queries, recall_at_5, recall_at_10, mrr.

    ranked: query, id, rank from 0. relevant: query, kind, id. Every query of ``relevant`` counts.
    """
    hits = relevant.join(ranked, ["query", "id"], "left")
    each = hits.groupBy("query", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("rank") < 5).alias("h5"), F.count_if(F.col("rank") < 10).alias("h10"), F.min("rank").alias("first"))
    return each.groupBy("kind").agg(
        F.count("*").alias("queries"), F.avg(F.col("h5") / F.col("n")).alias("recall_at_5"), F.avg(F.col("h10") / F.col("n")).alias("recall_at_10"), F.avg(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0))).alias("mrr")
    )


def kind_shares(relevant: DataFrame) -> DataFrame:
    """kind, n, share of queries."""
    n = relevant.select("query", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("kind", "n", (F.col("n") / F.col("total")).alias("share"))


def as_json(rows: DataFrame) -> DataFrame:
    """record: each row as a JSON object without its nulls."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("record"))


def as_csv(rows: DataFrame, key: str) -> DataFrame:
    """key, line: each row's cells by RFC 4180."""
    cells = []
    for c in rows.columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        cells.append(F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))
    return rows.select(key, F.concat_ws(",", *cells).alias("line"))


def _version(command: str, now: str) -> Column:
    return F.struct(F.lit(command).alias("command"), F.lit(now).alias("timestamp"))


def enveloped(rows: DataFrame, command: str, now: str, order: str) -> DataFrame:
    """envelope: one JSON object of metadata and data, the rows in order, as one command's answer.

    It is for answers that a limit bounds, as all rows meet in it; ``json_lines`` has no such bound.
    """
    data = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rows.columns).alias("r")))).alias("d"))
    return data.select(F.to_json(F.struct(_version(command, now).alias("metadata"), F.transform("d", lambda x: x["r"]).alias("data")), {"ignoreNullFields": "true"}).alias("envelope"))


def json_lines(rows: DataFrame, command: str, now: str) -> DataFrame:
    """part, line: a first line (part 0) of metadata with null data, then (part 1) a line for each row."""
    first = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.to_json(F.struct(_version(command, now).alias("metadata"), F.lit(None).cast("string").alias("data")), {"ignoreNullFields": "false"}).alias("line"))
    return first.unionAll(as_json(rows).select(F.lit(1), "record"))
