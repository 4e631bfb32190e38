"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Rows of a link table that one task handles, about.
TASK_ROWS = 100_000


def dealt_by_rows(table: DataFrame):
    """A function that gives what follows from the written table as many tasks as its counted rows need.

    Where the session's shuffle partitions aren't more than that, they stay.
    """
    tasks = 1 + table.count() // TASK_ROWS
    most = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (lambda df: df.coalesce(tasks)) if tasks < most else (lambda df: df)


def stars_of(rows: Iterator[tuple]) -> list[tuple]:
    """(least id, id) for every other id of each group that pairs tie together."""
    above: dict = {}

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for a, b in rows:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return [(r, x) for x in above if (r := top(x)) != x]


def forests(links: DataFrame) -> DataFrame:
    """Links u, v that tie the same ids together as u, v do: of every TASK_ROWS links that lie together, the stars of what they tie."""
    kind, most = links.schema["u"].dataType.simpleString(), TASK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            found = stars_of(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t.schema.types[0]) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= most:
                yield out()
                held = []
        if held:
            yield out()

    return links.mapInArrow(run, f"u {kind}, v {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id reachable) for every id in ``links``; an empty table gives no rows.

    Links that lie together are first replaced by the stars of what they tie, so that hardly more links than ids
    go on. Then alternating large-star and small-star steps: in each, every id's neighbours are tied to the smallest
    of them, so paths shorten by halves and the table never has more rows than it had links. Repeated
    links, links to itself and links with a null end change nothing.
    """
    both = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    raw = written(both)
    edges = written(forests(dealt_by_rows(raw)(raw)).distinct())
    while not edges.isEmpty():
        few = dealt_by_rows(edges)
        # Done when every id has one link, to an id that has none to a smaller one.
        stars = few(edges.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u")))
        open_ids = stars.where("n > 1").select("v").unionAll(stars.select("u").join(stars.select(F.col("v").alias("u")), "u", "left_semi").select(F.col("u").alias("v")))
        if few(open_ids).isEmpty():
            break
        # Large star: from every id, its larger neighbours go to its smallest neighbour or itself.
        sides = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).withColumnRenamed("u", "k"))
        large = few(few(sides.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("m").alias("u"), "v").where("u < v")).distinct())
        # Small star: each id and its smaller neighbours go to the smallest of them.
        least = few(large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k"))
        near = few(large.join(least, F.col("v") == F.col("k")))
        small = near.select(F.col("m").alias("u"), "v").unionAll(near.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u < v").distinct()
        edges = written(few(small))
    roots = dealt_by_rows(edges)(edges.select("u").distinct()).select(F.col("u").alias("id"), F.col("u").alias("component"))
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionAll(roots)
