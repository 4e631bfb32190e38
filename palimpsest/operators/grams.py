"""Substring search by an index of three letters.

Every place of a text (in lower case) begins a gram: the letter there and the next two, or as many as are left.
So a text of three letters or more lies only in rows that hold all of its grams, and a shorter one only in
those that hold a gram which begins with it. Candidates come from the grams, and their texts are looked at once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grams of a needle that are looked up; any choice of them is right, as candidates are verified.
MOST_GRAMS = 8
#: Texts whose grams a task groups at a time; the rest of an Arrow batch waits.
SLICE_TEXTS = 512
#: What holds a letter in a gram's number.
LETTER = (1 << 21) - 1
#: Folders by the first letter's code; places of a gram are dealt to so many tasks by id.
FOLDERS, SHARES = 64, 16


@dataclass(frozen=True)
class Grams:
    """Rows (gram, ids) in folders by the gram's first letter, sorted by gram, several for a frequent one; counts (gram, n) tell rare ones."""

    spark: SparkSession
    path: str
    text: str

    def table(self, name: str, rest: str) -> DataFrame:
        return self.spark.read.schema(f"gram string, {rest}, folder int").parquet(f"{self.path}/{name}")

    def places(self, holds: Column) -> DataFrame:
        """gram, id of the grams of which ``holds`` (of folder and gram) is true."""
        return self.table("places", "ids array<string>").where(holds).select("gram", F.explode("ids").alias("id"))


def folder(gram: Column) -> Column:
    return F.pmod(F.ascii(gram), F.lit(FOLDERS)).cast("int")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, ids) of rows (id, low): the distinct grams of some texts in lower case, each with the texts that hold it."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_TEXTS):
            rows = batch.slice(start, SLICE_TEXTS)
            pairs = [(np.full(len(found), i), found) for i, text in enumerate(rows.column("low").to_pylist()) if len(found := codes_of(text))]
            if not pairs:
                continue
            texts, codes = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.diff(codes[order], prepend=-1))
            grams = ["".join(chr(c - 1) for k in (42, 21, 0) if (c := code >> k & LETTER)) for code in codes[order][first].tolist()]
            ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)), pa.int32()), rows.column("id").take(pa.array(texts[order])))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), ids], ["gram", "ids"])


def codes_of(low: str) -> np.ndarray:
    """The distinct grams of a text as numbers: three letters of 21 bits, each counted from 1; 0 where no letter is left."""
    letters = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    after = np.concatenate([letters, [0, 0]])
    return np.unique(letters << 42 | after[1:-1] << 21 | after[2:]) if len(letters) else letters


def build(rows: DataFrame, path: str, text: str = "content") -> Grams:
    """Index rows (id, text) in a folder that driver and executors share."""
    # Grams are grouped where they are made, so that a row of the shuffle has many ids and not one.
    low = rows.select("id", F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    each = low.mapInArrow(grouped, "gram string, ids array<string>").withColumn("folder", folder(F.col("gram")))
    each = each.repartition("folder", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(SHARES))).sortWithinPartitions("folder", "gram")
    each.select("gram", "ids", "folder").write.partitionBy("folder").parquet(f"{path}/places")
    found = Grams(rows.sparkSession, path, text)
    counts = found.table("places", "ids array<string>").groupBy("folder", "gram").agg(F.sum(F.size("ids")).alias("n"))
    counts.select("gram", "n", "folder").repartition("folder").sortWithinPartitions("gram").write.partitionBy("folder").parquet(f"{path}/counts")
    return found


def candidates(grams: Grams, needle: str) -> DataFrame:
    """id of rows that may contain the needle (not empty): all that do, and few others."""
    low = needle.lower()
    code = lambda g: ord(g[0]) % FOLDERS
    if len(low) < 3:
        return grams.places((F.col("folder") == code(low)) & F.startswith("gram", F.lit(low))).select("id").distinct()
    mine = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    counts = grams.table("counts", "n long").where(F.col("folder").isin(sorted({code(g) for g in mine})) & F.col("gram").isin(mine))
    known = {r["gram"]: r["n"] for r in counts.collect()}  # a needle's grams
    if len(known) < len(mine):  # one that no text has
        return grams.places(F.lit(False)).select("id")
    rare = sorted(mine, key=lambda g: (known[g], g))[:MOST_GRAMS]
    rows = grams.places(F.col("folder").isin(sorted({code(g) for g in rare})) & F.col("gram").isin(rare))
    return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")


def containing(grams: Grams, rows: DataFrame, needle: str) -> DataFrame:
    """The rows (id, text) that contain the needle, whatever its case; an empty one keeps all."""
    if not needle:
        return rows
    return rows.join(candidates(grams, needle), "id", "left_semi").where(F.contains(F.lower(F.coalesce(grams.text, F.lit(""))), F.lit(needle.lower())))
