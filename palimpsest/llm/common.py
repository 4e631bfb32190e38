"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task handles at a time; the rest of an Arrow batch waits.
SLICE_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (as in tests, on one machine) a temporary folder is taken and set.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if (own := sc._jsc.sc().getCheckpointDir()).isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``by`` columns of sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    mark = None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(k).to_numpy() for k in range(by)])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(at[:, lo]) != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = tuple(at[:, lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(docs[text], F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
