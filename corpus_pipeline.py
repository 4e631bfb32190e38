"""Corpus pipeline: quality classifier, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one reads as its docs. All but the
last return the columns of documents. SQL can't express the classifier or the packing, so ORACLE_SQL is
None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import near_dup, packing, quality, secrets
from palimpsest.llm.common import written
from palimpsest.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labelled ones among them.

    Rows are judged one by one, also where they repeat an id or have none. Null and empty texts get the score of a text
    without words. Without labels of both kinds all rows share one judgement. Other columns than those of documents are
    left out; an empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): that of smallest id.

    Texts are judged one by one: of rows that share an id each different text stays unless it is a copy, and
    rows that repeat id and text are one. Rows without an id, and blank texts, all stay; an empty table stays
    empty. Other columns than those of documents are left out.
    """
    return near_dup.one_of_each(docs.select(*COLUMNS))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars counted anew where that happened.

    Rows of any kind stay: null and empty texts as they are, repeated rows each for itself; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    found = secrets.findings(docs, secrets.updated(docs.select("text")), keep_text=True)
    new = secrets.redacted(found)
    n_chars = F.when(F.size("found") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return new.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens.

    Every row is packed, also where rows repeat an id or have none; a null or empty text is its end token alone. An empty
    table gives no rows.
    """
    return packing.pack(docs, vocabulary(), size=1024, end_id=0)


STAGES = [("quality classifier", keep_good), ("near-dedup", keep_one), ("secret scans", hide_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
