"""Ranked lexical search over a length-stratified index.

Documents whose lengths give the same normaliser m are one stratum, dealt to blocks of bounded size. In a block a
term's postings are runs of equal tf, so a run's impact is computed once and holds for all its documents. A term's
greatest tf bounds what a block can give: blocks are visited by falling bounds, and no further once the bound is
below an item's k-th best score. Each task keeps the best of its blocks; Spark merges them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import runs, slices, text_of, written

#: Documents and postings of a block, about, and blocks that a task orders at a time.
BLOCK_DOCS, BLOCK_POSTINGS, HELD_BLOCKS = 4096, 1 << 16, 64
#: Distinct terms that are sent to tasks at once, to keep of texts or to look for. Items with more of them take several passes.
SENT_TERMS = 200_000
#: Strata whose numbers of blocks are broadcast (16 bytes each); beyond it they are joined.
BROADCAST_STRATA = 1 << 20
#: The normaliser: 100 - 25 for every document, and 25 times its length in mean lengths.
LEAST_M, PER_LENGTH = 75, 25
#: Bytes as terms have them: letters, digits and all that isn't ASCII; A-Z in lower case, others blank.
FOLDED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in order."""
    return text.translate(FOLDED).split()


def term_id(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) - 2**63


@dataclass(frozen=True)
class Index:
    """blocks: m, part, doc_ids, and runs (terms, tfs, ends) of places; lexicon: term, df; N documents with terms and their L terms."""

    blocks: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int


def counted(docs: DataFrame, wanted: set[bytes] | None) -> DataFrame:
    """doc_id, n, terms, tfs of every row that has a term; terms that aren't wanted count in n alone."""
    ids = None if wanted is None else {t: term_id(t) for t in wanted}
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value
        for b in slices(batches):
            n, sizes, terms, tfs = [], [0], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                counts = Counter(words)
                if ids is None:
                    terms += map(term_id, counts)
                    tfs += counts.values()
                else:
                    there = counts.keys() & ids.keys()
                    terms += map(ids.__getitem__, there)
                    tfs += map(counts.__getitem__, there)
                n.append(len(words))
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int64()), (tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<int>").where("n > 0"))


def block_of(m: int, part: int, doc_ids: np.ndarray, terms: pa.ListArray, tfs: pa.ListArray) -> pa.RecordBatch:
    """One block: documents ascending by id, postings by term and tf."""
    by_id = np.argsort(doc_ids, kind="stable")
    place = np.empty(len(doc_ids), dtype=np.int32)
    place[by_id] = np.arange(len(doc_ids), dtype=np.int32)
    places = np.repeat(place, np.diff(terms.offsets.to_numpy()))
    t, f = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
    order = np.lexsort((places, f, t))
    t, f, places = t[order], f[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (f[1:] != f[:-1])])) if len(t) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(t)) if len(t) else starts
    lists = [pa.array([x], pa.list_(kind)) for x, kind in ((doc_ids[by_id], pa.int64()), (t[starts], pa.int64()), (f[starts], pa.int32()), (ends, pa.int32()), (places, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([part], pa.int64()), *lists], names=["m", "part", "doc_ids", "terms", "tfs", "ends", "places"])


#: Stands for a null doc_id in a block: after all others.
NO_ID = 2**63 - 1


def index(docs: DataFrame, wanted: set[bytes] | None = None) -> Index:
    """The index of every row of docs (doc_id, text, others left out), of all terms or only of wanted ones (at most SENT_TERMS).

    Rows are documents of their own, also where they share a doc_id or have none. Null, empty and termless texts are
    none. Terms are told apart by 64-bit hashes; where only wanted ones are kept, by their bytes.
    """
    rows = counted(docs, wanted)
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = rows.withColumn("m", F.expr(f"{LEAST_M} + ({PER_LENGTH} * n * {n_docs}L) div {max(1, n_terms)}L")).where("size(terms) > 0")
    size = F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.size("terms")) / BLOCK_POSTINGS)
    strata = written(rows.groupBy("m").agg(F.ceil(size).cast("long").alias("parts")))
    few = F.broadcast(strata) if strata.count() <= BROADCAST_STRATA else strata
    rows = rows.join(few, "m").withColumn("part", F.pmod(F.xxhash64("doc_id", "n", "terms"), "parts"))
    rows = rows.select("m", "part", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "terms", "tfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            t = t.combine_chunks()
            terms, tfs = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (t.column(3), t.column(4)))
            terms, tfs = (pa.concat_arrays([c]) for c in (terms, tfs))
            yield block_of(t.column(0)[0].as_py(), t.column(1)[0].as_py(), t.column(2).to_numpy(), terms, tfs)

    dealt = rows.repartition("m", "part").sortWithinPartitions("m", "part")
    blocks = written(dealt.mapInArrow(run, "m long, part long, doc_ids array<long>, terms array<long>, tfs array<int>, ends array<int>, places array<int>"))
    # A run's size is the distance from the end before it.
    before = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    sizes = F.transform(F.arrays_zip("terms", "ends", before.alias("before")), lambda x: F.struct(x["terms"].alias("term"), (x["ends"] - x["before"]).cast("long").alias("n")))
    lexicon = written(blocks.where("size(terms) > 0").select(F.inline(sizes)).groupBy("term").agg(F.sum("n").alias("df")))
    return Index(blocks, lexicon, n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n: the terms of all texts of each item, repeats counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["item_id", "term", "n"])

    rows = items.where("item_id IS NOT NULL").select(items["item_id"].cast("long").alias("item_id"), text_of(items).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n")))


@dataclass
class Wanted:
    """Items as rows over sorted distinct terms: of item i, places[starts[i]:starts[i + 1]] and how often each occurs."""

    items: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    times: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    k: int


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Block:
    """A block's runs of wanted terms: their impacts, and what the block can give each item at most."""

    def __init__(self, row: dict[str, np.ndarray], m: int, wanted: Wanted):
        at = np.minimum(np.searchsorted(wanted.terms, row["terms"]), len(wanted.terms) - 1)
        there = np.flatnonzero(wanted.terms[at] == row["terms"])
        self.term = at[there]
        self.impact = wanted.weights[self.term] * impact(row["tfs"][there].astype(np.int64), m)
        self.ends = row["ends"][there]
        self.starts = np.concatenate([[0], row["ends"][:-1]])[there]
        self.places, self.doc_ids = row["places"], row["doc_ids"]
        most = np.zeros(len(wanted.terms), dtype=np.int64)
        most[self.term] = self.impact  # runs of a term ascend by tf: the last stays
        self.bounds = np.add.reduceat(wanted.times * most[wanted.places], wanted.starts[:-1])

    def scores(self, wanted: Wanted, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores above 0 and doc_ids for an item."""
        at = slice(wanted.starts[item], wanted.starts[item + 1])
        lo, hi = (np.searchsorted(self.term, wanted.places[at], side=s) for s in ("left", "right"))
        run = ranges(lo, hi)
        value = self.impact[run] * np.repeat(wanted.times[at], hi - lo)
        sizes = self.ends[run] - self.starts[run]
        total = np.zeros(len(self.doc_ids), dtype=np.int64)
        np.add.at(total, self.places[ranges(self.starts[run], self.ends[run])], np.repeat(value, sizes))
        hit = np.flatnonzero(total)
        if len(hit) > wanted.k:  # what is below the k-th can't be among the best
            hit = hit[total[hit] >= np.partition(total[hit], len(hit) - wanted.k)[len(hit) - wanted.k]]
        return total[hit], self.doc_ids[hit]


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], ..., hi[0] - 1, lo[1], ... in one array."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


class Best:
    """An item's k best (score, doc_id), greater scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def floor(self) -> int:
        """Documents below this score can't come in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


def visited(blocks: list[Block], wanted: Wanted, best: list[Best]) -> int:
    """Let every item visit blocks by falling bounds while they can still give it something; the number of visits."""
    if not blocks:
        return 0
    bounds = np.stack([b.bounds for b in blocks], axis=1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    visits = 0
    for i, mine in enumerate(best):
        for b in order[i]:
            if bounds[i, b] < mine.floor():
                break
            mine.add(*blocks[b].scores(wanted, i))
            visits += 1
    return visits


COLUMNS = ("doc_ids", "terms", "tfs", "ends", "places")


def one_pass(index: Index, rows: list, k: int) -> DataFrame:
    """item_id, doc_id, score: what each task has found best for some items' rows (item_id, term, n)."""
    spark = index.blocks.sparkSession
    rows = sorted(rows)
    distinct = {t: term_id(t) for _, t, _ in rows}
    asked = spark.createDataFrame([(x,) for x in distinct.values()], "term long")
    df = dict(index.lexicon.join(F.broadcast(asked), "term", "left_semi").collect())  # SENT_TERMS rows at most, or one item's
    terms = np.array(sorted(df), dtype=np.int64)
    rows = [r for r in rows if distinct[r[1]] in df]
    if not rows:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    items, starts = np.unique([r[0] for r in rows], return_index=True)
    places = np.searchsorted(terms, [distinct[r[1]] for r in rows])
    weights = np.array([weight(index.n_docs, df[int(t)]) for t in terms], dtype=np.int64)
    sent = spark.sparkContext.broadcast(Wanted(items, np.append(starts, len(rows)), places, np.array([r[2] for r in rows], dtype=np.int64), terms, weights, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        best = [Best(k) for _ in wanted.items]
        held: list[Block] = []
        for b in slices(batches, HELD_BLOCKS):
            held = [Block({c: b.column(c)[i].values.to_numpy() for c in COLUMNS}, b.column("m")[i].as_py(), wanted) for i in range(b.num_rows)]
            visited(held, wanted, best)
        ids = np.repeat(wanted.items, [len(x.ids) for x in best])
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, np.concatenate([x.ids for x in best]), np.concatenate([x.scores for x in best]))], names=["item_id", "doc_id", "score"])

    return index.blocks.where("size(terms) > 0").select("m", *COLUMNS).mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0, equal scores by doc_id (nulls last).

    Items are rows (item_id, text, others left out). Rows of one item_id are one item with the terms of all; rows without
    an item_id, and items without terms that documents hold, give nothing. A score sums weight times
    (1000000000 * tf) div (1000 * tf + 12 * m) over the item's terms, repeats included.
    """
    rows = item_terms(items)
    passes = max(1, -(-rows.count() // SENT_TERMS))
    found = None
    for p in range(passes):  # each sends the terms of its items alone
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).select("item_id", F.col("term"), "n").collect()
        one = one_pass(index, [(r[0], bytes(r[1]), r[2]) for r in part], k)
        found = one if found is None else found.unionAll(one)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``search`` over an index of docs that is made for the terms of these items (for all terms, if they have more than SENT_TERMS)."""
    asked = item_terms(items).select("term").distinct()
    few = asked.limit(SENT_TERMS + 1).collect()
    return search(index(docs, {bytes(r[0]) for r in few} if len(few) <= SENT_TERMS else None), items, k)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS every, CAST(sum(n) AS BIGINT) AS length FROM n),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * every + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, every),
m AS (SELECT doc_id, 100 - 25 + (25 * n * every) // length AS m FROM n, s),
r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""
