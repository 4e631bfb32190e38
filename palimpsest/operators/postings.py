"""A full-text index in immutable segments, kept in step with what it indexes, and ranked search that reads few blocks of it.

A segment holds the postings of the texts that one change brought: a row (term, block, id, n, at) for each
term of a text, at being its places and n the number of the text's terms. Folders go by a hash of the term, and
files (a few for each folder) are sorted by term and block; a column of its own counts the places. Blocks are texts of like length. A second table bounds each term in each
block: its texts, its greatest count, the shortest text's n. A change also names the texts that it takes away: its
``dead`` ids bury what older segments hold of them, and ``minus`` counts their terms, so that statistics are
sums over segments and equal those of an index built anew. Segments are merged from their postings alone.

A ranked search computes what each block can give at most, scores the most promising blocks, and then only those
that can still reach the last place.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Texts of a block, and occurrences of a folder, about.
BLOCK_TEXTS, BUCKET_TERMS = 8192, 4_000_000
#: A bucket's rows go to so many tasks at least, and to one for so many texts.
SHARES, SHARE_TEXTS = 8, 1_000_000
#: Texts, and bytes of their terms, whose places a task groups at a time; the rest of an Arrow batch waits.
SLICE_TEXTS, SLICE_BYTES = 4096, 16_000_000
#: Blocks that a ranked search scores before it knows what the others must reach.
FIRST_BLOCKS = 8
#: So many blocks are named in the filter that reaches the files; more are told apart after it.
PUSHED_BLOCKS = 1000
#: A run of this many late segments is merged when none is more than GROWTH times as large as all that follow it.
RUN, GROWTH = 4, 4
POSTINGS = "term string, block long, id string, n int, at array<int>, bucket int"
BOUNDS = "term string, block long, texts long, most int, least int, places long, bucket int"


@dataclass(frozen=True)
class Segment:
    """What one change has written below ``path``, and its counts: texts and terms that came and that went."""

    path: str
    number: int
    buckets: int
    texts: int = 0
    terms: int = 0
    dead_texts: int = 0
    dead_terms: int = 0


@dataclass(frozen=True)
class Index:
    """The segments of an index, oldest first. A change makes a new value; readers keep the one they have."""

    spark: SparkSession
    path: str
    segments: tuple[Segment, ...] = ()

    def table(self, s: Segment, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{s.path}/{name}")

    def of_terms(self, name: str, schema: str, terms: list[str]) -> DataFrame:
        """The rows of some terms in all segments, with the segment's number; other folders and row groups aren't read."""
        each = []
        for s in self.segments:
            if s.terms:
                buckets = sorted({bucket_of(t, s.buckets) for t in terms})
                each.append(self.table(s, name, schema).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket").withColumn("segment", F.lit(s.number)))
        return reduce(DataFrame.unionAll, each) if each else self.spark.createDataFrame([], f"{schema.removesuffix(', bucket int')}, segment int")

    def dead(self) -> DataFrame | None:
        """id, until: a text's postings in segments before ``until`` are buried. None if nothing ever was."""
        each = [self.table(s, "dead", "id string").withColumn("until", F.lit(s.number)) for s in self.segments if s.dead_texts]
        return reduce(DataFrame.unionAll, each).groupBy("id").agg(F.max("until").alias("until")) if each else None

    def postings(self, terms: list[str]) -> DataFrame:
        """segment, term, block, id, n, at of some terms of the texts that are there."""
        rows, dead = self.of_terms("postings", POSTINGS, terms), self.dead()
        if dead is None:
            return rows
        dead = dead.withColumnRenamed("id", "dead_id")
        return rows.join(dead.hint("merge"), (F.col("id") == F.col("dead_id")) & (F.col("segment") < F.col("until")), "left_anti")

    @property
    def every(self) -> int:
        return sum(s.texts - s.dead_texts for s in self.segments)

    @property
    def mean(self) -> float:
        """Terms of a text on average."""
        return sum(s.terms - s.dead_terms for s in self.segments) / max(1, self.every)

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many texts hold each term, from the segments' counts."""
        up = self.of_terms("bounds", BOUNDS, terms).groupBy("term").agg(F.sum("texts").alias("n"))
        each = [self.table(s, "minus", "term string, texts long").where(F.col("term").isin(terms)).select("term", (-F.col("texts")).alias("n")) for s in self.segments if s.dead_texts]
        rows = reduce(DataFrame.unionAll, [up, *each]).groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in rows.collect()}  # a query's terms

    def changed(self, added: DataFrame | None, gone: DataFrame | None = None) -> Index:
        """The index after one more change, which writes one segment and reads no other.

        added: rows (id, text) of new texts and of the new wording of old ones. gone: rows (id, text) of those that go or
        are reworded, as they were indexed. Ids are unique among what is there. An empty change adds nothing.
        """
        number = 1 + max((s.number for s in self.segments), default=0)
        s = Segment(f"{self.path}/segment-{number:06d}-{uuid.uuid4().hex[:8]}", number, 1)
        if added is not None:
            s = write_texts(s, added)
        if gone is not None:
            s = write_dead(s, gone)
        return replace(self, segments=(*self.segments, s)) if s.texts or s.dead_texts else self

    def merged(self) -> Index:
        """The index with its late segments merged, if they are many and small (see RUN and GROWTH)."""
        late, total = 0, 0
        for s in reversed(self.segments):
            if late and s.texts > GROWTH * max(1, total):
                break
            late, total = late + 1, total + s.texts
        return self.joined(late) if late >= RUN else self

    def joined(self, late: int) -> Index:
        """The index with its last ``late`` segments as one, made of their postings without the texts that died meanwhile.

        Nothing before them changes. What died of older segments stays dead; where there are none, nothing stays dead.
        """
        run, older = replace(self, segments=self.segments[-late:]), self.segments[:-late]
        last = run.segments[-1]
        sums = {k: sum(asdict(s)[k] for s in run.segments) for k in ("texts", "terms", "dead_texts", "dead_terms")}
        if not older:
            sums = {"texts": run.every, "terms": sums["terms"] - sums["dead_terms"], "dead_texts": 0, "dead_terms": 0}
        s = Segment(f"{self.path}/segment-{last.number:06d}-{uuid.uuid4().hex[:8]}", last.number, buckets_for(sums["terms"]), **sums)
        rows = [run.table(x, "postings", POSTINGS).drop("bucket").withColumn("segment", F.lit(x.number)) for x in run.segments if x.terms]
        if rows:
            alive, dead = reduce(DataFrame.unionAll, rows), run.dead()
            if dead is not None:
                alive = alive.join(dead.withColumnRenamed("id", "dead_id").hint("merge"), (F.col("id") == F.col("dead_id")) & (F.col("segment") < F.col("until")), "left_anti")
            shift = F.shiftright("block", CLASS_BITS)
            sizes = alive.groupBy(shift.alias("class")).agg(F.countDistinct("id").alias("n")).collect()  # a row for each class of lengths
            alive = alive.withColumn("block", block_in(shift, F.col("id"), {r["class"]: r["n"] for r in sizes}))
            write_postings(s, dealt(alive, s))
        if s.dead_texts:
            reduce(DataFrame.unionAll, [run.table(x, "dead", "id string") for x in run.segments if x.dead_texts]).distinct().write.parquet(f"{s.path}/dead")
            # Of the texts that died, those of this run are no longer in its postings: they aren't to be subtracted again.
            count = lambda x, name, c: run.table(x, name, f"term string, {c} long").select("term", F.col(c).alias("n"))
            minus = [count(x, "minus", "texts") for x in run.segments if x.dead_texts]
            minus += [count(x, "bounds", "texts").select("term", (-F.col("n")).alias("n")) for x in run.segments if x.terms] + ([count(s, "bounds", "texts")] if rows else [])
            left = reduce(DataFrame.unionAll, minus).groupBy("term").agg(F.sum("n").alias("texts")).where("texts > 0")
            left.write.parquet(f"{s.path}/minus")
        return replace(self, segments=(*older, s))


#: A block's number is its class of lengths, then its place in the class.
CLASS_BITS = 24


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def buckets_for(terms: int) -> int:
    return max(1, -(-terms // BUCKET_TERMS))


def block_in(length_class: Column, ident: Column, sizes: dict[int, int]) -> Column:
    """The block of a text: its class of lengths, and one of as many places as the class's size asks for."""
    many = {c: -(-n // BLOCK_TEXTS) for c, n in sizes.items() if n > BLOCK_TEXTS}
    places = F.lit(1)
    for c, k in many.items():
        places = F.when(length_class == c, k).otherwise(places)
    return F.shiftleft(length_class.cast("long"), CLASS_BITS) + F.pmod(F.xxhash64(ident), places)


def dealt(rows: DataFrame, s: Segment) -> DataFrame:
    """Rows with their bucket, each bucket's dealt to a few tasks by block, so that files are no more than these and frequent terms are parted.

    Tasks of any blocks would write a file for each bucket, and both numbers grow with the input.
    """
    shares = max(SHARES, -(-s.texts // SHARE_TEXTS))
    return rows.withColumn("bucket", bucket(F.col("term"), s.buckets)).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(shares)))


def write_texts(s: Segment, rows: DataFrame) -> Segment:
    """Write the postings and bounds of rows (id, text)."""
    ident, text = rows.columns[:2]
    length = F.octet_length(text)
    length_class = F.floor(4 * F.log2(length.cast("double") + 1)).cast("int")
    # Four classes for each doubling of a text's bytes: their number depends on lengths alone.
    sizes = rows.groupBy(length_class.alias("class")).agg(F.count("*").alias("n"), F.sum(length).alias("bytes")).collect()
    texts = sum(r["n"] for r in sizes)
    s = replace(s, texts=texts, buckets=buckets_for(sum(r["bytes"] for r in sizes) // 5))
    if not texts:
        return s
    line = F.array_join(tx.terms(F.col(text)), " ")
    lines = rows.select(F.col(ident).alias("id"), block_in(length_class, F.col(ident), {r["class"]: r["n"] for r in sizes}).alias("block"), line.alias("line"))
    # A text's places are grouped where its terms are made: what is shuffled is postings, and nothing is grouped after it.
    each = lines.mapInArrow(partial(placed, buckets=s.buckets), "id string, block long, n int, term string, at array<int>")
    return write_postings(s, dealt(each, s))


def placed(batches: Iterator[pa.RecordBatch], buckets: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (id, block, n, term, at), one for a term of a text, of rows (id, block, line), a line being a text's terms between blanks.

    A slice's rows come in the order of the files (bucket, term, block), so what sorts them after the shuffle merges long runs.
    """
    for rows in sliced(batches):
        rows = rows.filter(pc.not_equal(rows.column("line"), ""))
        if not rows.num_rows:
            continue
        rows = rows.take(pc.sort_indices(rows, [("block", "ascending"), ("id", "ascending")]))
        lists = pc.split_pattern(rows.column("line"), " ")
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        folders = np.fromiter((bucket_of(t, buckets) for t in words.dictionary.to_pylist()), np.int32, len(order))
        order = order[np.argsort(folders[order], kind="stable")]
        terms, rank = words.dictionary.take(pa.array(order)), np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        text, word = np.repeat(np.arange(len(lists)), lengths), rank[words.indices.to_numpy()]
        at = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # Two stable sorts of 16 bits, which take linear time; texts and places stay ascending.
        order = np.argsort((word & 0xFFFF).astype(np.uint16), kind="stable")
        order = order[np.argsort((word[order] >> 16).astype(np.uint16), kind="stable")]
        text, word = text[order], word[order]
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(word.astype(np.int64), prepend=-1) != 0))
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), pa.array(at[order], pa.int32()))
        text, word = text[first], word[first]
        columns = [rows.column("id").take(pa.array(text)), rows.column("block").take(pa.array(text)), pa.array(lengths[text], pa.int32()), terms.take(pa.array(word)), places]
        yield pa.RecordBatch.from_arrays(columns, ["id", "block", "n", "term", "at"])


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows (id, block, line), at most SLICE_TEXTS and about SLICE_BYTES of lines at a time."""
    for batch in batches:
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column("line")), 0).to_numpy().astype(np.int64)), 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, SLICE_BYTES + (ends[start - 1] if start else 0)))
            end = min(start + SLICE_TEXTS, max(start + 1, full))
            yield batch.slice(start, end - start)
            start = end


def write_postings(s: Segment, rows: DataFrame) -> Segment:
    """Write rows (bucket, term, block, id, n, at), and what bounds them."""
    spark = rows.sparkSession
    # The number of places has a column, so that bounds are made without reading places. Ids need no order.
    rows = rows.select("term", "block", "id", "n", "at", F.size("at").alias("times"), "bucket")
    rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{s.path}/postings")
    back = spark.read.schema(f"{POSTINGS}, times int").parquet(f"{s.path}/postings")
    bounds = back.groupBy("bucket", "term", "block").agg(F.count("*").alias("texts"), F.max("times").alias("most"), F.min("n").alias("least"), F.sum("times").alias("places"))
    bounds.select("term", "block", "texts", "most", "least", "places", "bucket").repartition("bucket").sortWithinPartitions("term", "block").write.partitionBy("bucket").parquet(f"{s.path}/bounds")
    return replace(s, terms=spark.read.schema(BOUNDS).parquet(f"{s.path}/bounds").agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0])


def write_dead(s: Segment, rows: DataFrame) -> Segment:
    """Write the ids of rows (id, text) that are no longer there, and how many of them hold each term."""
    spark = rows.sparkSession
    ident, text = rows.columns[:2]
    terms = rows.select(F.col(ident).alias("id"), tx.terms(F.col(text)).alias("terms"))
    terms.select("id", F.size("terms").alias("n")).write.parquet(f"{s.path}/dead")
    n, places = spark.read.schema("id string, n int").parquet(f"{s.path}/dead").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n:
        terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("texts")).write.parquet(f"{s.path}/minus")
    return replace(s, dead_texts=n, dead_terms=places)


def build(rows: DataFrame, path: str, text: str = "content") -> Index:
    """The index of rows (id, text) in a folder that driver and executors share. Texts without terms count in the statistics."""
    return Index(rows.sparkSession, path).changed(rows.select("id", F.coalesce(text, F.lit("")).alias("text")))


@dataclass(frozen=True)
class Ranking:
    """A query's phrases over an index, with the weight of each phrase."""

    index: Index
    phrases: list[list[str]]
    weights: list[float]

    @classmethod
    def of(cls, index: Index, query: str) -> Ranking:
        phrases = tx.phrases_of(query)
        single = sorted({p[0] for p in phrases if len(p) == 1})
        found = index.frequencies(single) if single else {}
        long = [p for p in phrases if len(p) > 1]
        if long:  # how many texts hold a phrase of several terms is known from their places alone
            rows = counted(index.postings(sorted({t for p in long for t in p})), long)
            counts = rows.agg(*[F.count_if(F.col(f"_f{i}") > 0) for i in range(len(long))]).first()
            found |= {" ".join(p): n for p, n in zip(long, counts, strict=True)}
        idf = lambda n: math.log((index.every - n + 0.5) / (n + 0.5))
        weights = [w if (w := idf(found.get(" ".join(p), 0))) > 0 else LEAST_IDF for p in phrases]
        return cls(index, phrases, weights)

    @property
    def terms(self) -> list[str]:
        return sorted({t for p in self.phrases for t in p})

    def value(self, i: int, count: Column, n: Column) -> Column:
        """What phrase i gives a text of n terms that holds it so many times."""
        norm = K1 * (1 - B + B * n / self.index.mean) if self.index.mean else F.lit(K1)
        return F.when(count > 0, F.lit(self.weights[i]) * count * (K1 + 1) / (count + norm)).otherwise(0.0)

    def scored(self, blocks: list[tuple[int, int]] | None = None) -> DataFrame:
        """id, score (greater is better) of the texts that hold a phrase, in all blocks or in some (segment, block)."""
        rows = self.index.postings(self.terms)
        if blocks is not None:
            if len(blocks) <= PUSHED_BLOCKS:  # files are sorted by term and block
                rows = rows.where(F.col("block").isin(sorted({b for _, b in blocks})))
            rows = rows.join(F.broadcast(self.index.spark.createDataFrame(blocks, "segment int, block long")), ["segment", "block"], "left_semi")
        hits = counted(rows, self.phrases)
        score = sum((self.value(i, F.col(f"_f{i}"), F.col("n")) for i in range(len(self.phrases))), F.lit(0.0))
        return hits.where(" OR ".join(f"_f{i} > 0" for i in range(len(self.phrases)))).select("id", score.alias("score"))

    def bounds(self) -> DataFrame:
        """segment, block, most: what each block can give at most."""
        rows = self.index.of_terms("bounds", BOUNDS, self.terms)
        wide = rows.groupBy("segment", "block").agg(*[c for i, t in enumerate(self.terms) for c in (F.max(F.when(F.col("term") == t, F.col("most"))).alias(f"_m{i}"), F.max(F.when(F.col("term") == t, F.col("least"))).alias(f"_l{i}"))])
        total = F.lit(0.0)
        for i, p in enumerate(self.phrases):
            at = [self.terms.index(t) for t in dict.fromkeys(p)]
            # least() and greatest() pass over nulls, but a phrase needs all of its terms.
            every = reduce(Column.__and__, [F.col(f"_m{k}").isNotNull() for k in at])
            count, n = (F.col(f"_{c}{at[0]}") if len(at) == 1 else f(*[F.col(f"_{c}{k}") for k in at]) for c, f in (("m", F.least), ("l", F.greatest)))
            total = total + F.when(every, self.value(i, count, n)).otherwise(0.0)
        return wide.select("segment", "block", total.alias("most"))

    def best(self, k: int, alive: DataFrame | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
        """id, score of texts among which are the k best (all that tie with the last too), and the blocks (segment, block) that were worth reading.

        alive: the ids that count. The first blocks' k-th score is what a block must be able to reach.
        """
        bounds = self.bounds()
        order = bounds.where("most > 0").orderBy(F.desc("most"), "segment", "block")
        first = [(r["segment"], r["block"]) for r in order.limit(FIRST_BLOCKS).collect()]
        among = lambda rows: rows if alive is None else rows.join(alive.select("id").hint("merge"), "id", "left_semi")
        top = among(self.scored(first)).select(F.round("score", 10).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.count("*"), F.min("s")).first()
        floor = top[1] if top[0] == k else 0.0
        # Two numbers for some thousand texts each, and only of blocks that can still matter.
        rest = [tuple(r) for r in bounds.where((F.col("most") > 0) & (F.col("most") >= floor - 1e-9)).select("segment", "block").collect()]
        return among(self.scored(rest)).where(F.col("score") >= floor - 1e-9), rest


def moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def counted(rows: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """id, n, and how often each phrase occurs (_f0, ...), from postings of their terms."""
    terms = sorted({t for p in phrases for t in p})
    number = {t: i for i, t in enumerate(terms)}
    joint = {t for p in phrases if len(p) > 1 for t in p}
    of = lambda t, c: F.max(F.when(F.col("term") == t, c))
    wide = rows.groupBy("id", "n").agg(*[of(t, F.col("at") if t in joint else F.size("at")).alias(f"_t{number[t]}") for t in terms])

    def count(p: list[str]) -> Column:
        if len(p) == 1:
            c = F.col(f"_t{number[p[0]]}")
            return F.coalesce(F.size(c) if p[0] in joint else c, F.lit(0))
        # A phrase begins at s where each of its terms k stands at s + k.
        return F.coalesce(F.size(reduce(F.array_intersect, [moved(F.col(f"_t{number[t]}"), k) for k, t in enumerate(p)])), F.lit(0))

    return wide.select("id", "n", *[count(p).alias(f"_f{i}") for i, p in enumerate(phrases)])


def scored(index: Index, query: str) -> DataFrame:
    """id, score (greater is better) of all texts that hold a phrase of the query."""
    if not tx.phrases_of(query):
        return index.spark.createDataFrame([], "id string, score double")
    return Ranking.of(index, query).scored()


def best(index: Index, query: str, k: int, alive: DataFrame | None = None) -> DataFrame:
    """id, score of texts among which are the k best of those that are alive (id); few blocks are read."""
    if not tx.phrases_of(query):
        return index.spark.createDataFrame([], "id string, score double")
    return Ranking.of(index, query).best(k, alive)[0]


def matching(index: Index, query: str) -> DataFrame:
    """id of all texts that hold a phrase of the query."""
    phrases = tx.phrases_of(query)
    if not phrases:
        return index.spark.createDataFrame([], "id string")
    rows = counted(index.postings(sorted({t for p in phrases for t in p})), phrases)
    return rows.where(" OR ".join(f"_f{i} > 0" for i in range(len(phrases)))).select("id")
