"""Exact line dedup by a sharded minimal perfect hash.

A pass over the documents gives the 128-bit hashes of their lines' keys. Hashes that several documents hold
are dealt to shards by their own bits. Each shard's hashes are given places 0, 1, 2, ... without gaps by a
cascade of bit arrays; a place leads to a fingerprint, a count and the document that keeps the lines. The
hashes of documents visit the arrays of their shard, in as many copies of a shard as its visits ask for.
What they find there returns to the documents: no line meets another line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import runs, slices, text_of, written

#: Code points of the shortest key that counts.
SHORTEST = 10
#: Hashes of a shard, and visits of one copy of it, about.
SHARD_KEYS, COPY_VISITS = 1 << 12, 1 << 14
#: Shards whose numbers of copies are broadcast (16 bytes each); beyond it they are joined.
BROADCAST_SHARDS = 1 << 20
#: Bits of a level for each hash that is still without a place, and levels; what is left then is listed.
GAMMA, LEVELS = 2, 24
CONTINUED = bytes(range(0x80, 0xC0))
SHORT = bytes(16)


def key_digests(text: bytes, shortest: int = SHORTEST) -> list[bytes]:
    """The 128-bit hash of each line's key; SHORT for keys of under ``shortest`` code points.

    A key is the line without blanks (x20, x09-x0D) at its ends, A-Z in lower case.
    """
    out = []
    for line in text.lower().split(b"\n"):
        key = line.strip()
        long = len(key) >= shortest and (len(key) >= 4 * shortest or len(key.translate(None, CONTINUED)) >= shortest)
        out.append(xxhash.xxh3_128_digest(key) if long else SHORT)
    return out


def mixed(h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the same 128 bits for each level."""
    x = (h ^ (g * np.uint64(2 * level + 3))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Places 0 .. n - 1 of n distinct 128-bit hashes: a hash's place is its rank among the set bits of all levels.

    Each level is a bit array; a hash that is alone in its bit has its place there, others go to the next
    level. The few that no level tells apart are listed and come last.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before, self.starts = [], []
        n = 0
        for bits in levels:
            words = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
            self.before.append(n + np.concatenate([[0], np.cumsum(words)[:-1]]))
            n += int(words.sum())
        self.placed = n

    @classmethod
    def of(cls, h: np.ndarray, g: np.ndarray) -> PerfectHash:
        levels = []
        while len(h) and len(levels) < LEVELS:
            size = 64 * max(1, -(-GAMMA * len(h) // 64))
            at = mixed(h, g, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            stay = ~alone[at.astype(np.int64)]
            h, g = h[stay], g[stay]
        return cls(levels, np.stack([h, g], axis=1))

    def places(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Each hash's place. A hash that isn't among them gets any place, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        todo = np.arange(len(h))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            words = bits.view(np.uint64)
            at = mixed(h[todo], g[todo], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[there]] & ((np.uint64(1) << bit[there]) - np.uint64(1))
            out[todo[there]] = before[word[there]] + np.bitwise_count(below)
            todo = todo[~there]
        for n, (x, y) in enumerate(self.rest):
            out[todo[(h[todo] == x) & (g[todo] == y)]] = self.placed + n
        return out


SHARD = "levels array<binary>, rest binary, marks binary, counts binary, owners binary"


def packed(h: np.ndarray, g: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> tuple:
    """A shard's arrays: the levels, what they left, and by place a fingerprint, a count and an owner."""
    table = PerfectHash.of(h, g)
    by_place = np.argsort(table.places(h, g))
    counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
    return [x.tobytes() for x in table.levels], table.rest.tobytes(), g[by_place].tobytes(), counts[by_place].tobytes(), owners[by_place].tobytes()


def found(shard: dict, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the shard holds each hash, its count, and its owner."""
    table = PerfectHash([np.frombuffer(x, np.uint8) for x in shard["levels"]], np.frombuffer(shard["rest"], np.uint64).reshape(-1, 2))
    marks, counts, owners = np.frombuffer(shard["marks"], np.uint64), np.frombuffer(shard["counts"], np.uint32), np.frombuffer(shard["owners"], np.int64)
    at = table.places(h, g)
    return (at >= 0) & (marks[at] == g), counts[at], owners[at]


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty, in UTF-8), row: a hash of the text, which deals the rows of one doc_id.

    Rows that share doc_id and row only share what they find, which goes by doc_id and key alone.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    return rows.withColumn("row", F.xxhash64("text"))


def lines_of(rows: DataFrame, shortest: int) -> DataFrame:
    """doc_id, row, h, g: the distinct key hashes of each row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [set(key_digests(t, shortest)) - {SHORT} for t in b.column(1).to_pylist()]
            n = [len(s) for s in sets]
            both = np.frombuffer(b"".join(d for s in sets for d in s), np.int64).reshape(-1, 2)
            ids, marks = (np.repeat(b.column(k).to_numpy(), n) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, marks, both[:, 0].copy(), both[:, 1].copy())], names=["doc_id", "row", "h", "g"])

    return written(rows.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, row long, h long, g long"))


def shards_of(repeated: DataFrame) -> DataFrame:
    """shard and its arrays, from rows (shard, h, g, n, owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            h, g, n, owner = (t.column(k).to_numpy() for k in range(1, 5))
            arrays = packed(h.view(np.uint64), g.view(np.uint64), n, owner)
            kinds = [pa.list_(pa.binary()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()], pa.int64()), *[pa.array([a], kind) for a, kind in zip(arrays, kinds, strict=True)]], names=["shard", "levels", "rest", "marks", "counts", "owners"])

    rows = repeated.select("shard", "h", "g", "n", "owner").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, f"shard long, {SHARD}")


def losses(rows: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, row, gone: for each row of ``marked`` that loses lines, the hashes of their keys."""
    lines = lines_of(rows, shortest)
    repeated = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    repeated = written(repeated.select("h", "g", "n", "owner"))
    n_shards = max(1, -(-repeated.count() // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("h"), F.lit(n_shards)).alias("shard")
    shards = written(shards_of(repeated.select("*", shard)))
    visits = lines.select("*", shard)
    copies = written(visits.groupBy("shard").agg(F.ceil(F.count("*") / COPY_VISITS).cast("long").alias("copies")))
    few = F.broadcast(copies) if n_shards <= BROADCAST_SHARDS else copies
    visits = visits.join(few, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "row"), "copies"))
    held = shards.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    nothing = lambda kind: F.lit(None).cast(kind)
    left = held.select("shard", "copy", F.lit(0).alias("side"), *[nothing("long").alias(c) for c in ("doc_id", "row", "h", "g")], "levels", "rest", "marks", "counts", "owners")
    right = visits.select("shard", "copy", F.lit(1).alias("side"), "doc_id", "row", "h", "g", nothing("array<binary>").alias("levels"), *[nothing("binary").alias(c) for c in ("rest", "marks", "counts", "owners")])
    met = left.unionAll(right).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, None
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(k).to_numpy() for k in (0, 1)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = b.slice(lo, hi - lo)
                if at != (at := tuple(place[:, lo])):
                    arrays = None
                if part.column(2)[0].as_py() == 0:  # the arrays come before their visitors
                    arrays = {c: part.column(c)[0].as_py() for c in ("levels", "rest", "marks", "counts", "owners")}
                    part = part.slice(1)
                if arrays is None or not part.num_rows:
                    continue
                doc, row, h, g = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row", "h", "g"))
                there, n, owner = found(arrays, h.view(np.uint64), g.view(np.uint64))
                gone = there & (n > 1) & (owner != doc)
                yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (doc, row, h, g)], names=["doc_id", "row", "h", "g"])

    # A row's losses are no more than its own lines.
    lost = met.mapInArrow(run, "doc_id long, row long, h long, g long")
    return lost.groupBy("doc_id", "row").agg(F.collect_list(F.struct("h", "g")).alias("gone"))


def without_repeats(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text of the lines that stay) for every row of docs (doc_id, text, others left out).

    Lines are parted by \\n. A line's key is the line without blanks (x20, x09-x0D) at its ends, A-Z in lower
    case. Keys of at least ``shortest`` code points that two or more doc_ids hold lose all their lines except
    in the smallest of these doc_ids, where repeats stay too. Null and empty texts are one empty line. Rows that
    share a doc_id are one document in several rows, each returned; a row without a doc_id holds no key and
    stays whole. An empty table gives no rows. Keys are told apart by 128-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                if gone:
                    drop = {np.array([x["h"], x["g"]], dtype=np.int64).tobytes() for x in gone}
                    left = [line for line, key in zip(lines, key_digests(text, shortest), strict=True) if key not in drop]
                    text = b"\n".join(left)
                    n_dropped.append(len(lines) - len(left))
                else:
                    n_dropped.append(0)
                n_lines.append(len(lines))
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    rows = marked(docs)
    met = rows.join(losses(rows, shortest), ["doc_id", "row"], "left").select("doc_id", "text", "gone")
    return met.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary").withColumn("kept", F.col("kept").cast("string"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.doc_id, i, line, coalesce(o.owner <> k.doc_id, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""
