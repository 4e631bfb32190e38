"""Shortest-pack-first packing over the length histogram.

Documents are cut into full sequences and one tail each. Only the tails' length histogram (at most one
count for each length) reaches the driver. Lengths are placed longest first, each into the packs with
the most room, and the counts of packs of equal fill stand for the packs. What room then remains is
filled with the tails of the emptiest packs, cut where needed. The plan is a short table of rank ranges,
joined back to the documents by their rank among tails of equal length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.bpe import Bpe, byte_symbols, tokenizer
from palimpsest.llm.common import slices, text_of, written

#: A range of tails (length, first rank, count, start and tokens of the part placed, place on the line of tails) and
#: a range of holes (place on the line of holes, tokens, count, first pack, offset in the pack) that it runs into.
PLAN = "tail int, rank_lo long, n long, seg_start int, seg_len int, a0 long, hole0 long, room int, holes long, pack_lo long, fill int"
#: Holes of fewer tokens are left as padding.
LEAST_HOLE = 4
#: Documents of one length that one task ranks, about.
RANK_ROWS = 200_000


def shortest_pack_first(hist: dict[int, int], size: int) -> tuple[list[tuple], int]:
    """PLAN rows for ``hist`` (count of each length, all under ``size``), and the number of packs.

    Every tail lies in the rows once, whole or in consecutive segments; no pack exceeds ``size`` tokens.
    All packs but the last few are full.
    """
    packs = 0
    by_fill: dict[int, list[tuple[int, int]]] = defaultdict(list)  # fill: ranges (first pack, count)
    held: list[list] = []
    for length in sorted((x for x in hist if x > 0), reverse=True):
        rank, left = 0, hist[length]
        while left:
            fill = min((f for f, r in by_fill.items() if r), default=size)
            if fill + length > size:
                held.append([length, rank, left, 0, length, packs, 0])
                by_fill[length].append((packs, left))
                packs, left = packs + left, 0
                break
            first, n = by_fill[fill].pop()
            take = min(n, left)
            if take < n:
                by_fill[fill].append((first + take, n - take))
            held.append([length, rank, take, 0, length, first, fill])
            by_fill[fill + length].append((first, take))
            rank, left = rank + take, left - take
    rows = [(length, rank, n, start, seg, 0, 0, seg, n, first, fill) for length, rank, n, start, seg, first, fill in held]
    return fill_up(rows, {f: r for f, r in by_fill.items() if r}, size, packs)


def fill_up(held: list[tuple], by_fill: dict[int, list[tuple[int, int]]], size: int, packs: int) -> tuple[list[tuple], int]:
    """Take the emptiest packs apart and fill the room of the others with their tails, cut where needed.

    The loose tails lie end to end on one line and the holes on another, so that a tail's segments follow
    by arithmetic from its place on the line, and the plan stays as short as the list of ranges.
    """
    room = sum((size - f) * n for f, r in by_fill.items() for _, n in r if size - f >= LEAST_HOLE)
    gone, freed = [], 0
    for fill in sorted(by_fill):  # the emptiest give their tokens while the others have room for them
        for i, (first, n) in enumerate(by_fill[fill]):
            if k := min(n, (room - freed) // size) if size - fill >= LEAST_HOLE else 0:
                gone.append((first, k))
                by_fill[fill][i] = (first + k, n - k)
                freed += k * size
    gone.sort()
    stay, loose = [], []
    for row in held:
        for first, n, out in split_by(row[9], row[2], gone):
            (loose if out else stay).append((row[0], row[1] + first - row[9], n, row[3], row[4], 0, 0, row[4], n, first, row[10]))
    holes, at = [], 0
    for fill, ranges in sorted(by_fill.items()):
        for first, n in ranges:
            if n and size - fill >= LEAST_HOLE:
                holes.append((at, size - fill, n, first, fill))
                at += (size - fill) * n
    at, h = 0, 0
    for row in loose:
        end = at + row[2] * row[4]
        while holes[h][0] + holes[h][1] * holes[h][2] <= at:
            h += 1
        i = h
        while i < len(holes) and holes[i][0] < end:
            stay.append((*row[:5], at, *holes[i]))
            i += 1
        at = end
    return stay, packs


def split_by(first: int, n: int, gone: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """The range first .. first+n cut at the ranges of ``gone``: (start, count, lies in one)."""
    out, at, end = [], first, first + n
    for lo, k in gone:
        if lo + k <= at or lo >= end:
            continue
        if lo > at:
            out.append((at, lo - at, False))
        a, b = max(lo, at), min(lo + k, end)
        out.append((a, b - a, True))
        at = b
    return [*out, (at, end - at, False)] if at < end else out


@lru_cache(maxsize=4)
def quick_tokenizer(path: str) -> tuple[tiktoken.Encoding, int]:
    """The same vocabulary for tiktoken, whose ranks are the ids; and the id of the first special token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    vocab = {t: i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
    ids = [vocab[m] for m in merges]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError(f"{path}: ids don't follow the order of the merges")
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=Bpe.PATTERN, mergeable_ranks=ranks, special_tokens=special), ids[-1]


def ids_of(text: str, path: str) -> bytes:
    """A whole text's ids, as little-endian unsigned 32-bit integers.

    tiktoken's pattern gives up on some texts, such as a million blanks; those go the exact encoder's way.
    """
    coder, _ = quick_tokenizer(path)
    try:
        return coder.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
    except ValueError:
        return tokenizer(path).encode([text])[0]


def tokenised(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, tail (tokens in the last, not full piece), crcs (of the full pieces), tail_ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint32(end_id).tobytes()
        step = 4 * size
        for b in slices(batches):
            ids = [ids_of(t, path) + end for t in b.column(1).to_pylist()]
            cut = [len(x) // step * step for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([(len(x) - c) // 4 for x, c in zip(ids, cut, strict=True)], pa.int32()),
                    pa.array([[zlib.crc32(x[a : a + step]) for a in range(0, c, step)] for x, c in zip(ids, cut, strict=True)], pa.list_(pa.int64())),
                    pa.array([x[c:] for x, c in zip(ids, cut, strict=True)], pa.binary()),
                ],
                names=["doc_id", "doc_tokens", "tail", "crcs", "tail_ids"],
            )

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"doc_id {kind}, doc_tokens long, tail int, crcs array<long>, tail_ids binary"))


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text and any other columns, which are left out. A null text counts as empty and gives
    the end id alone. Repeated rows and null ids are packed like others, each row by itself; a text of
    any length is cut into full sequences and a tail. An empty table gives no rows. ``size`` is the tokens
    of a full sequence, ``path`` a byte-level BPE JSON file on every worker.
    """
    spark = docs.sparkSession
    done = tokenised(docs, path, size, end_id)
    buckets = max(16, done.count() // RANK_ROWS)
    done = done.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(buckets)).cast("int"))
    counts = done.groupBy("tail", "bucket").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("full"))
    # At most size x buckets rows, from which come each bucket's first rank and first full sequence.
    before = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_tail = counts.withColumn("rank0", before("n", "tail")).withColumn("full0", before("full", "tail"))
    totals = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()  # at most one row per length
    plan, packs = shortest_pack_first({r["tail"]: r["n"] for r in totals}, size)
    base, full_rows = packs, []
    for r in sorted(totals):
        full_rows.append((r["tail"], base))
        base += r["full"]
    full_base = spark.createDataFrame(full_rows, "tail int, base long")
    starts = per_tail.join(F.broadcast(full_base), "tail").select("tail", "bucket", "rank0", (F.col("base") + F.col("full0")).alias("seq0"))
    order = W.partitionBy("tail", "bucket").orderBy("doc_id", "doc_tokens", F.crc32("tail_ids"))
    ranked = done.withColumn("i", F.row_number().over(order) - 1).withColumn("f", F.sum(F.size("crcs")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.size("crcs"))
    ranked = ranked.join(starts, ["tail", "bucket"]).withColumn("rank", F.col("rank0") + F.col("i")).withColumn("seq0", F.col("seq0") + F.col("f"))
    # The plan has a bounded number of rows: it grows with the sequence size, not with the documents.
    slots = spark.createDataFrame(plan, PLAN).groupBy(F.col("tail").alias("t")).agg(F.collect_list(F.struct(*[c.split()[0] for c in PLAN.split(", ")[1:]])).alias("slots"))
    ranked = ranked.join(F.broadcast(slots), ranked["tail"] == slots["t"], "left")
    whole = F.transform("crcs", lambda c, i: F.struct((i * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), c.alias("ids_crc32"), (F.col("seq0") + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    mine = F.filter(F.coalesce("slots", F.array()), lambda s: (F.col("rank") >= s["rank_lo"]) & (F.col("rank") < s["rank_lo"] + s["n"]))
    def cut(s: Column) -> Column:
        a = s["a0"] + (F.col("rank") - s["rank_lo"]) * s["seg_len"]
        first = F.greatest(F.lit(0), F.floor((a - s["hole0"]) / s["room"]))
        last = F.least(s["holes"] - 1, F.floor((a + s["seg_len"] - 1 - s["hole0"]) / s["room"]))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda j: segment(s, a, j)))

    def segment(s: Column, a: Column, j: Column) -> Column:
        hole = s["hole0"] + j * s["room"]
        lo, hi = F.greatest(a, hole), F.least(a + s["seg_len"], hole + s["room"])
        at = (s["seg_start"] + lo - a).cast("int")
        return F.struct(
            (F.col("doc_tokens") - F.col("tail") + at).alias("start"),
            (hi - lo).alias("length"),
            F.crc32(F.substring(F.col("tail_ids"), at * 4 + 1, (hi - lo).cast("int") * 4)).alias("ids_crc32"),
            (s["pack_lo"] + j).alias("sequence_id"),
            (s["fill"] + lo - hole).alias("offset"),
        )

    ends = F.flatten(F.filter(F.transform(mine, cut), lambda x: x.isNotNull()))
    return ranked.select("doc_id", "doc_tokens", F.inline(F.concat(whole, ends))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
