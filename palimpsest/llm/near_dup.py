"""MinHash near-duplicates with SetSketch registers.

A document's registers are its minima of exponential variables, truncated to an exponential scale, one
byte each. Equal sets are collapsed to one class first, named by the digest of the set. Bands of registers
bring classes together; each is first compared with one lead of its bucket. Pairs that the registers' joint
likelihood doesn't rule out are verified on the full sets. In buckets that then still hold several
components, tiles of registers tell which members of different components may be linked at all. Those that
may make families, and a family's full sets are compared with each other once, however many buckets they
share; only families beyond FAMILY_ROWS are compared bucket by bucket. Links become components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, text_of, written
from palimpsest.llm.components import components

BASE = 1.1
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Register values start this far below that of a minimum of 1, and end at 255: sets of up to 1e9 fit.
OFFSET = 32
#: Pairs stay unless the threshold's log-likelihood is this far below the greatest (about 5 deviations).
LOG_RATIO = 12.0
#: Classes, and bytes of what is compared, that one side of a tile holds, about.
TILE_ROWS, TILE_BYTES = 1024, 16_000_000
#: Classes of a family that is compared as a whole; larger ones are compared by bucket.
FAMILY_ROWS = 4096
#: Pairs of classes that one task compares, about.
TASK_PAIRS = 8_000_000
KEPT_WORDS = 400_000

_mix = np.random.Generator(np.random.PCG64(20_240_101))
MULTIPLIERS = (_mix.integers(0, 2**31, REGISTERS, dtype=np.uint32) << 1) | 1
SHIFTS = _mix.integers(0, 2**32, REGISTERS, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The text's distinct shingles of ``width`` words as sorted 64-bit hashes; fewer words make one shingle."""
    words = text.lower().split()  # bytes: A-Z alone change, and blanks are x20 and x09-x0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, dtype=np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """The REGISTERS bytes of a non-empty set of 64-bit hashes."""
    h = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 256):
        part = h[at : at + 256, None] * MULTIPLIERS[None, :]
        part += SHIFTS
        np.minimum(low, part.min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)  # the least of exponential variables
    return np.clip(np.floor(-np.log(x) / math.log(BASE)) + OFFSET, 0, 255).astype(np.uint8)


def merged_sketch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union: the greater registers."""
    return np.maximum(a, b)


_GRID = np.linspace(0.005, 0.999, 200)
#: Coarser, for pairs that are alike: its greatest likelihood is a little less, so it rules out less.
_NEAR = np.linspace(0.4, 0.999, 31)


def grown(x: np.ndarray) -> np.ndarray:
    """The probability that a register is greater, for the share x of the union that lies in one set alone."""
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, grid: np.ndarray = _GRID) -> np.ndarray:
    """Whether a similarity of ``least`` or more isn't ruled out, for rows of registers and set sizes.

    Joint likelihood of the numbers of greater, smaller and equal registers, given both sizes.
    """
    sizes_allow = np.minimum(na, nb) >= least * np.maximum(na, nb) * (1 - 1e-9)
    out = np.zeros(len(a), dtype=bool)
    todo = np.flatnonzero(sizes_allow)
    for at in range(0, len(todo), 4096):
        i = todo[at : at + 4096]
        more, less = (a[i] > b[i]).sum(1), (a[i] < b[i]).sum(1)
        same = REGISTERS - more - less
        u = na[i] / (na[i] + nb[i])
        top = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
        j = np.minimum(np.append(grid, least)[None, :], top[:, None])
        pm, pl = grown(u[:, None] - (1 - u[:, None]) * j), grown((1 - u[:, None]) - u[:, None] * j)
        like = more[:, None] * np.log(pm) + less[:, None] * np.log(pl) + same[:, None] * np.log(np.clip(1 - pm - pl, 1e-12, 1))
        out[i] = np.max(np.where(j >= least - 0.005, like, -np.inf), axis=1) >= like.max(axis=1) - LOG_RATIO
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def as_rows(registers: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(registers), dtype=np.uint8).reshape(-1, REGISTERS)


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def plain(docs: DataFrame) -> DataFrame:
    """id, text (null as empty, in UTF-8) of every row."""
    return docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).cast("binary").alias("text"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """id (doc_id), n_shingles, set_key, registers, bands of every row; the last three are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            sets = [shingle_set(t, width, hashes) for t in b.column(1).to_pylist()]
            regs = [sketch(s) if len(s) else None for s in sets]
            bands = [None if r is None else [xxhash.xxh64_intdigest(r[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - 2**63 for k in range(BANDS)] for r in regs]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if r is None else r.tobytes() for r in regs], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "set_key", "registers", "bands"],
            )

    return written(plain(docs).mapInArrow(run, "id long, n_shingles long, set_key binary, registers binary, bands array<long>"))


def full_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """key, items (the sorted set as bytes) of the classes (key, rep), each made from a row whose doc_id is rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            sets = [shingle_set(t, width, hashes) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "items"])

    rows = plain(docs).join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    # A doc_id may have several rows: of equal sets one stays, and sets that nobody asked for meet no key later.
    return written(rows.mapInArrow(run, "key binary, items binary").dropDuplicates(["key"]))


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those pairs that the joint likelihood of their registers doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            ra, rb = as_rows(b.column(2).to_pylist()), as_rows(b.column(4).to_pylist())
            keep = plausible(ra, rb, b.column(3).to_numpy().astype(float), b.column(5).to_numpy().astype(float), percent / 100)
            yield b.filter(pa.array(keep)).select([0, 1])

    side = lambda c: reps.select(F.col("key").alias(c), F.col("registers").alias(f"{c}_r"), F.col("n_shingles").alias(f"{c}_n"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_r", "a_n", "b_r", "b_n")
    return rows.mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that are linked on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield b.filter(pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)], pa.bool_())).select([0, 1])

    side = lambda c: sets.select(F.col("key").alias(c), F.col("items").alias(f"{c}_items"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_items", "b_items")
    return rows.mapInArrow(run, "a binary, b binary")


def dealt(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """Tiles (bucket, i, j, side, key, component, n_shingles, payload) of rows (bucket, key, component, n_shingles).

    A bucket is dealt to blocks of TILE_ROWS rows and TILE_BYTES bytes, about, and each pair of blocks i <= j is
    one tile, whose side 0 is block i and whose side 1 is block j (nothing where i = j). payload (key, payload)
    meets each key once, before rows are repeated for buckets and tiles.
    """
    size = F.greatest(F.count("*") / TILE_ROWS, F.sum("n_shingles") * 8 / TILE_BYTES)
    weigh = written(rows.groupBy("bucket").agg(F.ceil(size).cast("int").alias("blocks"), F.count("*").alias("n")))
    work = weigh.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    # At most one entry for each band of a class.
    by_key = rows.join(weigh.select("bucket", "blocks"), "bucket").groupBy("key", "component", "n_shingles").agg(F.collect_list(F.struct("bucket", "blocks")).alias("b"))
    each = by_key.join(payload, "key").select("key", "component", "n_shingles", "payload", F.inline("b"))
    each = each.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    left = F.transform(F.sequence("block", F.col("blocks") - 1), lambda j: place(F.col("block"), j, 0))
    right = F.when(F.col("block") > 0, F.transform(F.sequence(F.lit(0), F.col("block") - 1), lambda i: place(i, F.col("block"), 1))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    each = each.select("bucket", F.inline(F.concat(left, right)), "key", "component", "n_shingles", "payload")
    each = each.repartition(max(4, int(work // TASK_PAIRS) + 1), "bucket", "i", "j")
    return each.sortWithinPartitions("bucket", "i", "j", "side")


def tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of sorted rows, each as one table."""
    held: list[pa.RecordBatch] = []
    mark = None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = tuple(at[:, lo])
            if held and now != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def forest(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Places (row, column) of adjacent that join the groups of rows (``left``) and columns (``right``), no two of them the same groups' path."""
    n = int(max(left.max(), right.max())) + 1
    seen = np.zeros(n, dtype=bool)
    of = lambda codes: np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes, minlength=n))[:-1])
    rows_of, cols_of = of(left), of(right)
    out: list[tuple[int, int]] = []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            g = todo.pop()
            rows, cols = rows_of[g], cols_of[g]
            if len(rows):
                new = np.flatnonzero(adjacent[rows].any(axis=0) & ~seen[right])
                groups, first = np.unique(right[new], return_index=True)
                out += [(int(rows[adjacent[rows, c].argmax()]), int(c)) for c in new[first]]
                seen[groups] = True
                todo += groups.tolist()
            if len(cols):
                new = np.flatnonzero(adjacent[:, cols].any(axis=1) & ~seen[left])
                groups, first = np.unique(left[new], return_index=True)
                out += [(int(r), int(cols[adjacent[r, cols].argmax()])) for r in new[first]]
                seen[groups] = True
                todo += groups.tolist()
    return out


def maybe_linked(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, ca: np.ndarray, cb: np.ndarray, least: float) -> np.ndarray:
    """For rows and columns of different components: whether their registers leave ``least`` possible.

    Pairs of so few equal registers that eight deviations lie between are dropped before the likelihood.
    """
    u = np.linspace(least / (1 + least), 0.5, 9)
    p = float(np.min(1 - grown(u - (1 - u) * least) - grown((1 - u) - u * least)))
    fewest = REGISTERS * p - 8 * math.sqrt(REGISTERS * p * (1 - p))
    out = np.zeros((len(ra), len(rb)), dtype=bool)
    ta, tb = np.ascontiguousarray(ra.T), np.ascontiguousarray(rb.T)
    for at in range(0, len(ra), 128):
        same = np.zeros((min(128, len(ra) - at), len(rb)), dtype=np.uint8)  # REGISTERS fit
        for x, y in zip(ta[:, at : at + 128], tb, strict=True):
            same += x[:, None] == y[None, :]
        i, j = np.nonzero((same >= fewest) & (ca[at : at + 128, None] != cb[None, :]))
        i += at
        for lo in range(0, len(i), 1 << 16):
            x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            out[x, y] = plausible(ra[x], rb[y], na[x], nb[y], least, _NEAR)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of items that each set on the left shares with each on the right."""
    both = np.zeros(len(left) * len(right), dtype=np.int64)
    known = np.unique(np.concatenate(right))

    def placed(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places in ``known`` of the sets' items that are there."""
        row, item = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, item), len(known) - 1)
        there = known[at] == item
        return row[there], at[there]

    ra, pa_ = placed(left, known)
    used, pa_ = np.unique(pa_, return_inverse=True)
    if not len(used):
        return both.reshape(len(left), len(right))
    rb, pb = placed(right, known[used])
    fa, fb = np.bincount(pa_, minlength=len(used)), np.bincount(pb, minlength=len(used))
    common = fa * fb > max(16, len(left) * len(right) // 100)
    # Items of many sets: products of 0-1 matrices, some thousand items at a time (sums stay whole numbers).
    dense = np.flatnonzero(common)
    for at in range(0, len(dense), 4096):
        part = dense[at : at + 4096]
        code = np.full(len(used), -1)
        code[part] = np.arange(len(part))
        x, y = np.zeros((len(left), len(part)), dtype=np.float32), np.zeros((len(right), len(part)), dtype=np.float32)
        for m, r, c in ((x, ra, code[pa_]), (y, rb, code[pb])):
            m[r[c >= 0], c[c >= 0]] = 1
        both += (x @ y.T).astype(np.int64).ravel()
    # Items of few sets: their pairs one by one, counted by place.
    order = np.argsort(pb, kind="stable")
    rb, first = rb[order], np.concatenate([[0], np.cumsum(fb)[:-1]])
    rare = ~common[pa_]
    ra, pa_ = ra[rare], pa_[rare]
    upto = np.cumsum(fb[pa_])
    lo = 0
    while lo < len(pa_):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 21), side="right")))
        times = fb[pa_[lo:hi]]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(ra[lo:hi] * len(right), times) + rb[np.repeat(first[pa_[lo:hi]], times) + nth]
        both += np.bincount(at, minlength=len(both))
        lo = hi
    return both.reshape(len(left), len(right))


def in_tile(tile: pa.Table, percent: int, full: bool) -> list[tuple[bytes, bytes]]:
    """Of a tile of full sets: links that join its components. Of a tile of registers: pairs that tie all which may be linked."""
    side = tile.column("side").to_numpy() == 1
    keys, n = tile.column("key").to_pylist(), tile.column("n_shingles").to_numpy()
    _, component = np.unique(np.array(tile.column("component").to_pylist(), dtype=object), return_inverse=True)
    a = np.flatnonzero(~side)
    b = np.flatnonzero(side) if side.any() else a
    if tile.column("j")[0].as_py() != tile.column("i")[0].as_py() and (not side.any() or side.all()):
        return []  # one of the blocks is empty
    values = tile.column("payload").to_pylist()
    if full:
        sets = [np.frombuffer(v, np.uint64) for v in values]
        both = overlaps([sets[i] for i in a], [sets[i] for i in b])
        hits = (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)) & (component[a][:, None] != component[b][None, :])
        found = forest(hits, component[a], component[b])
    else:
        r = as_rows(values)
        hits = maybe_linked(r[a], r[b], n[a].astype(float), n[b].astype(float), component[a], component[b], percent / 100)
        found = forest(hits, a, b)  # every class stands for itself
    return [(keys[a[i]], keys[b[j]]) for i, j in found]


def in_tiles(rows: DataFrame, payload: DataFrame, percent: int, full: bool) -> DataFrame:
    """Pairs a, b that ``in_tile`` finds in the tiles of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tile_runs(batches):
            if tile.num_rows > 1:
                found = in_tile(tile, percent, full)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return written(dealt(rows, payload).mapInArrow(run, "a binary, b binary"))


def class_links(docs: DataFrame, made: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ties the classes of linked sets together, and the classes (key, rep, n_shingles).

    The first links are given as labels (id, component) of the classes that they tie, the others as links a, b.
    """
    real = made.where("id IS NOT NULL AND set_key IS NOT NULL").withColumnRenamed("set_key", "key")
    first = real.groupBy("key").agg(F.min("id").alias("rep"))
    reps = real.join(first.withColumnRenamed("rep", "id"), ["key", "id"], "left_semi").dropDuplicates(["key"])
    reps = written(reps.select("key", F.col("id").alias("rep"), "n_shingles", "registers", "bands"))
    in_band = reps.select("key", "rep", "n_shingles", F.explode("bands").alias("band"))
    lead = in_band.groupBy("band").agg(F.min(F.struct("rep", "key")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = written(in_band.join(lead, "band").select("band", "key", "n_shingles", F.col("lead.key").alias("lead"), "n"))
    pairs = members.where("lead != key").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    pairs = written(likely(pairs, reps, percent))
    sets_of = lambda keys: full_sets(docs, reps.select("key", "rep").join(keys, "key", "left_semi"), width)
    wanted = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    links = written(verified(pairs, sets_of(wanted), percent))
    # Leads have met all members of their buckets; others have met nobody but them.
    tied = components(links)
    rows = members.where("n > 2 AND key != lead").join(tied.withColumnRenamed("id", "key"), "key", "left")
    rows = rows.select(F.col("band").alias("bucket"), "key", F.coalesce("component", "key").alias("component"), "n_shingles")
    still = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    rows = written(rows.join(still, "bucket", "left_semi"))
    near = in_tiles(rows, reps.select("key", F.col("registers").alias("payload")), percent, full=False)
    family = components(near).withColumnsRenamed({"id": "key", "component": "family"})
    sized = family.groupBy("family").agg((F.count("*") <= FAMILY_ROWS).alias("whole"))
    met = rows.join(family.join(sized, "family"), "key")
    met = met.select(F.when(F.col("whole"), F.xxhash64("family")).otherwise(F.col("bucket")).alias("bucket"), "key", "component", "n_shingles").distinct()
    met = written(met)
    sets = sets_of(met.select("key").distinct()).withColumnRenamed("items", "payload")
    return tied, in_tiles(met, sets, percent, full=True), reps.select("key", "rep", "n_shingles")


def labelled(classes: DataFrame, tied: DataFrame, links: DataFrame) -> DataFrame:
    """key, component: the smallest rep among the classes that labels and links tie to each class.

    Only links between different labels are left to follow, and what they tie takes the label that they lead to.
    """
    side = lambda c: tied.select(F.col("id").alias(c), F.col("component").alias(f"{c}_label"))
    rest = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    further = components(rest).select(F.col("id").alias("component"), F.col("component").alias("further"))
    moved = tied.join(further, "component", "left").select(F.col("id").alias("key"), F.coalesce("further", "component").alias("group"))
    # Classes that no label held before name themselves in the links.
    alone = further.join(tied.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("key"), F.col("further").alias("group"))
    tied = written(moved.unionAll(alone))
    low = tied.join(classes.select("key", "rep"), "key").groupBy("group").agg(F.min("rep").alias("component"))
    found = tied.join(low, "group").select("key", "component")
    return classes.join(found, "key", "left").select("key", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, others left out).

    A document's set holds its distinct ``width``-word shingles after lower-casing A-Z. Documents are
    linked when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    Null and blank texts have no shingles and are linked with nothing. Rows with the same doc_id count as
    one document, which each of its texts links. A null doc_id is kept, alone, with a null component.
    An empty table gives no rows. Candidates share one of BANDS bands: a pair at the threshold is missed
    with a probability of about 3e-6; all else is exact.
    """
    made = sketches(docs, width)
    tied, links, classes = class_links(docs, made, width, percent)
    real = made.where("id IS NOT NULL AND set_key IS NOT NULL").select("id", F.col("set_key").alias("key"))
    # Several texts of one doc_id tie their classes together.
    low = real.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("id", "a")
    links = links.unionAll(real.join(low, "id").where("key != a").select("a", F.col("key").alias("b")))
    label = labelled(classes, tied, links).withColumnRenamed("key", "set_key")
    rows = made.select(F.col("id").alias("doc_id"), "n_shingles", "set_key")
    has = F.col("doc_id").isNotNull() & F.col("set_key").isNotNull()
    full = rows.where(has).join(label, "set_key", "left").select("doc_id", "n_shingles", "component")
    # A blank row goes with the other rows of its doc_id.
    blank = rows.where(~has).drop("set_key").join(full.select("doc_id", "component").dropDuplicates(["doc_id"]), "doc_id", "left")
    out = full.unionByName(blank).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when of each group of near-duplicate texts one stays: a row of smallest doc_id.

    Texts are judged one by one, also where rows share a doc_id: a copy goes, another text of that id stays.
    Rows that repeat doc_id and text are one. Rows with a null doc_id, and blank texts, all stay.
    """
    made = sketches(docs, width)
    tied, links, classes = class_links(docs, made, width, percent)
    label = labelled(classes, tied, links).join(classes, "key")
    best = label.groupBy("component").agg(F.min(F.struct("rep", "key")).alias("best"))
    rows = made.where("id IS NOT NULL AND set_key IS NOT NULL").select("id", F.col("set_key").alias("key"))
    judged = rows.join(best.select(F.col("best.rep").alias("id"), F.col("best.key").alias("key"), F.lit(True).alias("stays")), ["id", "key"], "left")
    by_id = written(judged.groupBy("id").agg(F.count_if("stays").alias("stay"), F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")))
    gone = by_id.where("stay = 0 AND a = b").select(F.col("id").alias("doc_id"))
    once = by_id.where("n > 1 AND (stay > 0 OR a < b)").select(F.col("id").alias("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti")
    if once.isEmpty():
        return left
    # Few rows share a doc_id and stay; their sets are made again, to tell the texts apart.
    again = left.join(once, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    key = "_set_key"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            sets = [shingle_set((t or "").encode(), width, hashes) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())], names=[*b.schema.names, key])

    at = again.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in again.schema.fields)
    again = again.mapInArrow(run, f"{kinds}, {key} binary")
    wins = best.select(F.col("best.rep").alias("doc_id"), F.col("best.key").alias(key))
    blank = again.where(F.col(key).isNull())
    again = again.join(wins, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).unionByName(blank)
    return left.join(once, "doc_id", "left_anti").unionByName(again.select(*left.columns)).select(*docs.columns)
