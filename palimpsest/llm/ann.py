"""Nearest neighbours by a block matrix join.

Vectors are coded once: int8 codes, a scale, two norms that bound what quantisation costs, and a digest. Queries
and vectors are dealt to blocks, and each pair of blocks is a tile, to which codes alone are sent. In a tile
the codes' products, with their bounds, rule out most pairs; of equal vectors, which their digests tell, only
the k smallest ids stay. A query's survivors of all tiles are pruned once more by the k-th best lower bound of all,
and only for the rest the original vectors are fetched, multiplied in double precision and merged by heaps. Results
are exact: a pair is dropped only where its bound can't reach the k-th best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, written

#: Queries and vectors of a block, about.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Queries of a step within a tile.
STEP_ROWS = 256


def usable(vector: Column) -> Column:
    """Whether a vector is whole: not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors, norms of what the codes miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # too small to divide; codes of 0 and the error keep the bound right
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components, so that equal vectors get equal scores."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def code_columns(vectors: DataFrame) -> DataFrame:
    """dim, id, codes, scale, norm, miss, same (a digest of the components) of rows (id, dim, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            dims = b.column("dim").to_numpy()
            flat, starts = b.column("vector").flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([flat[starts[i] : starts[i + 1]] for i in at])
                q, scale, norm, miss = coded(x)
                x = x + 0.0  # zeros of both signs are equal
                same = [xxhash.xxh3_64_intdigest(r.tobytes()) - 2**63 for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(dims[at]), b.column("id").take(pa.array(at)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(norm), pa.array(miss), pa.array(same, pa.int64())], names=CODED)

    return written(vectors.select("id", "dim", "vector").mapInArrow(run, "dim int, id long, codes binary, scale double, norm double, miss double, same long"))


CODED = ["dim", "id", "codes", "scale", "norm", "miss", "same"]
FOUND = "query_id long, ids array<long>, low array<double>, high array<double>, same array<long>"


def within(groups: np.ndarray, k: int) -> np.ndarray:
    """Whether each place of sorted groups is among its group's first k."""
    n = np.arange(len(groups))
    first = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, dtype=bool)
    return n - np.maximum.accumulate(np.where(first, n, 0)) < k


def tile(k: int):
    """For a block of queries and one of vectors, codes alone: each query's vectors that may be among its k best, with bounds of their scores."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "ids", "low", "high", "same"]
        if not len(queries) or not len(vectors):
            return pd.DataFrame({c: pd.Series(dtype="int64" if c == "query_id" else object) for c in names})
        as_codes = lambda f: np.frombuffer(b"".join(f["codes"]), dtype=np.int8).reshape(len(f), -1)
        vectors = vectors.sort_values(["same", "id"])
        vid, vs, vn, ve, same = (vectors[c].to_numpy() for c in ("id", "scale", "norm", "miss", "same"))
        qid, qs, qn, qe = (queries[c].to_numpy() for c in ("id", "scale", "norm", "miss"))
        qc, vc = as_codes(queries), as_codes(vectors)
        kind = np.float32 if vc.shape[1] <= 1040 else np.float64  # sums of int8 products stay whole numbers
        codes = np.ascontiguousarray(vc.T.astype(kind))
        out = []
        for at in range(0, len(qid), STEP_ROWS):
            part = slice(at, at + STEP_ROWS)
            ids, s, n, e = qid[part], qs[part], qn[part], qe[part]
            rough = (qc[part].astype(kind) @ codes).astype(np.float64) * (s[:, None] * vs[None, :])
            error = (n[:, None] * ve[None, :] + e[:, None] * (vn + ve)[None, :]) * (1 + 1e-9) + 1e-12 * (n[:, None] + e[:, None]) * (vn + ve)[None, :]
            own = ids[:, None] == vid[None, :]
            low = np.where(own, -np.inf, rough - error)
            high = np.where(own, -np.inf, rough + error)
            j = min(k, low.shape[1])
            least = np.partition(low, low.shape[1] - j, axis=1)[:, low.shape[1] - j]
            qi, vi = np.nonzero((high >= least[:, None]) & ~own)
            # Equal vectors stand side by side, smaller ids first.
            _, group = np.unique(same[vi], return_inverse=True)
            stay = within(qi * (group.max(initial=0) + 1) + group, k)
            qi, vi = qi[stay], vi[stay]
            first = np.searchsorted(qi, np.arange(len(ids) + 1))
            for i, query in enumerate(ids):
                v = vi[first[i] : first[i + 1]]
                out.append((query, vid[v], low[i, v], high[i, v], same[v]))
        return pd.DataFrame(out, columns=names)

    return run


def pruned(k: int):
    """Of each query's lists from all tiles: the ids that may be among its k best by all bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = []
            for lists in b.column(1).to_pylist():
                i, low, high, same = (np.concatenate([np.array(x[c], dtype=kind) for x in lists]) for c, kind in (("ids", np.int64), ("low", float), ("high", float), ("same", np.int64)))
                order = np.lexsort((i, same))
                order = order[within(same[order], k)]
                i, low, high = i[order], low[order], high[order]
                least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                ids.append(i[high >= least])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["query_id", "ids"])

    return run


def merged(k: int, kind: str):
    """Of each query's vector and those that are left: the k best by products in double precision, by a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for query, x, found in zip(*(b.column(c).to_pylist() for c in ("query_id", "vector", "found")), strict=True):
                ids = [f["id"] for f in found]
                scores = products(np.broadcast_to(np.array(x), (len(ids), len(x))), np.array([f["vector"] for f in found]))
                heap = heapq.nsmallest(k, zip((-scores).tolist(), ids, strict=True))
                rows += [(query, n, i, -s) for n, (s, i) in enumerate(heap, 1)]
            cols = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", kind, "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: each query's k vectors of largest inner product, itself left out.

    Ties go to the smaller key; a query with fewer candidates gets them all. Rows without a key, and
    vectors that are null, zero or hold null or non-finite components, take no part; vectors of another
    length than the query's aren't candidates. Of rows that repeat a key, as queries or as vectors, one
    (the smallest vector) counts. Other columns are left out, and empty tables give no rows.
    """
    ready = lambda df: df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    one = lambda df: df.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    q, v = written(one(ready(queries))), written(one(ready(vectors)))
    qc, vc = code_columns(q), code_columns(v)
    blocks = lambda n, size: max(1, -(-n // size))
    nq, nv = blocks(qc.count(), QUERY_BLOCK), blocks(vc.count(), VECTOR_BLOCK)
    left = qc.drop("same").withColumns({"i": F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))})
    right = vc.withColumns({"i": F.explode(F.sequence(F.lit(0), F.lit(nq - 1))), "j": F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int")})
    tiles = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInPandas(tile(k), FOUND)
    # One list for each tile of a query's row of tiles.
    lists = tiles.groupBy("query_id").agg(F.collect_list(F.struct("ids", "low", "high", "same")).alias("lists"))
    rest = written(lists.mapInArrow(pruned(k), "query_id long, ids array<long>"))
    pairs = rest.select("query_id", F.explode("ids").alias("id")).join(v.select("id", "vector"), "id")
    found = pairs.groupBy("query_id").agg(F.collect_list(F.struct("id", "vector")).alias("found"))
    met = found.join(q.select(F.col("id").alias("query_id"), "vector"), "query_id")
    return met.mapInArrow(merged(k, key), f"query_id long, rank int, `{key}` long, score double")
