"""Pairs of word sets that are alike, within one group of rows that fits a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that a task holds before they leave it.
PAIRS_OUT = 1 << 20


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def alike(of: np.ndarray, words: np.ndarray, m: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(p, rows q, words that they share) for each row p from m on and rows q before m with 100 * shared >= percent * united.

    ``words`` has each row's different words as numbers, ``of`` whose they are, in any order; the rows before m are by size, and no row is empty.
    Words are put in one order: those that one side lacks, then from rare to frequent. Sets that are alike enough share one of the
    first words of each, which find the rows q; how many of these they share, and how many words are left
    behind them, bounds what they share in all, and what the bound leaves is counted.
    """
    n = np.bincount(of)
    at = np.concatenate([[0], np.cumsum(n)])
    left, right = (np.bincount(words[x], minlength=words.max() + 1) for x in (of < m, of >= m))
    both = (left > 0) & (right > 0)
    common = len(both) - np.count_nonzero(both)  # the first rank that both sides hold
    rank = np.empty(len(both), np.int32)
    rank[np.argsort(np.where(both, left + right, 0), kind="stable")] = np.arange(len(both))
    line = np.multiply(of, len(both), dtype=np.int64)
    line += rank[words]
    line.sort()
    line = np.remainder(line, len(both), out=line).astype(np.int32)
    of, cut = np.repeat(np.arange(len(n), dtype=np.int32), n), at[m]
    behind = -(-n * percent // 100) - 1  # a row's words that aren't among its first
    last = line[at[1:] - behind - 1]
    early = np.zeros(len(line) + 1, np.int8)
    early[at[:-1]] = 1
    early[at[1:] - behind] -= 1
    early = np.cumsum(early[:-1], dtype=np.int8).astype(bool) & (line >= common)
    posts = line[:cut][early[:cut]].astype(np.int64) * m + of[:cut][early[:cut]]
    posts.sort()
    holder = (posts % m).astype(np.int32)
    probes = np.flatnonzero(early[cut:]) + cut
    # Rows of fitting size are neighbours.
    low, high = np.searchsorted(n[:m], -(-n * percent // 100)), np.searchsorted(n[:m], n * 100 // percent, "right")
    key = line[probes].astype(np.int64) * m
    start = np.searchsorted(posts, key + low[of[probes]])
    found = np.searchsorted(posts, key + high[of[probes]]) - start
    del of, early, posts, key
    bounds = np.searchsorted(probes, at[m:])
    mark = np.zeros(len(both), np.int64)
    for p in range(m, len(n)):
        mine = slice(bounds[p - m], bounds[p - m + 1])
        held = holder[spans(start[mine], found[mine])]
        if not len(held):
            continue
        shared = np.bincount(held - low[p], minlength=high[p] - low[p])
        q = np.flatnonzero(shared)
        shared, q = shared[q], q + low[p]
        rest = np.where(last[q] < last[p], behind[q], behind[p])
        need = -(-(n[p] + n[q]) * percent // (100 + percent))
        q, need = (x[shared + rest >= need] for x in (q, need))
        if not len(q):
            continue
        mark[line[at[p] : at[p + 1]]] = 1
        shared = np.add.reduceat(mark[line[spans(at[q], n[q])]], np.cumsum(n[q]) - n[q])
        mark[line[at[p] : at[p + 1]]] = 0
        if (hits := shared >= need).any():
            yield p, q[hits], shared[hits]


def pairs_of(percent: int) -> Callable:
    """A function that gives the pairs (scope, p, p_at, q, q_at, jaccard) of a cell's rows (scope, neg, n, class, created_at, text), p negated and q not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, words = [], []
        for b in batches:  # a batch's texts go when they are cut
            parts.append(b.select(["scope", "neg", "n", "class", "created_at"]))
            words.append(pc.split_pattern(b.column("text"), " ").flatten().dictionary_encode())
        rows = pa.Table.from_batches(parts)
        m = pc.sum(pc.invert(rows["neg"])).as_py()
        if m in (0, len(rows)):
            return
        pa.default_memory_pool().release_unused()  # else the process keeps what the texts took
        words = np.concatenate([x.indices.to_numpy() for x in pa.chunked_array(words).unify_dictionaries().chunks])
        order = pc.sort_indices(rows, [("neg", "ascending"), ("n", "ascending")])
        of = np.empty(len(rows), np.int32)
        of[order.to_numpy()] = np.arange(len(rows))
        of = np.repeat(of, rows["n"].to_numpy())
        rows = rows.take(order).combine_chunks()
        n = rows["n"].to_numpy().astype(np.int64)
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            p, q, shared = (np.concatenate(x) for x in zip(*held, strict=True))
            names, at = rows["class"], rows["created_at"]
            found = [rows["scope"].take(pa.array(p)), names.take(pa.array(p)), at.take(pa.array(p)), names.take(pa.array(q)), at.take(pa.array(q)), pa.array(shared / (n[p] + n[q] - shared))]
            return pa.Table.from_arrays(found, ["scope", "p", "p_at", "q", "q_at", "jaccard"]).combine_chunks().to_batches()[0]

        for p, q, shared in alike(of, words, m, percent):
            held.append((np.full(len(q), p), q, shared))
            size += len(q)
            if size >= PAIRS_OUT:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    return run
