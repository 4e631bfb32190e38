"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary weigh all ways to cut a word; a forward recursion in log space sums
them. The pieces' scores give first weights, which one pass of expected counts over the training words
fits to the corpus. No piece spans two words, so a document's probability is the product of its words'
and of the end's, and each distinct word is scored once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import crc_mod, slices, text_of, written

#: Most frequent words whose scores are broadcast (about 40 bytes each); the others are joined.
HEAD_WORDS = 200_000
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 300_000
#: Bytes of words that are scored together.
BLOCK_BYTES = 200_000
#: Words of more bytes are taken alone, LONG_BYTES at a time, so that no array is many times a long word's length.
LONG_BYTES = 50_000
#: Weight of the first scores against the counts, in pieces.
PRIOR = 1000.0
ADD = 0.1
_MUL, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class Lattice:
    """Pieces (bytes) and their log weights; ``weights`` replaces the first ones."""

    BITS = 22

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.bitmap = np.zeros(1 << self.BITS, dtype=bool)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(map(len, pieces))):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            text = np.frombuffer(b"".join(pieces[i] for i in ids), dtype=np.uint8).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(ids), dtype=np.uint64)
            for k in range(n):
                h = h * _MUL + text[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.tables[n] = h[order], ids[order]
            self.bitmap[self.slot(h)] = True

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def hits(self, text: np.ndarray) -> dict[int, np.ndarray]:
        """By length: the id of the piece at each row and place of text (words of equal length), or -1."""
        m, n = text.shape
        codes = text.astype(np.uint64) + np.uint64(1)
        h = np.zeros((m, n + 1), dtype=np.uint64)
        found = {}
        for k in range(1, min(n, self.longest) + 1):
            h = h[:, : n - k + 1] * _MUL + codes[:, k - 1 :]
            if k not in self.tables:
                continue
            rows, at = np.nonzero(self.bitmap[self.slot(h)])
            keys, ids = self.tables[k]
            mine = h[rows, at]
            pos = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            good = keys[pos] == mine
            if good.any():
                ident = np.full(h.shape, -1, dtype=np.int32)
                ident[rows[good], at[good]] = ids[pos[good]]
                found[k] = ident
        return found

    def forward(self, n: int, m: int, logs: dict[int, np.ndarray], used: dict[int, np.ndarray]) -> np.ndarray:
        """Log of the summed weight of all cuts of the first t bytes, for t from 0 to n."""
        a = np.full((m, n + 1), -np.inf)
        a[:, 0] = 0
        for t in range(1, n + 1):
            terms = [a[:, t - k] + x[:, t - k] for k, x in logs.items() if k <= t and used[k][t - k]]
            a[:, t] = terms[0] if len(terms) == 1 else np.logaddexp.reduce(terms) if terms else -np.inf
        return a

    def blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices and bytes of words of equal length (a blank before each), a bounded number at a time."""
        lens = np.array([len(w) + 1 for w in words], dtype=np.int64)
        order = np.argsort(lens, kind="stable")
        order = order[lens[order] <= LONG_BYTES]
        at = 0
        while at < len(order):
            n = int(lens[order[at]])
            end = min(int(np.searchsorted(lens[order], n, side="right")), at + max(1, BLOCK_BYTES // n))
            part = order[at:end]
            yield part, np.frombuffer(b"".join(b" " + words[i] for i in part), dtype=np.uint8).reshape(-1, n)
            at = end

    def long_word(self, word: bytes, weight: np.ndarray, total: np.ndarray | None = None, count: float = 0.0) -> float:
        """Log of one word's summed weight, LONG_BYTES at a time; total, if given, gets its pieces' expected uses."""
        text = np.frombuffer(b" " + word, dtype=np.uint8)
        n = len(text)

        def starts(lo: int) -> list[list[tuple[int, int, float]]]:
            """For each place from lo on: length, id and weight of the pieces that begin there."""
            out: list[list[tuple[int, int, float]]] = [[] for _ in range(min(n, lo + LONG_BYTES) - lo)]
            for k, ident in self.hits(text[None, lo : lo + LONG_BYTES + self.longest]).items():
                for at in np.flatnonzero(ident[0, : len(out)] >= 0).tolist():
                    out[at].append((k, int(ident[0, at]), float(weight[ident[0, at]])))
            return out

        add = lambda x, y: y if x == -math.inf else x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        a = [-math.inf] * (n + 1)
        a[0] = 0.0
        for lo in range(0, n, LONG_BYTES):
            for at, found in enumerate(starts(lo), lo):
                for k, _, w in found:
                    a[at + k] = add(a[at + k], a[at] + w)
        if total is not None:
            b = [-math.inf] * (n + 1)
            b[n] = 0.0
            for lo in reversed(range(0, n, LONG_BYTES)):
                for at, found in reversed(list(enumerate(starts(lo), lo))):
                    for k, piece, w in found:
                        b[at] = add(b[at], b[at + k] + w)
                        total[piece] += count * math.exp(a[at] + w + b[at + k] - a[n])
        return a[n]

    def log_weights(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        padded = np.r_[weight, -np.inf]
        for part, text in self.blocks(words):
            found = self.hits(text)
            logs, used = {k: padded[x] for k, x in found.items()}, {k: (x >= 0).any(axis=0) for k, x in found.items()}
            out[part] = self.forward(text.shape[1], text.shape[0], logs, used)[:, -1]
        for i, w in enumerate(words):
            if len(w) >= LONG_BYTES:
                out[i] = self.long_word(w, weight)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in all cuts of the words, each counted ``counts`` times."""
        total = np.zeros(len(weight))
        padded = np.r_[weight, -np.inf]
        for part, text in self.blocks(words):
            m, n = text.shape
            found = self.hits(text)
            logs, used = {k: padded[x] for k, x in found.items()}, {k: (x >= 0).any(axis=0) for k, x in found.items()}
            a = self.forward(n, m, logs, used)
            b = np.full((m, n + 1), -np.inf)
            b[:, n] = 0
            for t in range(n - 1, -1, -1):
                terms = [b[:, t + k] + x[:, t] for k, x in logs.items() if t + k <= n and used[k][t]]
                b[:, t] = terms[0] if len(terms) == 1 else np.logaddexp.reduce(terms) if terms else -np.inf
            for k, ident in found.items():
                rows, at = np.nonzero(ident >= 0)
                p = np.exp(a[rows, at] + logs[k][rows, at] + b[rows, at + k] - a[rows, n]) * counts[part[rows]]
                total += np.bincount(ident[rows, at], weights=p, minlength=len(total))
        for w, c in zip(words, counts, strict=True):
            if len(w) >= LONG_BYTES:
                self.long_word(w, weight, total, float(c))
        return total


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Lattice, np.ndarray]:
    """The pieces of a sentencepiece model, and log weights by the rank that their scores give (bytes last)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        raw = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        if raw.rfind(b" ") > 0:
            continue  # none of a word's cuts has a blank inside
        rank = model.get_piece_size() if model.is_byte(i) else 1 - model.get_score(i)
        weight[raw] = weight.get(raw, 0.0) + 1 / rank
    pieces = sorted(weight)
    w = np.array([weight[p] for p in pieces])
    return Lattice(pieces), np.log(w / w.sum())


@dataclass(frozen=True)
class Totals:
    """What the corpus gave: training tokens and documents, distinct training tokens, log weights of pieces and end."""

    tokens: int
    docs: int
    distinct: int
    weight: np.ndarray
    end: float


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z alone change, and blanks are x20 and x09-x0D


def counted(rows: DataFrame) -> DataFrame:
    """word, c: every distinct word and its count in the training documents (0: only in others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in slices(batches):
            for text, held_out in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if held_out:
                    for w in set(words):
                        seen.setdefault(w, 0)
                else:
                    seen.update(words)
            if len(seen) > HELD_WORDS:
                yield handed()
                seen = Counter()
        yield handed()

    found = rows.select("text", "held_out").mapInArrow(run, "word binary, c long")
    return written(found.groupBy("word").agg(F.sum("c").alias("c")))


def learnt(words: DataFrame, docs: int, path: str) -> Totals:
    """Fit the pieces' weights to the training words (word, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, first = vocabulary(path)
        total = np.zeros(len(first))
        for b in slices(batches, 50_000):
            total += lattice.expected(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float), first)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    # At most a row for each piece of the vocabulary.
    uses = words.where("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    _, first = vocabulary(path)
    n = np.exp(first) * PRIOR
    n[uses.column("piece").to_numpy()] += uses.column("n").to_numpy()
    end = docs + 1.0
    all_uses = n.sum() + end
    return Totals(int(size[0]) + docs, docs, int(size[1]) + (docs > 0), np.log(n / all_uses), math.log(end / all_uses))


def scored_words(words: DataFrame, totals: Totals, path: str) -> DataFrame:
    """word, c, lp, lp0: natural logs of the word's marginal probability by the fitted weights and by the vocabulary's own."""
    sent = words.sparkSession.sparkContext.broadcast(totals.weight)  # a number for each piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, first = vocabulary(path)
        for b in slices(batches, 50_000):
            w = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(lattice.log_weights(w, x)) for x in (sent.value, first)]], names=["word", "c", "lp", "lp0"])

    return written(words.mapInArrow(run, "word binary, c long, lp double, lp0 double"))


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score of every whole text.

    It learns from the rows whose crc32(doc_id as text) mod 10 isn't 0. Tokens are the words, A-Z lower-cased,
    and one end. base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))), score the lattice's log10
    probability of the words and the end by weights fitted to the training words, and vocabulary_score the same
    by the vocabulary's own. Null and empty texts have the end alone; a null doc_id counts as
    the empty text in crc32; repeated rows each count; without training rows the first weights hold. Other
    columns are left out. path: a sentencepiece model on every worker.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of(docs).cast("binary").alias("text"), (crc_mod(docs["doc_id"], 10) == 0).alias("held_out"))
    words = counted(rows)
    totals = learnt(words, rows.where(~F.col("held_out")).count(), path)
    words = scored_words(words, totals, path)
    base = math.log10(totals.tokens + ADD * (totals.distinct + 1))
    # HEAD_WORDS rows at most are collected and broadcast.
    top = words.orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow().combine_chunks()
    head = spark.sparkContext.broadcast((top.column("word").to_pylist(), np.r_[top.column("c").to_numpy(), 0].astype(float), np.r_[top.column("lp").to_numpy(), 0.0], np.r_[top.column("lp0").to_numpy(), 0.0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, lp, lp0 = head.value
        place = dict(zip(names, range(len(names)), strict=True))
        logs = np.r_[np.log10(c[:-1] + ADD) - base, 0.0]
        known = np.r_[c[:-1] > 0, False]
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            out = []
            for doc_id, text, held_out in zip(*[x.to_pylist() for x in b.columns], strict=True):
                w = words_of(text)
                at = np.fromiter(map(place.get, w, repeat(-1)), dtype=np.int64, count=len(w))
                rest = Counter(w[i] for i in np.flatnonzero(at < 0).tolist())
                out.append((row, doc_id, held_out, len(w), int(known[at].sum()), float(logs[at].sum()), float(lp[at].sum()), float(lp0[at].sum()), list(rest), list(rest.values())))
                row += 1
            kinds = [pa.int64(), b.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

    columns = ["row", "doc_id", "held_out", "n", "known", "base", "lp", "lp0", "rest", "times"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = written(rows.select("doc_id", "text", "held_out").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n long, known long, base double, lp double, lp0 double, rest array<binary>, times array<long>"))
    rare = part.select("row", F.inline(F.arrays_zip("rest", "times"))).withColumnsRenamed({"rest": "word", "times": "k"})
    rare = rare.join(words, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * (F.log10(F.col("c") + ADD) - base)).alias("base2"), F.sum(F.col("k") * F.col("lp")).alias("lp2"), F.sum(F.col("k") * F.col("lp0")).alias("lp3")
    )
    end_base = math.log10(totals.docs + ADD) - base
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part.drop("rest", "times").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + zero("known2") + int(totals.docs > 0)).alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2") + end_base).alias("base_score"),
        ((F.col("lp") + zero("lp2") + totals.end) / math.log(10)).alias("score"),
        ((F.col("lp0") + zero("lp3") + totals.end) / math.log(10)).alias("vocabulary_score"),
    )
