"""Quality classifier by Bradley-Terry pairwise ranking.

Each preference pair holds a document labelled good and one labelled bad; the logistic loss on the
difference of their features fits one weight for each feature. Features are numbers about a text's form and
hashed profiles of its word and character n-grams. The threshold is the quantile of the scores that leaves
out as large a share of the training rows as is labelled bad.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import crc_mod, slices, text_of
from palimpsest.llm.near_dup import WordHashes

#: Labels that the fit takes, texts that it takes with them (more than labels where ids repeat), and preference pairs it draws from them, at most.
TRAIN_ROWS, TRAIN_TEXTS, PAIRS = 20_000, 40_000, 200_000
#: The weight of the squared weights in the loss. In four folds of sf0.1's training rows 0.001, 0.01 and 0.05
#: were alike at the threshold (7, 9, 10 wrong of 3,155) and in order (106, 56, 44 pairs of good and bad rows the wrong way).
RIDGE = 0.01
#: The probability that the threshold is mapped to.
CUT = 0.3
#: Places of a profile of n-grams; there is one of words and pairs of words, and one of three characters.
PLACES = 64
#: Bytes whose n-grams, and pairs whose differences, are held at a time.
WINDOW_BYTES, PAIR_ROWS = 1 << 20, 1 << 14
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS = bytes(range(48, 58))
FEATURES = (
    "words", "word_length", "distinct", "adjacent_repeats", "near_repeats", "lines", "distinct_lines", "line_words",
    "upper", "letters", "digits", "non_ascii", "percent", "hash", "ampersand", "dollar", "asterisk", "pipe", "bang", "stops", "commas",
)
N_FEATURES = len(FEATURES) + 2 * PLACES
MIX, MIX_SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)


def counted(mixed: np.ndarray) -> np.ndarray:
    """How often each place and sign, the upper bits of mixed codes, occurs."""
    mixed >>= mixed.dtype.type(8 * mixed.itemsize - 7)
    return np.bincount(mixed.astype(np.intp), minlength=2 * PLACES)


def profile(counts: np.ndarray) -> list[float]:
    """Counts of one sign less those of the other by place, as a vector of length 1 (or 0)."""
    v = (counts[:PLACES] - counts[PLACES:]).astype(float)
    return (v / max(1.0, math.sqrt(v @ v))).tolist()


def word_profile(words: list[bytes], hashes: WordHashes) -> list[float]:
    """Of words and pairs of neighbouring words."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    return profile(counted(np.concatenate([h, (h[:-1] * MIX) ^ h[1:]]) * MIX))


def letter_profile(text: bytes) -> list[float]:
    """Of runs of three bytes, some of the text at a time."""
    counts = np.zeros(2 * PLACES, dtype=np.int64)
    for at in range(0, max(1, len(text) - 2), WINDOW_BYTES):
        x = np.frombuffer(text[at : at + WINDOW_BYTES + 2], dtype=np.uint8).astype(np.uint32)
        codes = x[:-2] << np.uint32(8)
        codes |= x[1:-1]
        codes <<= np.uint32(8)
        codes |= x[2:]
        codes *= MIX_SHORT
        counts += counted(codes)
    return profile(counts)


def features(text: bytes, hashes: WordHashes) -> list[float]:
    """Numbers about a text's form (shares of kinds of letters, repeats, lengths), then its profiles. A text without words gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    n, w = len(text), len(words)
    lines = text.split(b"\n")
    seen = len(set(words))
    letters = n - len(text.translate(None, LETTERS))
    upper = n - len(text.translate(None, UPPER))
    share = lambda x: math.sqrt(min(4.0, text.count(x) / w))
    return [
        math.log1p(w),
        math.log(n / w),
        math.log1p(seen) / math.log1p(w),
        math.sqrt(sum(map(operator.eq, words, words[1:])) / w),
        math.sqrt(sum(map(operator.eq, words, words[2:])) / w),
        math.log1p(len(lines)),
        len(set(lines)) / len(lines),
        math.log1p(w / len(lines)),
        math.sqrt(upper / n),
        letters / n,
        math.sqrt((n - len(text.translate(None, DIGITS))) / n),
        len(text.translate(None, bytes(range(128)))) / n,
        *(share(x) for x in (b"%", b"#", b"&", b"$", b"*", b"|", b"!", b".", b",")),
        *word_profile(text.lower().split(), hashes),
        *letter_profile(text),
    ]


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of ``keep`` and x, the features of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            x = [features(t, hashes) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, text_of(docs).cast("binary").alias("text")).mapInArrow(run, f"{kinds}x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    weight: np.ndarray  # for centred features
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold has CUT."""
        z = (x - self.mean) @ self.weight - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Model:
    """The model of rows x with labels y (0 or 1); without both kinds every text gets the same score."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        k = x.shape[1] if x.ndim == 2 else N_FEATURES
        return Model(np.zeros(k), np.zeros(k), 1.0 if len(bad) else -1.0)
    mean, dev = x.mean(axis=0), x.std(axis=0)
    dev[dev < 1e-9] = 1
    z = (x - mean) / dev
    rng = np.random.Generator(np.random.PCG64(7))
    pairs = min(PAIRS, len(good) * len(bad) * 4)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    weight = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps of the logistic loss
        slope, curve = ridge * weight, ridge * np.eye(len(weight))
        for at in range(0, pairs, PAIR_ROWS):
            d = z[better[at : at + PAIR_ROWS]] - z[worse[at : at + PAIR_ROWS]]
            p = 1 / (1 + np.exp(-np.clip(d @ weight, -30, 30)))
            slope += d.T @ (p - 1) / pairs
            curve += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(curve, slope)
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ weight
    share = len(bad) / len(y)
    return Model(mean, weight / dev, float(np.quantile(s, share)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on labelled rows (doc_id, ``label`` 0 or 1) whose crc32(doc_id) mod 5 isn't 0, TRAIN_ROWS at most.

    The rows are those of smallest hash of doc_id, so the sample is the same on every run. Other labels,
    null ids and ids that docs lacks are left out. A doc_id with several rows counts with each, up to TRAIN_TEXTS
    in all, again by the smallest hash of doc_id.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(crc_mod(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS)
    # At most TRAIN_ROWS narrow rows are broadcast, and TRAIN_TEXTS feature rows collected.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    found = featured(rows, "doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_TEXTS).toArrow()
    x = pa.concat_arrays([c.flatten() for c in found.column("x").chunks] or [pa.array([], pa.float64())]).to_numpy().reshape(-1, N_FEATURES)
    return fit_pairs(x, found.column("y").to_numpy(), RIDGE)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= CUT, else 0).

    Every whole text is scored; null and empty texts get the score of a text without words. Nulls in other
    columns, repeated rows and an empty table need nothing else. Columns score and predicted that docs
    has already are replaced.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            x = np.array([features((t or "").encode(), hashes) for t in b.column(at).to_pylist()], dtype=float).reshape(-1, N_FEATURES)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= CUT).astype("int32"))], names=[*b.schema.names, "score", "predicted"])

    at = rest.index("text")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest).mapInArrow(run, f"{kinds}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from the labels of the others."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
