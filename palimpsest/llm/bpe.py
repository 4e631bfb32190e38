"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's distinct unseen words lie in one flat symbol array. Each round looks the adjacent pairs up
by binary search in the sorted pair keys, takes each word's lowest rank, and merges all places of it.
Only the pairs beside a merge are looked up again, and finished words leave the array, so one very
long word doesn't hold up the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, text_of

NO_RANK = np.int64(1) << 40
#: Entries that a worker keeps of what it has encoded; beyond it starts anew, which changes speed only.
CACHE_WORDS = 800_000


def byte_symbols() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


class Bpe:
    """A byte-level BPE tokenizer read from a ``tokenizers`` JSON file."""

    #: Fixed value: how this kind of vocabulary cuts text into words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], dtype=np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.word_re = regex.compile(self.PATTERN)
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes | None] = {}  # of "x": the ids of " x", or None if it can't stand alone

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = np.full(len(sym), NO_RANK)
        rank[:-1] = self.rank_of(sym[:-1], sym[1:])
        rank[:-1][word[:-1] != word[1:]] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            low = np.minimum.reduceat(rank, first)
            if (over := low == NO_RANK).any():
                gone = np.repeat(over, size)
                done.append((word[gone], sym[gone]))
                stay = ~gone
                word, sym, rank, low, size = word[stay], sym[stay], rank[stay], low[~over], size[~over]
                if not len(sym):
                    break
            here = rank == np.repeat(low, size)
            at = np.arange(len(sym))
            run = at - np.maximum.accumulate(np.where(here, -1, at))  # 1, 2, 3 along neighbours of equal symbols
            p = np.flatnonzero(here & (run % 2 == 1))
            sym[p] = self.merged[rank[p]]
            keep = np.ones(len(sym), dtype=bool)
            keep[p + 1] = False
            p = p - np.arange(len(p))  # their places once the right halves have gone
            word, sym, rank = word[keep], sym[keep], rank[keep]
            for q in (p, p[p > 0] - 1):
                q_in = q[q + 1 < len(sym)]
                rank[q_in] = np.where(word[q_in] == word[q_in + 1], self.rank_of(sym[q_in], sym[q_in + 1]), NO_RANK)
                rank[q[q + 1 >= len(sym)]] = NO_RANK
        if not done:
            return [b""] * len(words)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        flat = sym[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, cut: list[list[str]]) -> None:
        """Encode those words of ``cut`` that the cache lacks, all together."""
        new = [*set().union(*cut).difference(self.words)] if cut else []
        if new:
            self.words.update(zip(new, self.merge_words([w.encode() for w in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        A single blank or line end between two other characters always starts a word, so texts are split
        there and the parts looked up whole. A part with other white space at its ends, or a special
        token, sends its text the long way.
        """
        if len(self.spaced) + len(self.words) > CACHE_WORDS:
            self.spaced.clear()
            self.words.clear()
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        rest = [p[1:] for p in parts]
        new = [*set().union(*rest).difference(self.spaced)] if rest else []
        self.spaced.update(dict.fromkeys(new))
        plain = [s for s in new if (body := s.removeprefix("\n")) and body.strip() == body]
        cut = [self.word_re.findall(s if s[0] == "\n" else " " + s) for s in plain]
        firsts = [[] if not p[0] or p[0][-1].isspace() else self.word_re.findall(p[0]) for p in parts]
        self.learn([*cut, *firsts])
        get = self.words.__getitem__
        self.spaced.update(zip(plain, [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut], strict=True))
        out: list[bytes | None] = []
        look = self.spaced.__getitem__
        for t, p, first in zip(texts, parts, firsts, strict=True):
            try:
                if not first or any(x in t for x in self.special):
                    raise TypeError
                out.append(b"".join([*map(get, first), *map(look, p[1:])]))
            except TypeError:  # a None among them
                out.append(None)
        slow = [i for i, x in enumerate(out) if x is None]
        spans = [self.spans(texts[i]) for i in slow]
        self.learn([x for span in spans for x, token in span if token is None])
        for i, span in zip(slow, spans, strict=True):
            out[i] = b"".join(token if token is not None else b"".join(map(self.words.__getitem__, x)) for x, token in span)
        return out

    def spans(self, text: str) -> list[tuple[list[str], bytes | None]]:
        """The text's words between special tokens, and those tokens' ids."""
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [(self.word_re.findall(text[at : m.start()]), None), ([], np.uint32(self.special[m[0]]).tobytes())]
            at = m.end()
        return [*out, (self.word_re.findall(text[at:]), None)]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that aren't valid become U+FFFD."""
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", errors="replace").encode()


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Bpe:
    """One tokenizer for each worker process."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    path: a byte-level BPE JSON file that every worker can open. Null texts count as empty and give no
    ids; strings of special tokens become these tokens. Each row is encoded alone: repeated rows, null
    keys and empty tables need nothing else. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in slices(batches):
            ids = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[key, "n_tokens", "ids"])

    rows = docs.select(docs[key], text_of(docs, text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of ``keep``, decoded (string) of rows with ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in slices(batches):
            texts = [bpe.decode(x or b"") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string())], names=[key, *keep, "decoded"])

    rows = encoded.select(key, *keep, "ids")
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInArrow(run, f"{kinds}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents, through ``encode`` and ``decode``."""
    coded = encode(docs, path).withColumn("ids_sha256", F.sha2("ids", 256))
    back = decode(coded, path, keep=("n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
