"""Document fingerprints: Merkle trees over sections, paragraphs and their pieces.

Paragraphs are lines, and long ones are cut where the words' content says so, so that an edit changes only
pieces near it. Piece, paragraph, section and root digests form the tree: equal roots mean equal texts, and
where roots differ, only differing branches need a look. A fingerprint is the tree itself, each node with its
tag and its weight in characters, so likeness and the places of edits follow from two fingerprints alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, text_of

#: Paragraphs of more words are cut after a word of which one in CUT_EVERY says so, or after MOST_WORDS words.
LEAST_WORDS, CUT_EVERY, MOST_WORDS = 8, 8, 48
#: Words whose hashes a worker keeps.
KEPT_WORDS = 400_000
#: Paragraphs of a section, at most; an empty line ends one too.
SECTION = 16
#: Documents of one range that a task sorts, about.
RANGE_ROWS = 10_000
#: Ranges at most, whose bounds the driver and the tasks hold; beyond, ranges grow.
MOST_RANGES = 20_000


class Cuts(dict):
    """Whether a line may be cut after a word, by the word's hash."""

    def __missing__(self, word: str) -> bool:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = cut = zlib.crc32(word.encode()) % CUT_EVERY == 0
        return cut


CUTS = Cuts()


def pieces(line: str) -> list[str]:
    """The line cut into pieces whose concatenation it is."""
    words = line.split(" ")
    if len(words) <= 2 * LEAST_WORDS:
        return [line]
    out, at = [], 0
    ends = [i for i, cut in enumerate(map(CUTS.__getitem__, words), 1) if cut]
    for end in [*ends, len(words)]:
        while end - at > MOST_WORDS:
            out.append(" ".join(words[at : at + MOST_WORDS]) + " ")
            at += MOST_WORDS
        if end - at >= LEAST_WORDS and end < len(words):
            out.append(" ".join(words[at:end]) + " ")
            at = end
    return [*out, " ".join(words[at:])]


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def tree(text: str) -> list[list[list[tuple[bytes, int]]]]:
    """Sections of paragraphs of pieces, each with its digest and characters; joined by line ends they are the text."""
    sections: list[list[list[tuple[bytes, int]]]] = [[]]
    for line in text.split("\n"):
        if sections[-1] and (len(sections[-1]) >= SECTION or not line):
            sections.append([])
        sections[-1].append([(digest(p.encode()), len(p)) for p in pieces(line)])
    return sections


def fingerprint(text: str) -> str:
    """root:section/section..., the root as 32 hex digits and every other node as tag.weight (8 and hex digits).

    A section is its node, = and its paragraphs, joined by ;. A paragraph is its one piece's node, or its own
    and in brackets those of its pieces, joined by commas. Weights leave line ends out.
    """
    node = lambda d, n: f"{d[:4].hex()}.{n:x}"
    sections, roots = [], []
    for s in tree(text):
        inner, marks, weight = [], [], 0
        for p in s:
            n = sum(w for _, w in p)
            mark = digest(b"paragraph", *[d for d, _ in p])
            inner.append(node(*p[0]) if len(p) == 1 else f"{node(mark, n)}[{','.join(node(*x) for x in p)}]")
            marks.append(mark)
            weight += n
        roots.append(digest(b"section", *marks))
        sections.append(f"{node(roots[-1], weight)}={';'.join(inner)}")
    return f"{digest(b'root', *roots).hex()}:{'/'.join(sections)}"


def branches(node: str) -> list[str]:
    """The nodes below a section (tag.weight=...) or a paragraph (tag.weight[...]); a piece is below itself."""
    _, of_section, inner = node.partition("=")
    if of_section:
        return inner.split(";")
    _, of_paragraph, inner = node.partition("[")
    return inner[:-1].split(",") if of_paragraph else [node]


def head(node: str) -> str:
    """tag.weight of a node."""
    return node.partition("=")[0].partition("[")[0]


def likeness(a: str, b: str) -> float:
    """The share of the two texts' characters that lies in branches of both: 1 for equal roots.

    Sections of both count as a whole; of the others the paragraphs, and of those that differ the pieces meet.
    """
    if a[:32] == b[:32]:
        return 1.0
    weight = lambda h: int(h.partition(".")[2], 16)
    x, y = a[33:].split("/"), b[33:].split("/")
    total = sum(weight(head(n)) for n in chain(x, y))
    shared = 0
    for _ in range(3):
        hx, hy = list(map(head, x)), list(map(head, y))
        both = Counter(hx) & Counter(hy)
        shared += sum(weight(h) * n for h, n in both.items())
        x, y = (list(chain.from_iterable(map(branches, unmatched(nodes, heads, both)))) for nodes, heads in ((x, hx), (y, hy)))
    return 2 * shared / max(1, total)


def unmatched(nodes: list[str], heads: list[str], both: Counter) -> list[str]:
    """The nodes that are left when as many of each head as ``both`` says are taken away."""
    left, out = Counter(both), []
    for node, h in zip(nodes, heads, strict=True):
        if left[h]:
            left[h] -= 1
        else:
            out.append(node)
    return out


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, piece) of the pieces of fingerprint b that lie in branches a lacks: where the text was edited."""
    if a[:32] == b[:32]:
        return []
    mine = a[33:].split("/")
    paragraphs = list(chain.from_iterable(map(branches, mine)))
    sections, lines, leaves = set(map(head, mine)), set(map(head, paragraphs)), set(chain.from_iterable(map(branches, paragraphs)))
    return [(i, j, k) for i, s in enumerate(b[33:].split("/")) if head(s) not in sections for j, p in enumerate(branches(s)) if head(p) not in lines for k, leaf in enumerate(branches(p)) if leaf not in leaves]


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fingerprint of every whole text; null texts count as empty, and each row stands for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "fingerprint"])

    return docs.select(key, text_of(docs).alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, ahead, doc_id, text) sorted in each range: its documents, then (ahead = 1) those that follow the last.

    Ranges come from approximate quantiles of doc_id. The first document of each range is also dealt to
    the range before it, and the very first to the last, so no row needs another range's. What is sent to
    the tasks is two numbers for each range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    n = min(MOST_RANGES, max(1, rows.count() // RANGE_ROWS))
    cuts = np.unique(np.array(rows.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else [], dtype=np.int64))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    firsts = sorted(tuple(r) for r in rows.select(place("key").alias("range"), "key").groupBy("range").agg(F.min("key")).collect())  # a row for each range
    held, first = np.array([r for r, _ in firsts], dtype=np.int32), np.array([k for _, k in firsts], dtype=np.int64)
    before = np.roll(held, 1)

    @F.pandas_udf("range int, target int")
    def dealt(key: pd.Series) -> pd.DataFrame:
        mine = np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32)
        at = np.searchsorted(held, mine)
        return pd.DataFrame({"range": mine, "target": np.where(first[at] == key.to_numpy(), before[at], -1).astype(np.int32)})

    both = rows.withColumn("d", dealt("key"))
    to = F.filter(F.array(F.struct(F.col("d.range").alias("range"), F.lit(0).alias("ahead")), F.struct(F.col("d.target").alias("range"), F.lit(1).alias("ahead"))), lambda x: x["range"] >= 0)
    both = both.select("doc_id", "text", F.inline(to)).select("range", "ahead", "doc_id", "text")
    return both.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def with_edits(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's with its last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document's, in ascending order of doc_id; the first follows the last.
    Null ids come first, null texts count as empty, rows of equal id are ordered by text, and a document
    alone in the table is followed by itself. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in slices(batches) for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out: list[tuple] = []
        held, mark = None, ""
        for r in chain(rows, [None]):
            if held and not held[1] and r and r[0] == held[0]:
                text, after = held[3], r[3]
                half = len(text) // 2
                edited = text[: len(text) - half] + after[:half]
                mark_e, mark_n = fingerprint(edited), fingerprint(after)
                out.append((held[2], len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, mark_e, likeness(mark, mark_e), likeness(mark, mark_n)))
                held, mark = r, mark_n
            elif r and not (held and held[0] == r[0]):
                held, mark = r, fingerprint(r[3])
            if out and (r is None or len(out) >= 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
