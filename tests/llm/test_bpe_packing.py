import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from palimpsest.llm import bpe, packing  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "the the\n\nend ", "a<|endoftext|>b  c", "aaaaaaaaaaaaa aaa", "日本語 é x\tz", "don't I'll 123abc_ 45", "x" * 3000, " lead  two\n\n x ", "the the\n\nend "]


def reference_ids(texts):
    tk = Tokenizer.from_file(PATH)
    return [np.array(tk.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for t in texts], tk


def frame(spark, texts):
    return spark.createDataFrame([(i if i else None, t, "bin", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_ids_and_text_round_trip(spark, small):
    docs = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()][:80]
    texts = TEXTS + docs
    want, tk = reference_ids(texts)
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, texts), PATH).collect()}
    for i, (t, ids) in enumerate(zip(texts, want)):
        r = got[i or None]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tk.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()


def test_random_words_match(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab e\n é<|'s1.") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    want, _ = reference_ids(texts)
    assert bpe.Bpe(PATH).encode(texts) == [x.tobytes() for x in want]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, PATH).count() == 0
    assert packing.pack(docs, PATH).count() == 0


def fills(plan):
    fill, seen = {}, {}
    for length, rank, n, start, seg, a0, hole0, room, holes, pack, at in plan:
        for i in range(n):
            a = a0 + i * seg
            for j in range(max(0, (a - hole0) // room), min(holes - 1, (a + seg - 1 - hole0) // room) + 1):
                h = hole0 + j * room
                lo, hi = max(a, h), min(a + seg, h + room)
                fill.setdefault(pack + j, []).append((at + lo - h, hi - lo))
                seen.setdefault((length, rank + i), []).append((start + lo - a, hi - lo))
    return fill, seen


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_token_once(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 1024])
    hist = {rng.randint(1, size - 1): rng.randint(1, 400) for _ in range(rng.randint(1, size - 1))}
    if seed % 3 == 0:
        hist = {k: v for k, v in hist.items() if k > size // 2} or {size - 1: 5}
    plan, packs = packing.shortest_pack_first(hist, size)
    fill, seen = fills(plan)
    for parts in [*fill.values(), *seen.values()]:
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
    assert all(sum(n for _, n in parts) == length for (length, _), parts in seen.items())
    assert len(seen) == sum(hist.values()) and max(sum(n for _, n in x) for x in fill.values()) <= size
    if size == 1024:
        assert sum(size - sum(n for _, n in x) for x in fill.values()) <= 0.004 * size * len(fill) + 2 * size


def test_plan_does_not_grow_with_documents():
    one, _ = packing.shortest_pack_first({k: 100 + k for k in range(1, 1024)}, 1024)
    many, _ = packing.shortest_pack_first({k: 100_000 + 1000 * k for k in range(1, 1024)}, 1024)
    assert len(many) < 3 * len(one)


def test_pieces_and_sequences(spark, small):
    docs = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts = TEXTS + docs
    want, _ = reference_ids(texts)
    want = [np.append(x, 0).astype("<u4") for x in want]
    rows = packing.pack(frame(spark, texts), PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"] or 0, []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for i, parts in by_doc.items():
        end = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(want[i])
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(want[i][r["start"] : end].tobytes())
        assert end == len(want[i])
    padding = 0
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding <= 2048


LONG = [" " * 2_000_000, "\n" * 2_000_000, "\t" * 1_000_000, "\xa0" * 1_000_000, "a" * 2_000_000, "x" + " " * 1_000_000 + "y<|endoftext|>"]


def test_very_long_runs_of_one_letter(spark):
    want, _ = reference_ids(LONG)
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, LONG), PATH).collect()}
    for i, ids in enumerate(want):
        assert got[i or None]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
    pieces = {}
    for r in packing.pack(frame(spark, LONG).drop("ids", "n_tokens"), PATH).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, ids in enumerate(want):
        ids = np.append(ids, np.uint32(0)).astype("<u4")
        mine = sorted(pieces[i or None])
        assert [a for a, _, _ in mine] == [0, *np.cumsum([n for _, n, _ in mine])[:-1].tolist()] and sum(n for _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in mine)
