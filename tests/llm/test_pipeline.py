import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as cp  # noqa: E402


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_each_stage_against_its_own_input(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionAll(spark.createDataFrame([(None, None, None, None, None)], docs.schema)).cache()
    good = cp.keep_good(spark, docs, sf).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns
    assert sum((i in kept) == (y == 1) for i, y in labels.items()) / len(labels) > 0.93

    one = cp.keep_one(spark, good, sf).cache()
    rows = [(r["doc_id"], shingles(r["text"] or "")) for r in good.collect()]
    left = {r["doc_id"] for r in one.collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert left == {find(i) for i, _ in rows}

    one = one.unionAll(spark.createDataFrame([(10**6, "key: token=0123456789abcdef0123 ends", "en", "s", 36)], docs.schema)).cache()
    clean = cp.hide_secrets(spark, one, sf).cache()
    assert clean.columns == docs.columns and clean.count() == one.count()
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[10**6]["text"] == "key: [SECRET] ends" and texts[10**6]["n_chars"] == 18

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: np.array(tk.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, r in texts.items()}
    total = 0
    for r in cp.pack(spark, clean, sf).collect():
        ids = want[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total += r["length"]
    assert total == sum(map(len, want.values()))


def near_dups_gone(rows):
    """The ids that stay when of each group of linked texts (doc_id, text) the one of smallest id does."""
    sets = [(i, shingles(t or "")) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {find(i) for i, _ in sets}


#: What a text without secrets has none of.
SECRET = re.compile(r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|gh[pousr]_|eyJ|-----BEGIN")


def test_run_against_brute_force(spark):
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "near-dedup", "secret scans", "packing"]
    sf = "/root/testdata/sf0.001"
    good = cp.keep_good(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    left = near_dups_gone(texts.items())
    done = cp.run(spark, sf)
    assert done.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces, sequences = {}, {}
    for r in done.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == left
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain = 0
    for i in left:
        mine = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()]
        if not SECRET.search(texts[i] or ""):
            plain += 1
            ids = np.array(tk.encode(texts[i] or "", add_special_tokens=False).ids + [0], dtype="<u4")
            assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    assert plain > len(left) / 2
    for at in sequences.values():
        at.sort()
        assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1].tolist()] and sum(n for _, n in at) <= 1024


def test_stages_on_rows_of_every_kind(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a few words that say nothing in particular here", None, None, 3), (2, "other words", "en", "s", 11), (3, "x " * 200_000, "en", "s", 400_000)]
    rows = spark.createDataFrame(odd, docs.schema).selectExpr("*", "1 AS score", "'y' AS key", "2 AS predicted")
    for name, stage in cp.STAGES:
        out = stage(spark, rows, sf)
        assert name == "packing" or out.columns == docs.columns
        out.collect()
        assert stage(spark, rows.limit(0), sf).count() == 0
