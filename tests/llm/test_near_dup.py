import random

import numpy as np
import pytest

from palimpsest.llm import components as cc
from palimpsest.llm import near_dup as nd


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width=2):
    sets = [(i, shingles(t, width)) for i, t in rows]
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
    return {i: (len(s), find(i)) for i, s in sets}


def answer(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, component string, n_shingles double")
    return {r["doc_id"]: r for r in nd.near_duplicates(df, width=2, percent=80).collect()}


def test_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    for k in range(60):  # a chain of copies: each is near the next, not near all
        base = list(base)
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((10_000 + k, " ".join(base)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one"), (20_004, "ONE"), (20_005, "one two"), (20_006, "One  two")]
    want, got = brute(rows), answer(spark, rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_hot_group_below_the_threshold_for_its_lead(spark):
    """Many near copies of one text, most unlike each other, whose smallest id is far from the middle."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(1000)]
    base = [rng.choice(words) for _ in range(200)]

    def edited(n):
        t = list(base)
        for p in rng.sample(range(200), n):
            t[p] = rng.choice(words)
        return " ".join(t)

    rows = [(i, edited(rng.randint(8, 14))) for i in range(150)] + [(999, " ".join(base))]
    want = brute(rows)
    got = answer(spark, rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def edits(n_texts, n_words, least, most, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(n_words)]
    out = []
    for _ in range(n_texts):
        t = list(base)
        for p in rng.sample(range(n_words), rng.randint(least, most)):
            t[p] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("family_rows", [20, 4096])
def test_tiles_of_a_hot_group_of_short_texts(spark, monkeypatch, family_rows):
    """Many blocks a bucket, families compared as a whole and bucket by bucket, and ids that repeat with other texts."""
    monkeypatch.setattr(nd, "TILE_ROWS", 16)
    monkeypatch.setattr(nd, "FAMILY_ROWS", family_rows)
    texts = edits(160, 60, 2, 7, 3)
    rows = [(i % 150, t) for i, t in enumerate(texts)]
    sets = [(n, i, shingles(t, 2)) for n, (i, t) in enumerate(rows)]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i, a in sets:
        for _, j, b in sets[:n]:
            if 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, width=2, percent=80).collect()]
    assert sorted(got) == sorted((i, len(s), find(i)) for _, i, s in sets)
    assert 1 < len({find(i) for i in root}) < 150


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near, other = base.replace("w50", "x"), " ".join(f"u{i}" for i in range(50))
    rows = [(3, near, "a"), (5, base, "b"), (5, other, "c"), (5, other, "d"), (7, other, "e"), (8, None, "f"), (8, "", "g"), (None, base, "h"), (None, base, "i"), (9, base, "j"), (4, base, "k"), (4, base, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in nd.one_of_each(df).collect())
    assert got == sorted([("3", near), ("5", other), ("8", "None"), ("8", ""), ("None", base), ("None", base)])
    assert nd.one_of_each(df.limit(0)).count() == 0


def test_overlaps_and_forest():
    rng = np.random.Generator(np.random.PCG64(3))
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(40)] + [np.unique(rng.integers(0, 2**40, 500).astype(np.uint64))]
    want = [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:20]]
    assert nd.overlaps(sets[:20], sets[15:]).tolist() == want
    hits = rng.random((30, 25)) < 0.05
    left, right = rng.integers(0, 20, 30), rng.integers(0, 20, 25)
    part = {g: g for g in range(20)}
    for i, j in nd.forest(hits, left, right):
        assert hits[i, j] and part[left[i]] != part[right[j]]  # no link is needless
        a, b = part[left[i]], part[right[j]]
        part = {g: a if p == b else p for g, p in part.items()}
    assert all(part[left[i]] == part[right[j]] for i, j in zip(*np.nonzero(hits), strict=True))


def test_a_full_tile_takes_seconds():
    """Near copies below the threshold, as many as a tile holds on both sides."""
    import time

    import pyarrow as pa

    hashes = nd.WordHashes()
    sets = [nd.shingle_set(t.encode(), 2, hashes) for t in edits(2000, 60, 6, 7, 1)]
    n = len(sets)
    cols = {"i": [0] * n, "j": [1] * n, "side": [k % 2 for k in range(n)], "key": [str(k).encode() for k in range(n)], "component": [str(k).encode() for k in range(n)], "n_shingles": [len(s) for s in sets]}
    began = time.time()
    nd.in_tile(pa.table(cols | {"payload": [s.tobytes() for s in sets]}), 80, True)
    nd.in_tile(pa.table(cols | {"payload": [nd.sketch(s).tobytes() for s in sets]}), 80, False)
    assert time.time() - began < 20


def test_null_ids_repeats_and_empty(spark):
    got = nd.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "x y z"), (2, "x y z"), (0, "a b c")], "doc_id long, text string"), width=2).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("0", "0"), ("1", "0"), ("1", "0"), ("2", "0"), ("None", "None")]
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("jaccard", [0.5, 0.8, 0.95])
def test_registers_estimate_and_merge(jaccard):
    rng = np.random.Generator(np.random.PCG64(1))
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    rng.shuffle(pool)
    n = int(1000 * (1 + jaccard) / 2)
    a, b = pool[:n], pool[1000 - n : 1000]
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sa, sb = nd.sketch(a), nd.sketch(b)
    assert (nd.merged_sketch(sa, sb) == nd.sketch(np.union1d(a, b))).all()
    hit = nd.plausible(sa[None], sb[None], np.array([float(n)]), np.array([float(n)]), 0.8)[0]
    assert hit == (j >= 0.7)


@pytest.mark.parametrize("rows", [100_000, 7])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(cc, "TASK_ROWS", rows)
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 5), (7, 7), (9, None)], "a long, b long")
    got = {r["id"]: r["component"] for r in cc.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3}
    assert cc.components(links.limit(0)).count() == 0
    some = np.random.default_rng(rows).integers(0, 90, (60, 2)).tolist()
    names = spark.createDataFrame([(f"{a:02}".encode(), f"{b:02}".encode()) for a, b in some], "a binary, b binary")
    want = {}
    for group in (set(map(tuple, some)),):
        root = {x: x for p in group for x in p}
        for _ in root:
            for a, b in group:
                root[a] = root[b] = min(root[a], root[b])
        want = {f"{x:02}": f"{r:02}" for x, r in root.items()}
    got = {bytes(r["id"]).decode(): bytes(r["component"]).decode() for r in cc.components(names.repartition(5)).collect()}
    assert {x: got.get(x, x) for x in want} == want
