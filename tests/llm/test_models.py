import collections
import functools
import math
import operator
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from palimpsest.llm import ann, lm, quality  # noqa: E402

PIECES = P.path("piece_bpe_32k.model")


def test_nearest_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 100)
    df = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    one = df.where("vec_id = 3").first()["embedding"]
    rows = [(1000, None), (1020, [0.0] * 64), (1040, [1.0] * 63 + [float("nan")]), (1060, [1.0, 2.0]), (1061, [3.0, 1.0]), (None, [1.0] * 64), (1080, [1e-42] * 64), (1100, [1.0] * 63 + [None])]
    rows += [(2000 + i, list(one)) for i in range(50)]  # ties go to smaller ids
    df = df.unionAll(spark.createDataFrame(rows, df.schema)).selectExpr("*", "1 AS score", "'q' AS query_id")
    got = collections.defaultdict(list)
    for r in ann.nearest(df.where("vec_id % 20 = 0"), df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = {r["vec_id"]: r["embedding"] for r in df.collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    queries = [i for i in x if i % 20 == 0]
    assert set(got) == set(queries)
    for q in queries:
        best = sorted((-functools.reduce(operator.add, map(operator.mul, x[q], v), 0.0), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:20]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert ann.nearest(df.limit(0), df).count() == 0


def test_lattice_is_the_sum_over_all_cuts():
    lattice, weight = lm.vocabulary(PIECES)
    of = dict(zip(lattice.pieces, weight))

    def cuts(s):
        return sum(math.exp(of[s[:k]]) * cuts(s[k:]) for k in range(1, len(s) + 1) if s[:k] in of) if s else 1.0

    words = [b"the", b"", b"thwhen", "né".encode(), b"zq", b"the"]
    assert np.allclose(lattice.log_weights(words, weight), [math.log(cuts(b" " + w)) for w in words])
    n = lattice.expected(words, np.ones(len(words)), weight)
    assert np.isclose(sum(len(p) * x for p, x in zip(lattice.pieces, n)), sum(len(w) + 1 for w in words))
    assert np.isfinite(lattice.log_weights([b"x" * 20_000], weight)).all()


@pytest.mark.parametrize("head", [200_000, 50])
def test_scores_against_brute_force(spark, small, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    df = df.unionAll(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "The zzzqqq"), (3, "the a"), (3, "the a")], df.schema)).selectExpr("*", "1 AS word", "2 AS row")
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in df.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    docs = sum(not held(i) for i, _ in rows)
    n, v = sum(c.values()) + docs, len(c) + 1
    log = lambda x: math.log10((x + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((str(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, held(i), round(sum(log(c[x]) for x in w) + log(docs), 6)) for i, w in rows)
    got = lm.score(df, PIECES).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(-1e7 < r["score"] < 0 for r in got)
    assert lm.score(df.limit(0), PIECES).count() == 0


def test_score_against_an_independent_fit(spark):
    """The score from its definition: one pass of expected counts over all cuts, then the sum over all cuts of each word."""
    lattice, weight = lm.vocabulary(PIECES)
    first = {p: math.exp(w) for p, w in zip(lattice.pieces, weight)}
    texts = ["the cat then", "a cat the", "Then né zq", "", None, "cat cat cat the"] + [f"when the w{i}" for i in range(20)]
    docs = list(enumerate(texts))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: (t or "").lower().encode().split()

    def cuts(s):
        return [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in first for rest in cuts(s[k:])] if s else [[]]

    value = lambda cut, of: math.prod(of[p] for p in cut)
    uses = collections.Counter({p: w * 1000.0 for p, w in first.items()})
    n_docs = sum(not held(i) for i, _ in docs)
    for i, t in docs:
        for w in [] if held(i) else words(t):
            every = cuts(b" " + w)
            whole = sum(value(c, first) for c in every)
            for c in every:
                for p in c:
                    uses[p] += value(c, first) / whole
    total = sum(uses.values()) + n_docs + 1
    fitted = {p: n / total for p, n in uses.items()}
    score = lambda t, of: sum(math.log10(sum(value(c, of) for c in cuts(b" " + w))) for w in words(t)) + math.log10((n_docs + 1) / total)
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), PIECES).collect()}
    for i, t in docs:
        assert got[i]["score"] == pytest.approx(score(t, fitted), abs=1e-6) and got[i]["vocabulary_score"] == pytest.approx(score(t, first), abs=1e-6)


def test_long_words_are_taken_in_parts(monkeypatch):
    lattice, weight = lm.vocabulary(PIECES)
    words = [b"thewhencat" * 40, b"the"]
    want, uses = lattice.log_weights(words, weight), lattice.expected(words, np.array([2.0, 3.0]), weight)
    monkeypatch.setattr(lm, "LONG_BYTES", 64)
    assert np.allclose(lattice.log_weights(words, weight), want) and np.allclose(lattice.expected(words, np.array([2.0, 3.0]), weight), uses)


def test_quality_weights_are_the_least_loss():
    """By the loss alone: no step from the fitted weights lessens it, and the threshold leaves out the share that is bad."""
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(200, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = (x @ [1.0, -0.3, 2.0, 0.0] + rng.normal(size=200) > 1.5).astype(int)
    model = quality.fit_pairs(x, y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.Generator(np.random.PCG64(7))
    n = min(quality.PAIRS, len(good) * len(bad) * 4)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = z[draw.choice(good, n)] - z[draw.choice(bad, n)]
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + 5e-4 * (w @ w)
    w = model.weight * x.std(axis=0)
    assert all(loss(w + s * 1e-3 * e) > loss(w) for e in np.eye(4) for s in (-1, 1))
    s = model.scores(x)
    assert abs((s < quality.CUT).mean() - len(bad) / len(y)) < 0.02 and np.corrcoef(s >= quality.CUT, y)[0, 1] > 0.5


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_learns_labels_that_lie_in_words_alone(spark):
    """Texts of one form, good and bad by which of two sets of equally long words they draw most from."""
    rng = np.random.Generator(np.random.PCG64(11))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    kinds = ["".join(rng.choice(letters, 5)) for _ in range(40)]
    y = {i: int(rng.random() < 0.7) for i in range(600)}
    rows = [(i, " ".join(kinds[int(rng.integers(20)) + (20 if rng.random() < (0.7 if v else 0.3) else 0)] for _ in range(60))) for i, v in y.items()]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(y.items()), "doc_id long, quality int")).collect()
    held = [r["predicted"] == y[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 80 and sum(held) / len(held) > 0.9


def test_letter_profile_is_that_of_all_windows(monkeypatch):
    text = "a née text of some length, as long as that".encode() * 50
    want = quality.letter_profile(text)
    monkeypatch.setattr(quality, "WINDOW_BYTES", 7)
    assert quality.letter_profile(text) == want and sum(x * x for x in want) == pytest.approx(1)
    for short in (b"", b"a", b"ab"):
        assert quality.letter_profile(short) == [0.0] * quality.PLACES


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b", 9), (2, "", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert len(quality.quality(docs, labels).collect()) == 4
    assert len(quality.quality(docs, labels.limit(0)).collect()) == 4
    assert quality.quality(docs.limit(0), labels).count() == 0
