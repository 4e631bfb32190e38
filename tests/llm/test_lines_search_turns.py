import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import conversations as cv
from palimpsest.llm import lexical as lx
from palimpsest.llm import line_dedup as ld

# --- line dedup


def test_perfect_hash_has_no_gaps_and_knows_its_own(monkeypatch):
    rng = np.random.default_rng(5)
    for n, levels in ((0, 24), (1, 24), (63, 24), (5000, 24), (300, 1)):
        monkeypatch.setattr(ld, "LEVELS", levels)
        h, g = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        if n > 100:
            h[:50] = h[0]  # the same first half
        table = ld.PerfectHash.of(h, g)
        assert sorted(table.places(h, g)) == list(range(n))
        assert levels > 1 or len(table.rest)
        names = ("levels", "rest", "marks", "counts", "owners")
        shard = dict(zip(names, ld.packed(h, g, np.arange(n) + 2, np.arange(n) * 7), strict=True))
        if n:
            there, counts, owners = ld.found(shard, h, g)
            assert there.all() and (counts == np.arange(n) + 2).all() and (owners == np.arange(n) * 7).all()
            assert not ld.found(shard, *rng.integers(0, 2**64, (2, 5000), dtype=np.uint64))[0].any()


def brute_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or i == min(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("keys,visits", [(1 << 12, 1 << 14), (3, 5)])
def test_lines_against_brute_force(spark, monkeypatch, keys, visits):
    monkeypatch.setattr(ld, "SHARD_KEYS", keys)
    monkeypatch.setattr(ld, "COPY_VISITS", visits)
    rng = random.Random(keys)
    pool = ["A common line here", "a COMMON line here\r", "\t the same passage \x0b", "the same passage", "short", "ééééééééé", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "", "\xa0nbsp stays on it", "nbsp stays on it"] + [f"line number {i:04}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(None, "A common line here\nx"), (7, rows[7][1]), (7, "line number 0001\nA common line here"), (100, None), (101, ""), (102, "\n\n"), (103, "A common line here\n" * 20_000 + "z" * 300_000), (-5, "line number 0002")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, gone int")
    got = [tuple(r) for r in ld.without_repeats(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows)))
    assert ld.without_repeats(df.limit(0)).count() == 0


# --- ranked lexical search


def brute_search(docs, items, k):
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    every, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for i, c in rows:
            m = 75 + 25 * sum(c.values()) * every // length
            s = sum(n * math.floor(1000 * math.log((2 * every + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, n in q.items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("docs_of,sent", [(4096, 200_000), (3, 4)])
def test_search_against_brute_force(spark, monkeypatch, docs_of, sent):
    monkeypatch.setattr(lx, "BLOCK_DOCS", docs_of)
    monkeypatch.setattr(lx, "SENT_TERMS", sent)
    rng = random.Random(docs_of)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "é", "x_y", "日本語", "A1b"]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice((5, 45))]) for _ in range(rng.choice((1, 5, 5, 40))))
    docs = [(i, text()) for i in range(150)] + [(200 + i, "w1 w2 w3") for i in range(30)]
    docs += [(None, "w1 w2 w3"), (5, "w1, W2; w3"), (500, None), (501, "-- \t"), (502, "w7 " * 50_000 + "rare"), (503, "w1\x00w2")]
    items = [(i, text()) for i in range(9)] + [(20, None), (21, "..."), (22, "unknown-word"), (None, "w1"), (23, "w1 w1 w1 w2"), (24, "rare w7"), (25, "w1"), (25, "w2 w3"), (26, " ".join(vocabulary * 3))]
    d = spark.createDataFrame([(i, t, 0, 1) for i, t in docs], "doc_id long, text string, m int, terms int")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in lx.ranked(d, q, k=7).collect()), key=str)
    assert got == brute_search(docs, items, 7)
    assert lx.ranked(d.limit(0), q).count() == 0 and lx.ranked(d, q.limit(0)).count() == 0


def test_an_index_of_all_terms_serves_any_items(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    whole = lx.index(docs)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    assert sorted(lx.search(whole, items).collect()) == sorted(lx.ranked(docs, items).collect())


def test_bounds_spare_visits():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    wanted = lx.Wanted(np.array([1]), np.array([0, 2]), np.array([0, 1]), np.array([1, 2]), np.array([10, 20]), np.array([3000, 50]), 5)
    blocks = []
    for m in range(75, 175):  # only the first strata hold the weighty term
        n = 30
        terms = [[10, 20] if m < 80 else [20] for _ in range(n)]
        tfs = [rng.integers(1, 5, len(t)).tolist() for t in terms]
        b = lx.block_of(m, 0, np.arange(n) * 1000 + m, pa.array(terms, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int32())))
        blocks.append(lx.Block({c: b.column(c)[0].values.to_numpy() for c in lx.COLUMNS}, m, wanted))
    best = [lx.Best(5)]
    assert lx.visited(blocks, wanted, best) <= 5
    every = sorted(((-s, i) for b in blocks for s, i in zip(*b.scores(wanted, 0), strict=True)))[:5]
    assert [(-s, i) for s, i in zip(best[0].scores, best[0].ids, strict=True)] == every


# --- conversation repair


def brute_repair(rows):
    """The lightest (cost, audit) by going through all ways of up to two new rows before, between and after rows; rows: (initial, fault)."""
    best = None
    ways = [[("D", None)] if f in (cv.BLANK, cv.DUPLICATE) else [("D", None), ("K", i or "?"), ("R", "u"), ("R", "a")] for i, f in rows]
    gaps = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    for choice in itertools.product(*ways):
        for new in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k, g in enumerate(new):
                roles, audit, cost = roles + "".join(g), audit + "I" * len(g), cost + 2 * len(g)
                if k < len(rows):
                    letter, role = choice[k]
                    audit += letter
                    roles += role or ""
                    cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and rows[k][1] == cv.TRUNCATED)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def repair(rows):
    r, audit, roles = cv.Repair(), "", ""
    for part in (*rows, None):
        for letter, _, role, _ in r.end() if part is None else r.row(0, part[0], "t", part[1]):
            audit += letter
            roles += "" if letter == "D" else role[0]
    assert re.fullmatch("(s?(ua)+)?", roles)
    return r.cost, audit


def test_repair_against_all_ways(monkeypatch):
    rng = random.Random(4)
    for n in range(400):
        rows = [(rng.choice("uuaasx"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 3) if n else 0)]
        want = brute_repair(rows)
        for size in (64, 1, 2):
            monkeypatch.setattr(cv, "BLOCK_ROWS", size)
            assert repair(rows) == want, rows


def test_block_size_changes_nothing(monkeypatch):
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("uuuaaas"), rng.choice((0, 0, 1, 2, 3))) for _ in range(rng.randint(10, 80))]
        got = set()
        for size in (1, 3, 7, 1000):
            monkeypatch.setattr(cv, "BLOCK_ROWS", size)
            got.add(repair(rows))
        assert len(got) == 1


def test_a_long_conversation_stays_in_bounded_memory():
    r, most, n = cv.Repair(), 0, 0
    rng = random.Random(1)
    for i in range(30_000):
        n += sum(1 for _ in r.row(i, rng.choice(("user", "assistant", "system")), "t.", rng.choice((0, 0, 1))))
        most = max(most, len(r.held))
    assert most <= 4 * cv.BLOCK_ROWS and n > 25_000


def brute_reports(rows):
    crc = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for c, t, role, text in rows:
            if c == conv and (code := crc(c, t)) != 0:
                role, text = " " if role is None else role, " " if text is None else text
                text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
                mine += [(t is not None, t or 0, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        mine.sort()
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for there, t, _, _ in mine if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = brute_repair([(m[2][:1], f) for m, f in zip(mine, faults, strict=True)])
        lines, at, said = [], 0, ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else mine[at][2:]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else "assistant" if said.endswith("u") else "user"
                said += role[0]
                lines.append(f"{role}:{text}")
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_reports_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No", "What? ", "  ", "", None, "é!", "Yes.", "x\x0b"]
    rows = [(c, t, rng.choice(("user", "assistant", "system", "tool", "", None)), rng.choice(texts)) for c in range(60) for t in rng.sample((0, 1, 2, 5, None), rng.randint(1, 3))]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone."), (None, 1, "user", "who."), (None, None, None, None), (70, 3, "user", "Same."), (70, 3, "user", "Same."), (71, 0, "user", "z" * 400_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, fault int, copy int")
    turns = cv.damaged(df)
    got = sorted((tuple(r) for r in cv.reports(turns).collect()), key=str)
    assert got == brute_reports(rows)
    assert next(r for r in got if r[0] == dropped) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cv.reports(cv.damaged(df.limit(0))).count() == 0 == cv.repaired(cv.damaged(df.limit(0))).count()
    edits = {}
    for r in cv.repaired(turns).orderBy("conv_id", "place").collect():
        edits.setdefault(r["conv_id"], []).append(r)
    for r in got:
        mine = edits.get(r[0], [])
        assert "".join(e["edit"] for e in mine) == r[7]
        assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in mine if e["edit"] != "D").encode()).hexdigest() == r[8]
