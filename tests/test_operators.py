import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import consolidate as cx
from palimpsest.operators import facts as fx
from palimpsest.operators import fuse as ux
from palimpsest.operators import lifecycle as lx
from palimpsest.operators import postings as px
from palimpsest.operators import search as sx
from palimpsest.operators import vectors as vx
from palimpsest.sources.projections import MEMORY


def memories(spark, *rows):
    """Rows (id, content) and any other columns as a dict."""
    full = []
    for i, (ident, content, *more) in enumerate(rows):
        r = {"id": ident, "agent": "a", "scope": "s", "role": "note", "content": content, "created_at": f"2024-01-01T00:00:{i:02d}.000Z"} | (more[0] if more else {})
        full.append(tuple(r.get(c) for c in MEMORY))
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in MEMORY))


def test_time_travel(spark):
    a, b = "2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z"
    m = memories(spark, ("1", "old", {"valid_to": b, "superseded_by": "2"}), ("2", "new", {"created_at": b}))
    at = lambda v: [r["id"] for r in sx.recall(m, "s", validity=v).orderBy("place").collect()]
    assert at(sx.CURRENT) == ["2"] and at(sx.Validity(all=True)) == ["1", "2"]
    assert at(sx.Validity(as_of=a)) == ["1"] and at(sx.Validity(as_of=b)) == ["2"] and at(sx.Validity(as_of="2023-01-01T00:00:00.000Z")) == []
    with pytest.raises(ValueError):
        sx.Validity(as_of=a, all=True)


def test_packing_passes_over_and_goes_on(spark):
    m = memories(spark, ("1", "x" * 40), ("2", "x" * 400), ("3", "x" * 20))
    done = {r["id"]: r["included"] for r in ux.budget_recall(m, "s", 15).collect()}
    assert done == {"3": True, "2": False, "1": True}
    assert not any(r["included"] for r in ux.budget_recall(m, "s", 0).collect())


def test_rules_come_first_even_beyond_the_budget(spark):
    m = memories(spark, ("r", "y" * 400, {"role": "rule", "rule_id": "k"}), ("1", "x" * 40))
    rules, rows = ux.context(m, fx.extract(m), "s", 20)
    assert [r["id"] for r in rules.collect()] == ["r"] and [r["included"] for r in rows.collect()] == [False]


def test_fusion(spark):
    df = lambda *x: spark.createDataFrame(list(x), "id string, rank int")
    a, b = df(("x", 0), ("y", 1)), df(("y", 0), ("z", 1))
    got = {r["id"]: r["score"] for r in ux.fuse({"a": a, "b": b}).collect()}
    assert got == pytest.approx({"x": 1 / 60, "y": 1 / 61 + 1 / 60, "z": 1 / 61})
    assert got == pytest.approx({r["id"]: r["score"] for r in ux.fuse({"b": b, "a": a}).collect()})


def test_facts(spark):
    text = "Intro. Decided: use one table.\n- TODO write the tests\n* note: short\nMust go. Never mind the gap\r\nTODO x\nDecided: use one table."
    got = spark.createDataFrame([(text,)], "t string").select(fx.facts_of(F.col("t")).alias("f")).first()["f"]
    assert got == ["Decided: use one table.", "TODO write the tests", "Must go. Never mind the gap", "Never mind the gap"]  # "note: short" has 11 characters


def test_duplicates_and_their_winner(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    m = memories(spark, ("1", "Same  Text"), ("2", "same text"), ("3", "other"), ("4", "SAME TEXT", {"scope": "t"}), ("5", "same\ttext"))
    groups = cx.dedup_groups(m)
    assert [(r["winner"], r["losers"], r["detectors"]) for r in groups.collect()] == [("5", "1,2", "exact")]
    after = cx.dedup_applied(m, groups, "2024-02-01T00:00:00.000Z")
    assert cx.dedup_groups(after).count() == 0  # a second run finds none


def test_vector_twins_within_scope(spark, monkeypatch):
    monkeypatch.setattr(vx, "BLOCK_ROWS", 2)
    m = memories(spark, ("1", "a"), ("2", "b"), ("3", "c"), ("4", "d", {"scope": "t"}), ("5", "e"))
    v = spark.createDataFrame([("1", "m", [1.0, 0.0]), ("2", "m", [1.0, 0.1]), ("3", "m", [1.0, 0.0]), ("4", "m", [1.0, 0.0]), ("5", "m", [0.0, 0.0])], "memory_id string, model string, embedding array<double>")
    got = {(r["a"], r["b"]) for r in vx.twin_edges(v, m, "m").collect()}
    assert got == {("1", "3"), ("1", "2")}
    assert vx.unindexed(m, v, "n").count() == 5 and vx.unindexed(m, v, "m").count() == 0


def test_vector_pairs_of_copies_and_their_neighbours(spark, monkeypatch):
    """Every pair: two copies of one vector, three of a near one, and zero vectors, which are like nothing."""
    monkeypatch.setattr(vx, "PART_ROWS", 2)
    m = memories(spark, *[(str(i), "x") for i in range(9)])
    given = [[1.0, 0.0], [1.0, 0.1], [1.0, 0.0], [1.0, 0.1], [1.0, 0.1], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.1, 1.0]]
    v = spark.createDataFrame([(str(i), "m", x) for i, x in enumerate(given)], "memory_id string, model string, embedding array<double>")
    got = sorted((r["a"], r["b"]) for r in vx.twin_pairs(v, m, "m").collect())
    assert got == [(str(i), str(j)) for i in range(5) for j in range(i + 1, 5)] + [("5", "8")]


def test_contradictions(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    copies = memories(spark, *[(f"{i:02d}", "the build uses gcc" if i % 2 else "the build never uses  gcc") for i in range(30)])
    assert [(r["a"], r["b"], r["negated"]) for r in cx.contradictions(copies).collect()] == [("00", "01", "00")]  # one pair, not 225
    assert {(r["class"], r["id"]) for r in cx.word_classes(copies)[1].collect()} == {("01" if i % 2 else "00", f"{i:02d}") for i in range(30)}
    m = memories(spark, ("1", "the build uses gcc"), ("2", "the build does not use gcc"), ("3", "the build never uses gcc"), ("4", "unrelated words here"), ("5", "the build never uses gcc", {"scope": "t"}))
    got = {(r["a"], r["b"], r["negated"], round(r["jaccard"], 3)) for r in cx.contradictions(m).collect()}
    assert got == {("1", "3", "3", 0.8)}


def test_contradictions_equal_all_pairs_and_few_others_meet(spark):
    """Sets of 6 to 300 words at all degrees of likeness: the pairs are those of brute force, and most others end at their parities."""
    import random

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rnd = random.Random(5)
    texts = []
    for k in range(80):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([6, 20, 80, 300]))]
        texts += [base, [w if rnd.random() > 0.1 * (k % 9) else f"x{rnd.randrange(4000)}" for w in base]]
    sets = [set(t) for t in texts]
    texts = [" ".join(t) if i % 2 else "never " + " ".join(t) for i, t in enumerate(texts)]
    sets = [s if i % 2 else s | {"never"} for i, s in enumerate(sets)]
    want = {(i, j) for i in range(0, 160, 2) for j in range(1, 160, 2) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    m = memories(spark, *[(f"{i:03d}", t, {"created_at": f"2024-01-01T00:00:00.{i:03d}Z"}) for i, t in enumerate(texts)])
    got = {(int(r["negated"]), int(r["b"] if r["a"] == r["negated"] else r["a"])) for r in cx.contradictions(m).collect()}
    assert got == want and len(want) > 30
    pairs = cx.likely_pairs(cx.word_classes(m)[0], 50)
    assert len(want) <= pairs.count() < 2 * len(want)


def _shuffled(spark):
    """Bytes of all shuffles of the session so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_contradictions_move_sets_and_not_pairs(spark):
    """Sets of one vocabulary, where most share rare words: what is shuffled is a few times their words."""
    import random

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rnd = random.Random(7)
    texts = ["never " * (i % 2) + " ".join(f"word{rnd.randrange(1500)}" for _ in range(60)) for i in range(600)]
    m = memories(spark, *[(f"{i:03d}", t) for i, t in enumerate(texts)])
    before = _shuffled(spark)
    assert cx.contradictions(m).count() == 0
    assert _shuffled(spark) - before < 4 * sum(map(len, texts))


def test_contradictions_in_many_blocks(spark, monkeypatch):
    """Sets of 1 to 400 words in three scopes (one without a name, which meets nothing), cut into many blocks, some of sets of one size: the pairs are those of brute force."""
    import random

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(cx, "BLOCK_BYTES", 1000)
    rnd, texts = random.Random(3), []
    for k in range(120):
        base = rnd.sample(range(500), rnd.choice([1, 2, 5, 12, 12, 12, 40, 400]))
        texts += [base, [w if rnd.random() > 0.08 * (k % 7) else 600 + rnd.randrange(3000) for w in base]]
    texts = [{f"w{w}" for w in t} | ({"never"} if i % 2 else set()) for i, t in enumerate(texts)]
    scope = lambda i: ("s", "t", None)[i // 2 % 3]
    rows = [(f"{i:03d}", " ".join(sorted(t)) + " ", {"scope": scope(i), "created_at": f"2024-01-01T00:00:00.{i * 7 % 1000:03d}Z"}) for i, t in enumerate(texts)]
    rows += [(*rows[0][:2], rows[0][2])]  # a row twice is one
    like = {(i, j): len(texts[i] & texts[j]) / len(texts[i] | texts[j]) for i in range(1, 240, 2) for j in range(0, 240, 2) if scope(i) == scope(j) is not None}
    for percent in (50, 80):
        want = {(i, j): x for (i, j), x in like.items() if x >= percent / 100}
        got = cx.contradictions(memories(spark, *rows), percent).collect()
        assert len(got) == len(want) > 10 and {(int(r["negated"]), int(r["b"] if r["a"] == r["negated"] else r["a"])): r["jaccard"] for r in got} == want
        assert all(r["scope"] == scope(int(r["a"])) and int(r["a"]) * 7 % 1000 < int(r["b"]) * 7 % 1000 for r in got)
    sizes = cx.blocks_of(cx.word_classes(memories(spark, *rows))[0].where("scope IS NOT NULL"))
    blocks = {(r["scope"], r["neg"]): r["blocks"] for r in sizes.select("scope", "neg", "blocks").distinct().collect()}
    assert len(blocks) == 4 and min(blocks.values()) > 3
    assert cx.cells_of(sizes, 50).count() < 0.8 * sum(blocks[x, True] * blocks[x, False] for x in "st")  # blocks of unlike sizes don't meet


def test_pairs_leave_a_task_in_parts(monkeypatch):
    import pyarrow as pa

    from palimpsest.operators import overlap

    monkeypatch.setattr(overlap, "PAIRS_OUT", 50)
    rows = [(i % 2 == 1, f"{i:02d}", ("a b", "a b c", "c d e")[i % 3]) for i in range(40)]
    cell = pa.RecordBatch.from_pylist([{"scope": "s", "neg": neg, "n": len(t.split()), "class": c, "created_at": c, "text": t} for neg, c, t in rows])
    found = list(overlap.pairs_of(50)(iter([cell.slice(0, 15), cell.slice(15)])))
    assert len(found) > 3 and all(b.num_rows < 50 + 20 for b in found)
    sets = [(neg, c, set(t.split())) for neg, c, t in rows]
    want = {(p, q) for neg, p, x in sets if neg for other, q, y in sets if not other and 2 * len(x & y) >= len(x | y)}
    assert {(r["p"], r["q"]) for b in found for r in b.to_pylist()} == want and sum(b.num_rows for b in found) == len(want)


def test_ingest_twice_adds_nothing(spark):
    turns = memories(spark, ("1", "a"), ("2", "b"), ("2", "again")).withColumn("ordinal", F.monotonically_increasing_id())
    store = memories(spark, ("9", "z"))
    new = lx.insert_or_ignore(store, turns)
    assert {(r["id"], r["content"]) for r in new.collect()} == {("1", "a"), ("2", "b")}
    report = lx.ingest_report(store.unionByName(new.drop("ordinal")), turns, "s").first()
    assert (report["inserted"], report["skipped_existing"]) == (0, 3)


def test_rules_fold(spark):
    rows = [("s", "k", "a", "add", "one", "t1", 1), ("s", "k", "a", "retire", None, "t2", 2), ("s", "k", "b", "add", "two", "t3", 3), ("s", "p", "a", "add", "x", "t1", 1), ("s", "p", "a", "retire", None, "t2", 2), ("s", "p", "a", "purge", None, "t3", 3), ("s", "q", "a", "add", "x", "t1", 1), ("s", "q", "a", "purge", None, "t2", 2)]
    got = {r["rule_id"]: (r["text"], r["agent"], r["created_at"], r["updated_at"], r["status"]) for r in lx.rules(spark.createDataFrame(rows, "scope string, rule_id string, agent string, op string, text string, ts string, seq int")).collect()}
    assert got == {"k": ("two", "b", "t1", "t3", "active"), "q": ("x", "a", "t1", "t1", "active")}


def test_rules_fold_in_sequence_though_times_run_back(spark):
    rows = [("s", "k", "a", "add", "one", "t9", 1), ("s", "k", "a", "retire", None, "t2", 2), ("s", "k", "b", "add", "two", "t3", 3), ("s", "p", "a", "add", "x", "t9", 1), ("s", "p", "a", "retire", None, "t2", 2)]
    got = {r["rule_id"]: (r["text"], r["created_at"], r["updated_at"], r["status"]) for r in lx.rules(spark.createDataFrame(rows, "scope string, rule_id string, agent string, op string, text string, ts string, seq int")).collect()}
    assert got == {"k": ("two", "t9", "t3", "active"), "p": ("x", "t9", "t2", "retired")}


def test_index_scores_as_all_texts_do(spark, tmp_path):
    m = memories(spark, ("1", "the cat sat on the mat"), ("2", "boot_magic is on"), ("3", "boot magic magic boot magic"), ("4", "Élan vital, élan!"), ("5", ""), ("6", "the the the", {"scope": "t"}))
    index = px.build(m, str(tmp_path / "i"))
    for query in ("cat", "boot_magic", "elan the", "the-the boot", "absent", "cat cat", "--"):
        want = {r["id"]: round(r["score"], 9) for r in sx.scored(m, query).collect()}
        assert {r["id"]: round(r["score"], 9) for r in px.scored(index, query).collect()} == want, query
    both = [[(r["id"], r["rank"]) for r in sx.search(m, "the boot", scope="s", index=i).orderBy("rank").collect()] for i in (None, index)]
    assert both[0] == both[1] and len(both[0]) == 3
    plan = px.scored(index, "cat")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,cat)" in plan


def test_rescope_refuses_as_a_whole(spark):
    m = memories(spark, ("1", "a"), ("2", "b", {"rule_id": "k", "role": "rule"}), ("3", "c", {"scope": "t", "rule_id": "k", "role": "rule"}))
    where = lambda df: {r["id"]: r["scope"] for r in df.collect()}
    assert where(lx.rescoped(m, "s", "t")) == {"1": "s", "2": "s", "3": "t"}
    chosen = spark.createDataFrame([("1",), ("2",)], "id string")
    assert where(lx.rescoped(m, "s", "t", chosen)) == {"1": "t", "2": "s", "3": "t"}  # a selection moves no rule
    assert where(lx.rescoped(m, "s", "u")) == {"1": "u", "2": "u", "3": "t"}
    facts = spark.createDataFrame([("1", "s", "f"), ("3", "t", "g")], "memory_id string, scope string, fact string")
    assert {r["fact"]: r["scope"] for r in lx.facts_rescoped(facts, m, lx.rescoped(m, "s", "u")).collect()} == {"f": "u", "g": "t"}


def test_an_asked_for_hybrid_search_errs(spark):
    v = spark.createDataFrame([("1", "m", [1.0])], "memory_id string, model string, embedding array<double>")
    assert [ux.mode(v, "m"), ux.mode(v, "n"), ux.mode(v, "m", "fts"), ux.mode(v, "m", "hybrid")] == ["hybrid", "fts", "fts", "hybrid"]
    with pytest.raises(ux.NoVectors):
        ux.mode(v, "n", "hybrid")


def test_store_of_the_first_version(spark):
    old = spark.createDataFrame([("1", "a", "s", "user", "x", "t", "own")], "id string, agent string, scope string, role string, content string, created_at string, extra string")
    new = lx.migrated(old)
    assert new.columns == [*[c for c, _ in lx.MEMORY_SCHEMA], "extra"] and new.first()["access_count"] is None
    assert lx.migrated(new).columns == new.columns
    with pytest.raises(ValueError):
        lx.migrated(old.drop("scope"))


def test_vector_codec(spark):
    import struct

    values = [0.5, -0.1, 0.0, 1e-40, 3.4e38, 1.0, -2.0, 0.99999994, float("inf"), float("-inf")]
    df = spark.createDataFrame([(values,), ([],)], "v array<float>").select(vx.encoded(F.col("v")).alias("b"), "v")
    rows = df.select("b", "v", vx.decoded(F.col("b")).alias("d"), vx.decoded(F.concat("b", F.lit(b"xyz"))).alias("rest")).collect()
    assert bytes(rows[0]["b"]) == struct.pack("<10f", *values) and all(r["d"] == r["v"] == r["rest"] for r in rows)


def test_vector_codec_of_zeros_and_no_numbers(spark):
    import math
    import struct

    df = spark.createDataFrame([([-0.0, 0.0, float("nan")],)], "v array<float>").select(vx.encoded(F.col("v")).alias("b"))
    r = df.select("b", vx.decoded(F.col("b")).alias("d")).first()
    assert bytes(r["b"]) == struct.pack("<2f", -0.0, 0.0) + bytes.fromhex("0000c07f")
    assert [math.copysign(1, x) for x in r["d"][:2]] == [-1, 1] and math.isnan(r["d"][2])
    payload = spark.createDataFrame([(bytearray.fromhex("010080ff"),)], "b binary").select(vx.decoded(F.col("b")).alias("d")).first()
    assert math.isnan(payload["d"][0])


def test_instants_are_parsed():
    from palimpsest.functions import times

    assert times.instant(" 2026-08-01T02:00:00.1239+02:00 ") == "2026-08-01T00:00:00.123Z" and times.instant("2026-08-01T00:00:00Z") == sx.Validity(as_of="2026-08-01T00:00:00Z").as_of
    for bad in ("yesterday", "2026-08-01", "2026-08-01T00:00:00", ""):
        with pytest.raises(ValueError):
            sx.Validity(as_of=bad)


def test_substrings_by_grams(spark, tmp_path):
    import random

    from palimpsest.operators import grams as gr

    rng = random.Random(9)
    rows = [(str(i), "".join(rng.choice("abAB \n.éÉ😀") for _ in range(rng.choice((0, 1, 2, 3, 30))))) for i in range(120)] + [("n", None), ("long", "ab" * 200_000 + "xyz")]
    df = spark.createDataFrame(rows, "id string, content string")
    grams = gr.build(df, str(tmp_path / "g"))
    for needle in ("a", "aB", "é", "É.", "aba", "a😀b", "\n", "abab", "ABXYZ", "zzz", "", "😀😀"):
        want = {i for i, t in rows if needle.lower() in (t or "").lower()}
        assert {r["id"] for r in gr.containing(grams, df, needle).collect()} == want, needle
    some = gr.candidates(grams, "abxyz").collect()
    assert [r["id"] for r in some] == ["long"]  # others aren't looked at


def test_trimming_is_linear(spark):
    import time

    text = "a" + " " * 400_000 + "b\u2003 \n"
    began = time.time()
    r = spark.createDataFrame([(text,)], "t string").select(tx.normalized(F.col("t"), 10**6).alias("n")).first()
    assert r["n"] == text[:-3] and time.time() - began < 20


def test_an_index_has_few_files_and_the_places_of_each_term(spark, tmp_path, monkeypatch):
    """Files are a few for each folder, whatever the tasks; before, each task wrote one into each folder."""
    monkeypatch.setattr(px, "BLOCK_TEXTS", 4)
    monkeypatch.setattr(px, "BUCKET_TERMS", 80)
    monkeypatch.setattr(px, "SLICE_TEXTS", 3)
    texts = [" ".join(f"w{i * j % 41}" for j in range(i % 30)) for i in range(200)] + ["", "?!", "Éa-éA", "one"]
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "id string, content string").repartition(3)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = px.build(df, str(tmp_path / "i"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    (s,) = index.segments
    assert s.buckets >= 10 and len(list((tmp_path / "i").rglob("postings/*/*.parquet"))) <= 8 * s.buckets
    got = {(r["term"], r["id"], r["n"]): r["at"] for r in index.table(s, "postings", px.POSTINGS).collect()}
    want = {}
    for i, t in enumerate(texts):
        words = ["ea", "ea"] if t.startswith("É") else [] if t == "?!" else t.split()
        for at, w in enumerate(words):
            want.setdefault((w, f"{i:03d}", len(words)), []).append(at)
    assert got == want and s.terms == sum(map(len, want.values()))


def test_an_index_sorts_what_is_nearly_sorted(spark, tmp_path, monkeypatch):
    """Each slice's rows come in the order of the files, however texts lie; before, they came text by text. Bounds need no places."""
    import pyarrow as pa

    monkeypatch.setattr(px, "SLICE_BYTES", 400)
    texts = [(f"{i * 7 % 60:02d}", i % 3, " ".join(f"w{i * j % 23}" for j in range(i % 20))) for i in range(60)] + [("long", 1, "ab " * 300 + "c"), ("none", 2, None)]
    batch = pa.RecordBatch.from_pylist([{"id": i, "block": b, "line": t} for i, b, t in texts])
    got = list(px.placed([batch], buckets=5))
    assert len(got) > 5
    for rows in (g.to_pylist() for g in got):
        order = [(px.bucket_of(r["term"], 5), r["term"], r["block"]) for r in rows]
        assert order == sorted(order)
    found = [((r["id"], r["term"]), (r["n"], r["at"])) for g in got for r in g.to_pylist()]
    want = {(i, w): (len(ws), [k for k, x in enumerate(ws) if x == w]) for i, _, t in texts if (ws := (t or "").split()) for w in ws}
    assert len(found) == len(want) and dict(found) == want
    index = px.build(spark.createDataFrame([(i, t) for i, _, t in texts], "id string, content string"), str(tmp_path / "i"))
    (s,) = index.segments
    places = spark.read.parquet(f"{s.path}/postings")
    assert places.where("times <> size(at)").isEmpty() and places.agg(F.sum("times")).first()[0] == s.terms == sum(len((t or "").split()) for _, _, t in texts)


def test_grams_are_grouped_before_they_are_dealt(spark, tmp_path, monkeypatch):
    """A row holds the ids of many texts; before, each gram of each text was a row."""
    from palimpsest.operators import grams as gr

    df = spark.createDataFrame([(f"{i:03d}", "Same 😀" + "x" * (i % 3)) for i in range(300)] + [("n", None)], "id string, content string").coalesce(1)
    grams = gr.build(df, str(tmp_path / "g"))
    places = spark.read.parquet(str(tmp_path / "g/places"))
    assert places.count() == places.select("gram").distinct().count()
    assert sorted(r["n"] for r in grams.table("counts", "n long").where(F.col("gram") == "sam").collect()) == [300]
    assert {r["id"] for r in gr.containing(grams, df, "😀XX").collect()} == {f"{i:03d}" for i in range(2, 300, 3)}


def test_duplicates_are_looked_for_once(spark):
    """Texts are normalised and pairs made once, however many parts of the groups need them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        seen.add(1)
        return x

    rows = [("a", "s", "One two", "t1"), ("b", "s", "one  two", "t2"), ("c", "s", "three", "t3"), ("d", "s", "four", "t4")]
    m = spark.createDataFrame(rows, "id string, scope string, text string, created_at string").select("id", "scope", "created_at", same("text").alias("content"), *[F.lit(None).cast("string").alias(c) for c in ("valid_to", "rule_id")])
    near = spark.createDataFrame([("s", "b", "c")], "scope string, a string, b string").select("scope", same("a").alias("a"), "b")
    got = [tuple(r) for r in cx.dedup_groups(m, near).collect()]
    assert got == [("s", "c", "a,b", "exact,vector")] and seen.value == len(rows) + 1
