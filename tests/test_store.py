import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import postings as pi
from palimpsest.operators import search as sx
from palimpsest.operators import store as st
from palimpsest.plans import queries as q

NOW, LATER = "2024-02-01T00:00:00.000Z", "2024-02-02T00:00:00.000Z"
WORDS = [f"w{i}" for i in range(30)] + ["boot_magic", "élan", "the"]


def texts(rng, n, start=0):
    return [(f"m{i:04}", " ".join(rng.choice(WORDS[: rng.choice((4, 33))]) for _ in range(rng.choice((0, 3, 3, 12, 60))))) for i in range(start, start + n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, content string").withColumns({"agent": F.lit("a"), "scope": F.when(F.substring("id", -1, 1) < "5", "s").otherwise("t"), "role": F.lit("user"), "created_at": F.lit("2024-01-01T00:00:00.000Z")})


def found(index, query):
    return {r["id"]: round(r["score"], 9) for r in pi.scored(index, query).collect()}


QUERIES = ("w1 w2", "boot_magic w3", "the-w1 élan", "absent", "w0")


def files_of(index):
    return {s.path: sorted(x for x in __import__("os").listdir(s.path)) for s in index.segments}


def test_an_index_kept_in_step_equals_one_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pi, "BLOCK_TEXTS", 5)
    rng = random.Random(3)
    now = dict(texts(rng, 40))
    df = lambda rows: spark.createDataFrame(list(rows), "id string, text string")
    index = pi.Index(spark, str(tmp_path / "i")).changed(df(now.items()))
    for step in range(4):
        added = dict(texts(rng, 8, 100 + 10 * step))
        reworded = {i: t for (i, _), (_, t) in zip(rng.sample(sorted(now.items()), 5), texts(rng, 5), strict=True)}
        gone = {i: now[i] for i in rng.sample(sorted(set(now) - set(reworded)), 4)}
        before = files_of(index)
        index = index.changed(df([*added.items(), *reworded.items()]), df([*gone.items(), *[(i, now[i]) for i in reworded]]))
        assert all(files_of(index)[p] == names for p, names in before.items()) and len(index.segments) == step + 2
        now = {i: t for i, t in (now | added | reworded).items() if i not in gone}
        if step % 2:
            anew = pi.Index(spark, str(tmp_path / f"anew{step}")).changed(df(now.items()))
            assert (index.every, index.mean) == (anew.every, anew.mean)
            assert all(found(index, x) == found(anew, x) for x in QUERIES)
    for late in (2, 5):
        merged = index.joined(late)
        assert len(merged.segments) == 6 - late and (merged.every, merged.mean) == (index.every, index.mean)
        assert all(found(merged, x) == found(index, x) for x in QUERIES)
    assert merged.dead() is None
    assert index.changed(df([]), df([])) == index


def test_ranked_search_reads_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pi, "BLOCK_TEXTS", 10)
    monkeypatch.setattr(pi, "FIRST_BLOCKS", 4)
    rng = random.Random(5)
    rows = [(f"m{i:04}", ("rare " if i % 40 == 0 else "") + "word " * (rng.choice((1, 2, 5)) if i % 5 < 2 else 0) + "filler " * rng.choice((2, 5, 20, 60, 200))) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, content string")
    index = pi.build(df, str(tmp_path / "i"))
    for query, k in (("word", 5), ("rare word", 5), ("word filler", 6), ("word_filler rare", 3)):
        ranking = pi.Ranking.of(index, query)
        rows_of = lambda d: [tuple(r) for r in d.select("id", F.round("score", 10).alias("s")).orderBy(F.desc("s"), "id").limit(k).collect()]  # noqa: B023, E731
        some, blocks = ranking.best(k)
        assert rows_of(some) == rows_of(ranking.scored())
        assert len(blocks) < ranking.bounds().count() / 2, query
        alive = df.where("id > 'm0300'").select("id")
        assert rows_of(ranking.best(k, alive)[0]) == rows_of(ranking.scored().join(alive, "id"))


def test_commits_and_their_index(spark, tmp_path):
    rng = random.Random(7)
    s = st.Store(spark, str(tmp_path / "s"))
    assert s.memories().count() == 0 and sx.search(s.memories(), "w1", index=s.index()).count() == 0
    s.ingest(frame(spark, texts(rng, 20)))
    s.ingest(frame(spark, texts(rng, 30)))  # ten are new
    assert s.memories().count() == 30 and s.version().number == 2
    assert s.ingest(frame(spark, texts(rng, 30))).number == 2  # nothing is
    asked = spark.createDataFrame([("m0001", "s", "m0002"), ("m0001", "s", "m0003"), ("m0007", "s", "m0002"), ("m0099", "s", "m0001")], "target string, scope string, superseded_by string")
    segments = s.version().segments
    s.supersede(asked, NOW)
    assert s.version().segments == segments  # no text has changed
    closed = {r["id"]: (r["valid_to"], r["superseded_by"]) for r in s.memories().where("valid_to IS NOT NULL").collect()}
    assert closed == {"m0001": (NOW, "m0002")}  # m0007 is of another scope, m0099 isn't there
    s.supersede(asked, LATER)
    assert s.version().number == 3
    s.touch(spark.createDataFrame([("m0002", NOW), ("m0002", LATER), ("gone", NOW)], "id string, ts string"))
    s.touch(spark.createDataFrame([("m0002", NOW)], "id string, ts string"))
    r = s.memories().where("id = 'm0002'").first()
    assert (r["access_count"], r["last_accessed_at"]) == (3, LATER)
    s.remember(spark.createDataFrame([("a", "s", "user", "w1 new words")], "agent string, scope string, role string, content string"), NOW)
    s.forget(spark.createDataFrame([("m0003",), ("m0004",)], "id string"))
    s.rescope("t", "u")
    event = lambda *e: spark.createDataFrame([("s", *x) for x in e], "scope string, rule_id string, agent string, op string, text string, ts string, seq int")
    s.set_rules(event(("k", "me", "add", "the first wording w1", NOW, 1), ("p", "me", "add", "x", NOW, 2)))
    s.set_rules(event(("k", "me", "add", "the élan wording", LATER, 1), ("p", "me", "retire", None, LATER, 2), ("p", "me", "purge", None, LATER, 3)))
    rules = s.memories().where("rule_id IS NOT NULL").collect()
    assert [(r["rule_id"], r["content"], r["created_at"], r["updated_at"], r["status"]) for r in rules] == [("k", "the élan wording", NOW, LATER, "active")]
    anew = pi.build(s.memories(), str(tmp_path / "anew"))
    assert all(found(s.index(), x) == found(anew, x) for x in QUERIES)
    assert s.memories(2).count() == 30 and s.memories(2).where("valid_to IS NOT NULL").count() == 0  # as it was
    before = sorted(map(str, s.memories().collect()))
    s.compact()
    assert sorted(map(str, s.memories().collect())) == before and len(s.version().changes) == 1
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    for validity, folders in ((sx.CURRENT, {"open"}), (sx.Validity(as_of=NOW), {"open"}), (sx.Validity(as_of="2024-01-05T00:00:00Z"), {"open", "2024-02"}), (st.ALL, {"open", "2024-02"})):
        got = s.memories(validity=validity)
        assert sorted(map(str, got.collect())) == sorted(map(str, s.memories().where(validity.holds()).collect()))
        assert {f.split("closed=")[1].split("/")[0] for f in files(got)} == folders
    assert "PartitionFilters: [isnotnull(closed" in s.memories(validity=sx.CURRENT)._jdf.queryExecution().executedPlan().toString()
    s.ingest(frame(spark, [("z", "w1 z")]))
    assert s.memories(validity=sx.CURRENT).where("id = 'z'").count() == 1


def test_of_two_writers_one_starts_over(spark, tmp_path):
    a, b = (st.Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.ingest(frame(spark, [("1", "one"), ("2", "two")]))
    tries = []

    def change(old):
        tries.append(old.count())
        if len(tries) == 1:  # meanwhile another writer commits
            b.ingest(frame(spark, [("3", "three")]))
        return old.withColumn("access_count", F.lit(9))

    assert a.commit(change).number == 3 and tries == [2, 3]
    assert [r["access_count"] for r in a.memories().collect()] == [9, 9, 9] and a.memories(2).where("access_count = 9").count() == 0
    assert found(a.index(), "three") == found(pi.build(a.memories(), str(tmp_path / "anew")), "three")

    def always_second(old):
        b.ingest(frame(spark, [(f"x{b.version().number}", "x")]))
        return old.withColumn("access_count", F.lit(1))

    with pytest.raises(st.Conflict):
        a.commit(always_second, tries=2)
    assert a.memories().where("access_count = 1").count() == 0


def test_queries_see_tables_that_are_written_anew(spark, tmp_path):
    def write(texts):
        rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        # The same name of a file, as other writers give it.
        folder = tmp_path / "documents.parquet"
        [part] = folder.glob("part-*.parquet")
        part.rename(folder / "data.parquet")
        for crc in folder.glob(".*.crc"):
            crc.unlink()

    write(["thing lichen", "nothing"] * 20)
    assert q.fts_match(spark, str(tmp_path)).count() == 20
    write(["thing", "other words and more of them"])
    assert [r["id"] for r in q.fts_match(spark, str(tmp_path)).collect()] == ["d000000"]
    assert [r["id"] for r in q.fts_search(spark, str(tmp_path)).collect()] == ["d000000"]


def test_no_join_of_a_store_or_its_index_goes_through_the_driver(spark, tmp_path):
    """What grows with the memories is shuffled, though these are few."""
    rng = random.Random(9)
    s = st.Store(spark, str(tmp_path / "s"))
    s.ingest(frame(spark, texts(rng, 20)))
    s.forget(spark.createDataFrame([("m0003",)], "id string"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(s.memories()) and "SortMergeJoin" in plan(s.memories())
    rows = s.index().postings(["w1", "w2"])
    assert "BroadcastHashJoin" not in plan(rows) and "SortMergeJoin" in plan(rows)
