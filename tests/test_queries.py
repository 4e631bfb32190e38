import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import consolidate as cx
from palimpsest.operators import lifecycle as lx
from palimpsest.plans import queries as q
from palimpsest.sources import exports as ex


def tables(spark, folder, docs):
    """documents of the texts, numbered from 0, and a vector for each."""
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(len(docs))], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_hybrid_search_ranks_the_facts_of_what_it_searches(spark, tmp_path):
    d = tables(spark, tmp_path, ["nothing here", "Decided: lichen wins the vote", "only words"])
    assert {r["channel"]: r["n"] for r in q.hybrid_channel_counts(spark, d).collect()} == {"fts": 1, "facts": 1, "vector": 3}
    scores = {r["id"]: r["score"] for r in q.rrf_fuse(spark, d).collect()}
    assert abs(scores["d000001"] - (1 / 60 + 1 / 60 + 1 / 61)) < 1e-8  # first by text and by fact, second by vector
    assert q.hybrid_search(spark, d).orderBy("rank").first()["id"] == "d000001"


def test_turns_are_kept_whole_up_to_the_library_limit(spark, tmp_path):
    d = tables(spark, tmp_path, ["x" * 2001, "y" * 32_768, "z" * 32_769])
    n = {r["id"]: r["n"] for r in q.normalize_turns(spark, d).collect()}
    # The projection adds a credential of 35 characters to the first, a bearer of 28 to the second.
    assert n["d000000"] == 2001 + 35 and n["d000002"] == 32_768 + len("\n[truncated 1 characters]")
    assert n["d000001"] == 32_768 + len("\n[truncated 28 characters]")


def test_the_cut_of_a_turn(spark):
    df = spark.createDataFrame([("abcde",), ("abcdef",)], "t string").select(tx.normalized(F.col("t"), 5).alias("n"))
    assert [r["n"] for r in df.collect()] == ["abcde", "abcde\n[truncated 1 characters]"]


def test_all_rows_are_ranked(spark, tmp_path):
    rows = [(i, None if i % 4 == 0 else float(i * 7919 % 500)) for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["event_id"], r["value"]) for r in q.grid_sort(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [r["rank"] for r in q.grid_sort(spark, str(tmp_path)).orderBy("rank").collect()] == list(range(1000))


def test_new_vectors_come_from_the_whole_table(spark, tmp_path):
    spark.createDataFrame([(i, [float(i)]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["memory_id"]: r["model"] for r in q.vector_upsert(spark, str(tmp_path)).collect()}
    assert got == {f"d{i:06d}": "n" if i % 3 == 0 else "m" for i in range(300)}


def test_groups_and_archives_are_taken_apart_into_rows(spark, monkeypatch):
    """No group or scope is collected, and the rows are those that the whole document or list gives."""
    rows = [(f"{i:02d}", "a{b", f"s{i % 2}", "user", "Same @text\n@bye\n" + "more" * (i % 3), f"2024-01-01T00:00:{i % 5:02d}.000Z", None, None) for i in range(40)]
    m = spark.createDataFrame(rows, "id string, agent string, scope string, role string, content string, created_at string, rule_id string, valid_to string")
    q.ready(spark)
    whole = {tuple(r) for r in ex.texinfo(lx.archive(m).select(F.col("scope").alias("name"), F.col("document").alias("text"))).collect()}
    lists = {(r["scope"], r["winner"], x) for r in cx.dedup_groups(m).collect() for x in r["losers"].split(",")}
    monkeypatch.setattr(F, "collect_list", lambda *_: pytest.fail("a group is collected"))
    got = ex.texinfo_chapters(lx.chapters(m).withColumnRenamed("scope", "name")).collect()
    assert len(got) == 40 and {tuple(r) for r in got} == whole
    assert {tuple(r) for r in cx.dedup_losers(m).collect()} == lists and len(lists) == 34


def test_queries_collect_no_scope_or_group(spark, small, monkeypatch):
    monkeypatch.setattr(F, "collect_list", lambda *_: pytest.fail("a group is collected"))
    assert q.import_texinfo(spark, small).columns == ["name", "nth", "agent", "role", "created_at", "digest"]
    assert q.dedup_apply(spark, small).columns == ["id", "scope", "valid_to", "superseded_by"]


def turns(spark, folder, rows):
    """conversations of rows (conv_id, turn, role, text)."""
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_rules_of_late_conversations(spark, tmp_path):
    """Conversation 777 begins behind the instant of its later events."""
    d = turns(spark, tmp_path, [(777, 0, "system", "groß"), (749, 0, "system", "only once")])
    got = {r["rule_id"]: (r["text"], r["created_at"], r["updated_at"], r["status"]) for r in q.rule_fold(spark, d).collect()}
    assert got == {"r000777": ("GROẞ", "2024-02-02T09:00:00.000Z", q.NOW, "active"), "r000749": ("only once", "2024-02-01T05:00:00.000Z", q.NOW, "retired")}


def test_reworded_rules_of_late_conversations(spark, tmp_path):
    d = turns(spark, tmp_path, [(777, 0, "system", "once"), (777, 1, "user", "more")])
    got = {r["id"]: r["updated_at"] for r in q.store_now(spark, d).collect()}
    assert got == {"c000777-000": q.NOW, "c000777-001": None}
