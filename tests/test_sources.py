import json
import sqlite3

import pytest

from pyspark.sql import functions as F

from palimpsest.operators import lifecycle as lx
from palimpsest.sources import exports as ex
from palimpsest.sources import transcripts as tr
from palimpsest.streaming import ingest as si


def test_block_log_from_files(spark, tmp_path):
    rows = [
        {"type": "user", "uuid": "u1", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hello ghp_" + "A" * 20}},
        {"type": "assistant", "uuid": "u2", "timestamp": "2024-01-01T00:00:01Z", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "one"}, {"type": "tool_use", "name": "grep"}, {"type": "text", "text": "two"}]}},
        {"type": "summary"},
        {"type": "user", "uuid": "u3", "isMeta": True, "timestamp": "2024-01-01T00:00:01Z", "message": {"content": "x"}},
        {"type": "user", "uuid": "u4", "timestamp": "2024-01-01T00:00:02Z", "message": {"parts": [{"text": "untyped"}]}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"type": "us')
    turns = tr.block_log(tr.read_lines(spark, str(tmp_path)))
    assert [(r["role"], r["text"]) for r in tr.turns_only(turns).orderBy("line").collect()] == [("user", "hello [redacted:github-token]"), ("assistant", "one\n\ntwo"), ("user", "untyped")]
    assert {r["reason"]: r["n"] for r in tr.filter_stats(turns).collect()} == {"torn_line": 1, "non_message": 1, "meta": 1}
    assert tr.sessions(spark, str(tmp_path)).count() == 1


def test_chunks_and_their_open_end(spark):
    chunk = lambda kind, text: json.dumps({"method": "session/update", "timestamp": 1700000000, "params": {"update": {"sessionUpdate": kind, "content": {"type": "text", "text": text}}}})
    lines = [chunk("user_message_chunk", "a"), chunk("agent_message_chunk", "b"), chunk("agent_message_chunk", "c"), chunk("tool_call", "x"), chunk("agent_message_chunk", "d")]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "session string, line int, value string")
    got = [(r["role"], r["text"], r["created_at"], r["dropped"]) for r in tr.chunk_log(df).orderBy("line").collect()]
    assert got == [("user", "a", "2023-11-14T22:13:20.000Z", None), ("assistant", "bc", "2023-11-14T22:13:20.001Z", None), ("assistant", None, "2023-11-14T22:13:20.002Z", "pending")]


def test_relational_log(spark, tmp_path):
    path = str(tmp_path / "log.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE turns (session_id TEXT, turn_index INTEGER, user_message TEXT, assistant_response TEXT, timestamp TEXT)")
        c.executemany("INSERT INTO turns VALUES (?, ?, ?, ?, ?)", [("s", 0, "q", "a", "2024-01-01T00:00:00Z"), ("s", 1, "q2", None, None)])
    rows = tr.sqlite_table(spark, path, "SELECT session_id AS session, turn_index, user_message, assistant_response, timestamp AS at FROM turns", "session string, turn_index long, user_message string, assistant_response string, at string")
    got = {(r["source_id"], r["text"], r["dropped"]) for r in tr.paired_turns(rows).collect()}
    assert got == {("0:user", "q", None), ("0:assistant", "a", None), ("1:user", None, "bad_time"), ("1:assistant", None, "empty")}


def test_archive_comes_back(spark):
    rows = [("1", "me", "s", "user", "a @{b}\nline", "2024-01-01T00:00:00.000Z"), ("2", "you", "s", "assistant", "fine", "2024-01-01T00:00:01.000Z")]
    df = spark.createDataFrame(rows, "id string, agent string, scope string, role string, content string, created_at string")
    back = ex.texinfo(lx.archive(df).select(F.col("scope").alias("name"), F.col("document").alias("text")))
    assert [(r["agent"], r["role"], r["text"], r["created_at"]) for r in back.orderBy("nth").collect()] == [r[1:2] + r[3:] for r in rows]


def test_growing_log_is_taken_once(spark, tmp_path):
    log, store, state = (tmp_path / x for x in ("log", "store", "state"))
    log.mkdir()
    write = lambda name, *rows: (log / name).write_text("\n".join(json.dumps({"session": "s", "n": n, "text": f"t{n}"}) for n in rows))
    turns = lambda df: df.select("session", F.col("n").cast("string").alias("source_id"), F.lit("user").alias("role"), "text", F.lit("2024-01-01T00:00:00.000Z").alias("created_at"))
    run = lambda: si.ingest(spark, str(log), str(store), str(state), "session string, n int, text string", turns, "h", "scope")
    write("a.json", 1, 2, 2)
    run()
    write("b.json", 2, 3)  # a replay, and one new
    run()
    run()
    assert sorted(r["text"] for r in spark.read.parquet(str(store)).collect()) == ["t1", "t2", "t3"]


def exports(spark, text, anchor="2024-01-01 00:00:00"):
    return spark.createDataFrame([("f", text, anchor)], "name string, text string, anchor string")


def test_texinfo_markup_is_no_text(spark):
    text = "\\input texinfo\n@chapter Message by a@{b (user) at 2024-01-01T00:00:00Z\nhi @@c\n\n@c Signed by: x\n@chapter Chat history for y\n@bye\ntail\n@section Message by b (assistant) at 2024-01-01T01:00:00+01:00\nyes\n@chapter Message by b (assistant) at 2024-01-01T00:00:01Z\n \n"
    got = [tuple(r)[1:] for r in ex.texinfo(exports(spark, text)).orderBy("nth").collect()]
    assert got == [(0, "a{b", "user", "2024-01-01T00:00:00.000Z", "hi @c"), (1, "b", "assistant", "2024-01-01T00:00:00.000Z", "yes")]


def test_markdown_speakers_and_date(spark):
    text = "# T\n**Created:** 7/7/2026, 9:39:41 PM\n\n## User\n\nask\n## Root cause\n---\n## Assistant (Build · m · 3.2s)\nanswer\n## Users\nmore\n## User (x)\n \n"
    got = [(r["role"], r["text"], r["created_at"]) for r in ex.markdown(exports(spark, text)).orderBy("nth").collect()]
    assert got == [("user", "ask\n## Root cause", "2026-07-07T21:39:41.000Z"), ("assistant", "answer\n## Users\nmore", "2026-07-07T21:39:42.000Z")]
    for line, want in (("12:05:06 AM", "00:05:06"), ("12:05:06 PM", "12:05:06"), ("1:05 PM", "13:05:00")):
        df = spark.createDataFrame([(f"**Created:** 2/3/2024, {line}",)], "x string")
        assert str(df.select(ex.created(F.col("x")).alias("t")).first()["t"]) == f"2024-02-03 {want}"
    assert spark.createDataFrame([("**Created:** 13/13/2024, 1:00:00 PM",)], "x string").select(ex.created(F.col("x")).alias("t")).first()["t"] is None


def test_scrollback_chrome_ends_a_message(spark):
    text = "banner\n❯ ask\n  on\n⎿ output\n  more output\n● answer\n✻ Thinking\nstatus\n⏺ x\n●\n"
    got = [(r["role"], r["text"]) for r in ex.scrollback(exports(spark, text)).orderBy("nth").collect()]
    assert got == [("user", "ask on"), ("assistant", "answer")]


def test_files_are_walked_sized_and_recognised(spark, tmp_path):
    (tmp_path / "p" / "chat" / "2026").mkdir(parents=True)
    (tmp_path / "p" / "chat" / "2026" / "a.md").write_text("## User\nhi\n")
    (tmp_path / "p" / "chat" / "b.txt").write_text("❯ yo\n")
    found = ex.imported(ex.read_exports(spark, str(tmp_path), recursive=True)).collect()
    assert sorted((r["scope"], r["role"], r["text"]) for r in found) == [("p", "user", "hi"), ("p", "user", "yo")]
    forced = ex.imported(ex.read_exports(spark, str(tmp_path / "p" / "chat"), forced="scrollback"), scope="z").collect()
    assert [(r["scope"], r["text"]) for r in forced] == [("z", "yo")]
    with pytest.raises(Exception, match="too large"):
        ex.imported(ex.read_exports(spark, str(tmp_path), recursive=True, most_bytes=6)).collect()
    (tmp_path / "p" / "c.txt").write_text("nothing")
    with pytest.raises(Exception, match="not recognised"):
        ex.imported(ex.read_exports(spark, str(tmp_path), recursive=True)).collect()
    with pytest.raises(Exception, match="too large"):
        tr.read_lines(spark, str(tmp_path), most_bytes=6).collect()
    with pytest.raises(ValueError):
        ex.read_exports(spark, str(tmp_path), forced="pdf")


def test_each_database_is_read_once(spark, tmp_path):
    paths = []
    for n in range(3):
        paths.append(str(tmp_path / f"{n}.db"))
        with sqlite3.connect(paths[-1]) as c:
            c.execute("CREATE TABLE t (x INTEGER)")
            c.executemany("INSERT INTO t VALUES (?)", [(10 * n + k,) for k in range(5)])
    got = [r["x"] for r in tr.sqlite_table(spark, paths, "SELECT x FROM t", "x long").collect()]
    assert sorted(got) == [10 * n + k for n in range(3) for k in range(5)]


def test_steps(spark):
    step = lambda **k: json.dumps({"source": "s", "step_index": 1, "created_at": "2024-01-01T00:00:00Z", "status": "DONE"} | k)
    lines = [
        step(type="USER_INPUT", content="x <USER_REQUEST> ask </USER_REQUEST> y"), step(type="USER_INPUT", content="no tags"), step(type="PLANNER_RESPONSE", content="a", status="RUNNING"), step(type="PLANNER_RESPONSE", content="a"),
        step(content="a", type="PLANNER_RESPONSE"), step(type="PLANNER_RESPONSE", content="a", thinking="hm"), step(type="PLANNER_RESPONSE", content="a", tool_calls=[{"name": "f", "a": 1}]),
        step(type="PLANNER_RESPONSE", content="a", tool_calls=[{"a": 1, "name": "f"}]), step(type="VIEW_FILE", content="abc"), step(type="CHECKPOINT"), step(type="WHAT"), "{torn",
    ]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "session string, line int, value string")
    got = [(r["text"], r["dropped"]) for r in tr.step_log(df).orderBy("line").collect()]
    want = [("ask", None), (None, "unknown_record"), (None, "pending"), ("a", None), (None, "replayed"), ("a", None), ("a", None), (None, "replayed"), (None, "tool_result"), (None, "non_message"), (None, "unknown_record"), (None, "torn_line")]
    assert got == want
    shown = [r["text"] for r in tr.turns_only(tr.step_log(df, tools=True, thinking=True)).orderBy("line").collect()]
    assert shown == ["ask", "a", "hm\na", "a\n[tool_use: f]", "[VIEW_FILE: 3 bytes]"]
    assert [r["created_at"][-5:-1] for r in tr.turns_only(tr.step_log(df)).orderBy("line").collect()] == [".000", ".002", ".003", ".004"]
    nested = spark.createDataFrame([("s",)], "session string")
    assert tr.turns_only(tr.step_log(df, nested=nested)).count() == 0


def test_two_channels_refuse_what_has_no_instant(spark):
    line = json.dumps({"timestamp": "never", "type": "event_msg", "payload": {"type": "user_message", "message": "x"}})
    df = spark.createDataFrame([("s", 0, line)], "session string, line int, value string")
    assert [r["dropped"] for r in tr.two_channel_log(df).collect()] == ["bad_time"]


def test_readers():
    assert tr.reader("qwen") is tr.block_log
    with pytest.raises(NotImplementedError):
        tr.reader("cursor")
    with pytest.raises(ValueError):
        tr.reader("nobody")


def test_each_export_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(x):
        read.add(1)
        return x

    rows = [("a", "## User\nhi\n", "2026-01-01T00:00:00Z", "p"), ("b", "❯ go\n● done\n", "2026-01-01T00:00:00Z", "q"), ("c", "@chapter Message by x (user) at 2024-01-01T00:00:00Z\nyes\n", None, "p")]
    made = spark.createDataFrame(rows, "name string, t string, anchor string, scope string").select("name", text("t").alias("text"), "anchor", "scope")
    got = sorted((r["name"], r["nth"], r["scope"], r["agent"], r["role"], r["created_at"], r["text"]) for r in ex.imported(made.withColumn("format", ex.sniffed(F.col("text")))).collect())
    assert got == [
        ("a", 0, "p", "opencode", "user", "2026-01-01T00:00:00.000Z", "hi"), ("b", 0, "q", "claude-code", "user", "2026-01-01T00:00:00.000Z", "go"),
        ("b", 1, "q", "claude-code", "assistant", "2026-01-01T00:00:01.000Z", "done"), ("c", 0, "p", "x", "user", "2024-01-01T00:00:00.000Z", "yes"),
    ]
    assert read.value == len(rows)
