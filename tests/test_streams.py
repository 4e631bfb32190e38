import json
import os
import random

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.operators.store import Store
from palimpsest.sources import transcripts as tr
from palimpsest.streaming import sessions as ss


def step_lines(rng, n):
    """A session's steps: some run before they finish, some are replayed later, several share a second."""
    done, out = [], []
    for i in range(n):
        body = {"type": rng.choice(["USER_INPUT", "PLANNER_RESPONSE", "PLANNER_RESPONSE", "VIEW_FILE", "INFO"]), "source": "s", "step_index": i, "created_at": f"2024-01-01T00:00:{i // 4:02d}Z", "content": f"<USER_REQUEST>q{i}</USER_REQUEST>"}
        if rng.random() < 0.5:
            out.append(body | {"status": "RUNNING"})
        out.append(body | {"status": "DONE"})
        done.append(out[-1])
        if rng.random() < 0.4:
            out.append(rng.choice(done))
    return [json.dumps(x) if rng.random() > 0.05 else '{"torn' for x in out]


def chunk_lines(rng, n):
    """A session's chunks, in runs of one kind, several runs a second."""
    out, kind = [], "user_message_chunk"
    for i in range(n):
        if rng.random() < 0.5:
            kind = rng.choice(["user_message_chunk", "agent_message_chunk", "tool_call"])
        content = {"type": "text", "text": f"p{i} "} if rng.random() > 0.1 else {"type": "image"}
        out.append(json.dumps({"method": "session/update", "timestamp": 1_700_000_000 + i // 6, "params": {"update": {"sessionUpdate": kind, "content": content}}}))
    return out


def pieces(folder, sessions, rng):
    """Write each session's lines as files, cut anywhere, one batch for each round."""
    folder.mkdir()
    at, k = dict.fromkeys(sessions, 0), 0
    while any(at[s] < len(lines) for s, lines in sessions.items()):
        rows = []
        for s, lines in sessions.items():
            n = rng.randint(0, 12)
            rows += [json.dumps({"session": s, "line": i, "value": lines[i]}) for i in range(at[s], min(len(lines), at[s] + n))]
            at[s] += n
        rng.shuffle(rows)
        (folder / f"{k:03d}.json").write_text("\n".join(rows))
        os.utime(folder / f"{k:03d}.json", (1_700_000_000 + k,) * 2)  # files are taken by their time
        k += 1
        yield k


def kept(store):
    return sorted((r["id"], r["role"], r["content"], r["created_at"]) for r in store.memories().collect())


def whole(spark, sessions, harness):
    """What the batch reader makes of the whole logs."""
    lines = spark.createDataFrame([(s, i, v) for s, lines in sessions.items() for i, v in enumerate(lines)], ss.LINES)
    turns = tr.turns_only(tr.reader(harness)(lines))
    rows = turns.select(ids.turn_id(F.lit(harness), F.col("session"), F.col("source_id")).alias("id"), "role", "text", "created_at")
    return sorted(tuple(r) for r in rows.collect())


def test_steps_cut_anywhere_are_those_of_the_whole_log(spark, tmp_path):
    rng = random.Random(1)
    sessions = {f"s{i}": step_lines(rng, 14) for i in range(3)}
    store = Store(spark, str(tmp_path / "store"))
    for k in pieces(tmp_path / "log", sessions, rng):
        if k == 2:
            ss.follow(spark, str(tmp_path / "log"), store, str(tmp_path / "state"), "antigravity", "s", files_at_once=1)
    ss.follow(spark, str(tmp_path / "log"), store, str(tmp_path / "state"), "antigravity", "s", files_at_once=1)
    want = whole(spark, sessions, "antigravity")
    assert kept(store) == want and len(want) > 15
    before = store.version()
    assert ss.follow(spark, str(tmp_path / "log"), store, str(tmp_path / "state"), "antigravity", "s") == 0 and store.version() == before
    # A batch that is tried again after a failure is known by its number.
    name, last = next(iter(before.txns.items()))
    extra = store.memories().limit(1).select(F.lit("new").alias("id"), "agent", "scope", "role", "content", "created_at")
    assert store.ingest(extra, txn=(name, last)) == before and store.ingest(extra, txn=(name, last + 1)).number == before.number + 1


def test_runs_of_chunks_are_those_of_the_whole_log_but_for_the_open_one(spark, tmp_path):
    rng = random.Random(2)
    sessions = {f"s{i}": chunk_lines(rng, 40) for i in range(3)}
    for _ in pieces(tmp_path / "log", sessions, rng):
        pass
    store = Store(spark, str(tmp_path / "store"))
    n = ss.follow(spark, str(tmp_path / "log"), store, str(tmp_path / "state"), "grok", "s", files_at_once=2)
    want = whole(spark, sessions, "grok")
    assert kept(store) == want and len(want) > 15 and n > 3


def test_logs_without_state_and_without_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    assert ss.follow(spark, str(tmp_path / "log"), store, str(tmp_path / "state"), "claude-code", "s") == 0 and store.memories().count() == 0
    lines = [json.dumps({"type": "user", "uuid": f"u{i % 3}", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": f"t{i % 3}"}}) for i in range(5)]
    (tmp_path / "log" / "a.json").write_text("\n".join(json.dumps({"session": "s", "line": i, "value": v}) for i, v in enumerate(lines)))
    ss.follow(spark, str(tmp_path / "log"), store, str(tmp_path / "state"), "claude-code", "s")
    assert [r[2] for r in kept(store)] and sorted(r[2] for r in kept(store)) == ["t0", "t1", "t2"]


class Counted:
    """A map state of a session that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        rows = self.rows
        return {"exists": lambda: bool(rows), "containsKey": rows.__contains__, "getValue": rows.get, "updateValue": rows.__setitem__}[name]


def test_state_is_asked_and_written_once_for_a_key_of_a_batch():
    """Every call of a state goes through a socket: lines that repeat a step don't ask again, and a new session isn't asked at all."""
    reader = ss.Steps()
    reader.seen, reader.seconds = Counted(), Counted()
    rows = pd.DataFrame({"line": range(40), "source_id": [f"s{i // 4}" for i in range(40)], "second": [i // 8 for i in range(40)], "pending": [i % 4 == 0 for i in range(40)]})
    parts = [pd.concat(reader.handleInputRows(("x",), iter([rows[a:b]]), None)) for a, b in ((0, 18), (18, 40))]
    got = pd.concat(parts)
    assert list(got["nth"]) == [0, 1, 2, 3] * 10 and list(got["place"]) == [0] * 4 + [1] * 4 + ([0] * 4 + [1] * 4) * 4
    # Ten steps and five seconds: the one step that both batches hold is written twice.
    assert reader.seen.calls <= 2 + 11 + 2 * 6 and reader.seconds.calls <= 2 + 6 + 2 * 4


class Single:
    """A value or list state of a session that counts its calls."""

    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def appendList(self, values):
        self.calls += 1
        self.held = (self.held or []) + values


def test_a_batch_of_chunks_costs_three_calls_of_the_state():
    """However many runs and seconds it has; the list of seconds is read where time runs back."""
    reader = ss.Chunks()
    reader.open, reader.seconds = Single(), Single()
    seconds = [0, 0, 0, 1, 2, 2, 2, 3, 3, 4, 0, 2, 3, 5]
    rows = [Row(line=i, role=("user", "assistant")[i % 2], part=f"p{i}", second=s) for i, s in enumerate(seconds)]
    got = []
    for a, b, most in ((0, 6, 2), (6, 10, 3), (10, 14, 4)):
        before = reader.open.calls + reader.seconds.calls
        got += reader.handleInputRows(("x",), iter(rows[a:b][::-1]), None)
        assert reader.open.calls + reader.seconds.calls - before <= most + (a == 0)
    assert [(r["line"], r["raw"], r["second"], r["nth"]) for r in got] == [(i, f"p{i}", s, seconds[:i].count(s)) for i, s in enumerate(seconds[:-1])]
