"""Readers of session logs. Each takes lines (session, line, value) and gives turns.

Turns: session, line, source_id, role, text, created_at, dropped (why a record gives no turn, else null).
``turns_only`` keeps the turns; ``filter_stats`` counts the rest by reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import ids, times
from palimpsest.functions import text as tx

#: Files beyond this size are refused, so a file fits a row.
MOST_BYTES = 64 << 20
TURN = ("session", "line", "source_id", "role", "text", "created_at", "dropped")
#: Kinds of steps that are tools, and kinds that are no message.
TOOL_STEPS = (
    "VIEW_FILE", "RUN_COMMAND", "GREP_SEARCH", "LIST_DIRECTORY", "CODE_ACTION", "GENERIC", "READ_URL_CONTENT", "SEARCH_WEB", "MCP_TOOL", "INVOKE_SUBAGENT", "ASK_QUESTION", "ERROR_MESSAGE",
)
SILENT_STEPS = ("SYSTEM_MESSAGE", "EPHEMERAL_MESSAGE", "CONVERSATION_HISTORY", "CHECKPOINT", "KNOWLEDGE_ARTIFACTS")
#: What a reader counts.
COUNTERS = ("unknown_record", "torn_line", "missing_uuid", "non_message", "pending", "thinking", "tool_use", "tool_result", "meta", "sidechain", "command_synthetic", "empty", "truncated")
#: The first version of prompt logs whose records bear their time.
TIMED = (1, 3)
BLOCK = "array<struct<type:string,text:string,thinking:string,name:string,content:string>>"


def read_lines(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """session (the file), line, value of files below path; a file that is too large fails the read."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_size").alias("bytes"), "value")
    # Sizes are metadata, so a file that is refused isn't loaded.
    large = files.where(F.col("bytes") > most_bytes).select("session", "bytes", F.raise_error(F.concat(F.lit("too large: "), "session")).cast("string").alias("value"))
    whole = files.where(F.col("bytes") <= most_bytes).unionAll(large)
    lines = whole.select("session", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.where(F.trim("value") != "")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """session, bytes, modified, newest first; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("session"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "session")


def selected(listing: DataFrame, which: str) -> DataFrame:
    """Those sessions (session, modified) that are asked for: latest, all, or one by its name, with or without folder and ending."""
    if which == "all":
        return listing
    if which == "latest":
        return listing.orderBy(F.desc("modified"), "session").limit(1)
    bare = F.regexp_replace(F.regexp_replace("session", "^.*/", ""), r"\.[^.]*$", "")
    return listing.where((F.col("session") == which) | (bare == which)).orderBy(F.desc("modified"), "session").limit(1)


def in_workspace(listing: DataFrame, owners: DataFrame, folder: str) -> DataFrame:
    """Sessions (session, ...) of a working folder, by owners (session, workspaces: array of folders, nested).

    Sessions that owners don't know belong nowhere; nested says whether another session started this one.
    """
    known = listing.join(owners, "session", "left")
    return known.where(F.exists("workspaces", lambda w: w == folder)).drop("workspaces").withColumn("nested", F.coalesce("nested", F.lit(False)))


def session_owners(summaries: DataFrame) -> DataFrame:
    """owners of ``in_workspace`` from summaries (conversation_id, workspace_uris: JSON, parent_conversation_id, nesting_depth)."""
    uris = F.coalesce(F.from_json("workspace_uris", "array<string>"), F.array().cast("array<string>"))
    folders = F.filter(F.transform(uris, tx.workspace), lambda w: w.isNotNull())
    nested = (F.coalesce("parent_conversation_id", F.lit("")) != "") | (F.coalesce("nesting_depth", F.lit(0)) > 0)
    return summaries.select(F.col("conversation_id").alias("session"), folders.alias("workspaces"), nested.alias("nested"))


def recorded_owners(lines: DataFrame) -> DataFrame:
    """owners of ``in_workspace`` from logs whose first line records the working folder (type session_meta, payload.cwd); others have none."""
    first = lines.groupBy("session").agg(F.min_by("value", "line").alias("value"))
    r = F.from_json("value", "type string, payload struct<cwd:string>")
    cwd = F.when(r["type"] == "session_meta", F.nullif(r["payload"]["cwd"], F.lit("")))
    return first.select("session", F.array_compact(F.array(cwd)).alias("workspaces"), F.lit(False).alias("nested"))


def located(listed: DataFrame, everywhere: DataFrame, which: str) -> DataFrame:
    """A session (session, modified) by its name: that of the listing if it has one, else the newest of that name anywhere."""
    near, far = (selected(x.select("session", "modified"), which).withColumn("far", F.lit(n)) for n, x in enumerate((listed, everywhere)))
    return near.unionAll(far).orderBy("far").limit(1).drop("far")


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Lines with r, the record, and torn, whether it can't be read."""
    return lines.withColumn("r", F.from_json("value", schema)).withColumn("torn", F.expr("try_parse_json(value) IS NULL"))


def block_text(content: Column, tools: bool = False, thinking: bool = False) -> Column:
    """The text of a message's content: a JSON string, or an array of blocks joined by blank lines."""
    blocks = F.from_json(content, BLOCK)
    kind = lambda b, k: F.coalesce(b["type"], F.lit("")) == k
    size = lambda b: F.octet_length(F.coalesce(b["content"], F.lit("")))
    shown = F.transform(
        blocks,
        lambda b: F.when(kind(b, "text") | kind(b, ""), b["text"])
        .when(kind(b, "thinking") & F.lit(thinking), b["thinking"])
        .when(kind(b, "tool_use") & F.lit(tools), F.concat(F.lit("[tool_use: "), F.coalesce(b["name"], F.lit("tool")), F.lit("]")))
        .when(kind(b, "tool_result") & F.lit(tools), F.concat(F.lit("[tool_result: "), size(b).cast("string"), F.lit(" bytes]"))),
    )
    return F.when(F.ltrim(content).startswith("["), F.array_join(F.filter(shown, lambda t: t.isNotNull()), "\n\n")).otherwise(content)


def _finished(rows: DataFrame, text: Column, dropped: Column, *keep: str) -> DataFrame:
    """Rows (session, line, source_id, role, created_at) with the stored text, and the reason to drop what has none."""
    # Behind a generator the text is made once, however many columns read it.
    rows = rows.drop("clean", "dropped").select("*", F.inline(F.array(F.struct(tx.stripped(text).alias("clean"), dropped.alias("dropped")))))
    rows = rows.withColumn("dropped", F.when(F.col("dropped").isNull() & tx.is_synthetic(F.col("clean")), "command_synthetic").otherwise(F.col("dropped")))
    rows = rows.drop("text").select("*", F.inline(F.array(F.struct(tx.scrubbed(tx.cut(F.col("clean"))).alias("text")))))
    rows = rows.withColumn("dropped", F.when(F.col("dropped").isNull() & (F.coalesce("text", F.lit("")) == ""), "empty").otherwise(F.col("dropped")))
    rows = rows.withColumn("dropped", F.when(F.col("dropped").isNull() & F.col("created_at").isNull(), "bad_time").otherwise(F.col("dropped")))
    return rows.withColumn("text", F.when(F.col("dropped").isNull(), F.col("text"))).select(*TURN, *keep)


def block_log(lines: DataFrame, sidechains: bool = False, tools: bool = False, thinking: bool = False) -> DataFrame:
    """Logs of records of type user or assistant whose message holds text or blocks (content, or parts)."""
    r = _parsed(lines, "type string, uuid string, timestamp string, isMeta boolean, isApiErrorMessage boolean, isSidechain boolean, message struct<content:string,parts:string>")
    why = (
        F.when(F.col("torn"), "torn_line")
        .when(~F.coalesce(F.col("r.type").isin("user", "assistant"), F.lit(False)), "non_message")
        .when(F.col("r.isMeta"), "meta")
        .when(F.col("r.isApiErrorMessage"), "non_message")
        .when(F.col("r.isSidechain") & ~F.lit(sidechains), "sidechain")
        .when(F.col("r.uuid").isNull(), "missing_uuid")
    )
    rows = r.select("session", "line", F.col("r.uuid").alias("source_id"), F.col("r.type").alias("role"), times.normalized(F.col("r.timestamp")).alias("created_at"), F.coalesce("r.message.content", "r.message.parts").alias("raw"), why.alias("why"))
    return _finished(rows, block_text(F.col("raw"), tools, thinking), F.col("why"))


def two_channel_log(lines: DataFrame) -> DataFrame:
    """Logs that hold displayed events and raw responses: a session's events win if they give any turn."""
    r = _parsed(lines, "timestamp string, type string, payload struct<type:string,message:string,text:string,role:string,content:array<struct<text:string>>>")
    p = F.col("r.payload")
    event, response = F.col("r.type") == "event_msg", F.col("r.type") == "response_item"
    role = F.when(event, F.when(p["type"] == "user_message", "user").when(p["type"] == "agent_message", "assistant")).when(response & (p["type"] == "message"), F.when(p["role"].isin("user", "assistant"), p["role"]))
    raw = F.when(event, F.coalesce(p["message"], p["text"])).otherwise(F.array_join(F.transform(p["content"], lambda b: b["text"]), "\n\n"))
    why = F.when(F.col("torn"), "torn_line").when(F.col("role").isNull(), "non_message")
    rows = r.select("session", "line", F.lit(None).cast("string").alias("source_id"), role.alias("role"), raw.alias("raw"), times.normalized(F.col("r.timestamp")).alias("created_at"), "torn", F.coalesce(event, F.lit(False)).alias("event"))
    done = _finished(rows, F.col("raw"), why, "event")
    shown = done.where("event AND dropped IS NULL").select("session").distinct().withColumn("shown", F.lit(True))
    done = done.join(shown, "session", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    return done.where("event = shown OR dropped IN ('torn_line', 'bad_time')").withColumn("source_id", ids.positional_id(F.col("line"), F.col("text"))).select(*TURN)


def step_log(lines: DataFrame, tools: bool = False, thinking: bool = False, sidechains: bool = False, nested: DataFrame | None = None) -> DataFrame:
    """Logs of steps that may be replayed: a step that runs is pending, and of equal finished steps the first counts.

    A step's id is the digest of seven of its fields. Of equal ids the first stands for their place within
    its second. nested (session, ...): sessions that another one started, left out unless asked for.
    """
    rows = step_rows(lines, tools, thinking, sidechains, nested)
    # The first of equal steps has a place among its second's; finished ones count once.
    rows = rows.withColumn("earliest", F.min("line").over(W.partitionBy("session", "source_id"))).withColumn("nth", F.row_number().over(W.partitionBy("session", "source_id", "pending").orderBy("line")))
    return step_turns(rows.withColumn("place", F.dense_rank().over(W.partitionBy("session", "second").orderBy("earliest")) - 1))


def step_rows(lines: DataFrame, tools: bool = False, thinking: bool = False, sidechains: bool = False, nested: DataFrame | None = None) -> DataFrame:
    """What each line of a step log says by itself: session, line, source_id, role, raw, second, pending, and why it gives no turn, before and after replays are known."""
    rows = lines.withColumn("v", F.try_parse_json("value"))
    rows = rows.withColumn("torn", F.col("v").isNull())
    part = lambda c, kind="string": F.expr(f"try_variant_get(v, '$.{c}', '{kind}')")
    whole = F.array(*[F.coalesce(F.to_json(part(c, "variant")), F.lit("null")) for c in ("type", "source", "step_index", "created_at", "content", "thinking", "tool_calls")])
    print_ = F.replace(ids.uuid5(F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]"))), F.lit("-"))
    rows = rows.select(
        "session", "line", "torn", F.when(~F.col("torn"), print_).alias("source_id"), part("type").alias("kind"), part("status").alias("status"), F.coalesce(part("content"), F.lit("")).alias("content"),
        part("thinking").alias("thought"), part("tool_calls", "array<variant>").alias("calls"), F.try_to_timestamp(part("created_at")).alias("at"),
    )
    if nested is not None:
        rows = rows.join(nested.select("session", F.lit(True).alias("nested")).distinct(), "session", "left")
    else:
        rows = rows.withColumn("nested", F.lit(None).cast("boolean"))
    rows = rows.withColumn("pending", F.coalesce(F.col("status") == "RUNNING", F.lit(False))).withColumn("second", F.unix_timestamp("at"))
    done, tool = F.coalesce(F.col("status") == "DONE", F.lit(False)), F.coalesce(F.col("kind").isin(*TOOL_STEPS), F.lit(False))
    user, answer = F.col("kind") == "USER_INPUT", F.col("kind") == "PLANNER_RESPONSE"
    asked = F.regexp_extract("content", r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1)
    used = F.expr("transform(calls, c -> concat('[tool_use: ', coalesce(try_variant_get(c, '$.name', 'string'), try_variant_get(c, '$.function.name', 'string'), 'unknown'), ']'))")
    none = F.array().cast("array<string>")
    parts = F.concat(F.when(F.lit(thinking) & (F.coalesce("thought", F.lit("")) != ""), F.array("thought")).otherwise(none), F.array("content"), F.coalesce(used, none) if tools else none)
    raw = F.when(user, tx.trimmed(asked)).when(answer, F.array_join(parts, "\n")).when(tool, F.concat(F.lit("["), "kind", F.lit(": "), F.octet_length("content").cast("string"), F.lit(" bytes]")))
    before = F.when(F.col("torn"), "torn_line").when(F.col("at").isNull(), "bad_time").when(F.col("pending"), "pending")
    after = (
        F.when(F.coalesce("nested", F.lit(False)) & ~F.lit(sidechains) & (user | answer | tool), "sidechain")
        .when(user & (~done | ~F.col("content").rlike(r"(?s)<USER_REQUEST>.*</USER_REQUEST>")), "unknown_record")
        .when(tool & F.col("status").isin("DONE", "ERROR"), None if tools else "tool_result")
        .when(F.col("kind").isin(*SILENT_STEPS), "non_message").when(~(user & done) & ~(answer & done), "unknown_record").when(F.col("kind").isNull(), "unknown_record")
    )
    return rows.select("session", "line", "source_id", F.when(user, "user").otherwise("assistant").alias("role"), raw.alias("raw"), "second", "pending", before.alias("before"), after.alias("after"))


def step_turns(rows: DataFrame) -> DataFrame:
    """The turns of ``step_rows`` whose nth among equal finished steps, and place among a second's different ones, are known."""
    at = times.from_millis(F.col("second") * 1000 + F.least("place", F.lit(999)))
    why = F.coalesce("before", F.when(F.col("nth") > 1, "replayed"), "after")
    return _finished(rows.withColumn("created_at", at).withColumn("why", why), F.col("raw"), F.col("why"))


def chunk_log(lines: DataFrame) -> DataFrame:
    """Logs of message chunks: neighbours of one kind are one turn, and the run that is open at the end is pending."""
    order = W.partitionBy("session").orderBy("line")
    rows = chunk_rows(lines)
    rows = rows.withColumn("new", F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order)).withColumn("last", F.max("line").over(W.partitionBy("session")))
    runs = rows.where("role <> 'other'").groupBy("session", "run", "role").agg(
        F.min("line").alias("line"), F.max("line").alias("end"), F.first("last").alias("last"), F.min("second").alias("second"), F.array_sort(F.collect_list(F.struct("line", "part"))).alias("parts")
    )
    nth = F.row_number().over(W.partitionBy("session", "second").orderBy("line")) - 1
    runs = runs.withColumn("raw", F.array_join(F.transform("parts", lambda p: p["part"]), "")).withColumn("first", F.get("parts", F.lit(0))["part"])
    return chunk_turns(runs.withColumn("nth", nth).withColumn("pending", F.col("end") == F.col("last")))


def chunk_rows(lines: DataFrame) -> DataFrame:
    """What each line of a chunk log says by itself: session, line, role (user, assistant or other), part, second."""
    r = _parsed(lines, "method string, timestamp long, params struct<update:struct<sessionUpdate:string,content:struct<type:string,text:string>>>")
    u = F.col("r.params.update")
    kind = F.when(u["sessionUpdate"] == "user_message_chunk", "user").when(u["sessionUpdate"] == "agent_message_chunk", "assistant").otherwise("other")
    return r.where("NOT torn").select("session", "line", kind.alias("role"), F.when(u["content"]["type"] == "text", u["content"]["text"]).alias("part"), F.col("r.timestamp").alias("second"))


def chunk_turns(runs: DataFrame) -> DataFrame:
    """The turns of runs (session, line, role, raw, first, second, nth among a second's runs, pending)."""
    at = times.from_millis(F.col("second") * 1000 + F.least("nth", F.lit(999)))
    rows = runs.withColumn("source_id", ids.positional_id(F.col("line"), F.col("first"))).withColumn("created_at", at)
    return _finished(rows, F.col("raw"), F.when(F.col("pending"), "pending"))


def prompt_log(lines: DataFrame) -> DataFrame:
    """Logs where an accepted prompt stands for the typed one of the same id, beside the model's text parts.

    A session whose first line names no protocol version, or one before TIMED, gives nothing: its records bear no time.
    """
    head = lines.groupBy("session").agg(F.min_by(F.get_json_object("value", "$.protocol_version"), "line").alias("version"))
    timed = head.where(tx.protocol(F.col("version")) >= F.struct(*[F.lit(x).alias(c) for x, c in zip(TIMED, ("major", "minor"), strict=True)])).select("session")
    lines = lines.join(timed, "session", "left_semi")
    r = _parsed(lines, "type string, time long, promptId string, input array<struct<text:string>>, event struct<type:string,uuid:string,part:struct<type:string,text:string>>").where("NOT torn")
    joined = F.array_join(F.transform("r.input", lambda b: b["text"]), "\n\n")
    at = times.from_millis(F.col("r.time"))
    prompts = r.where("r.type IN ('prompt.accepted', 'turn.prompt')").select("session", "line", F.col("r.promptId").alias("source_id"), joined.alias("raw"), at.alias("created_at"), (F.col("r.type") == "prompt.accepted").alias("accepted"))
    accepted, typed = prompts.where("accepted").drop("accepted"), prompts.where("NOT accepted").drop("accepted")
    typed = typed.select("session", "source_id", *[F.col(c).alias(f"t_{c}") for c in ("line", "raw", "created_at")])
    users = accepted.join(typed, ["session", "source_id"], "full").select("session", F.coalesce("line", "t_line").alias("line"), "source_id", F.coalesce("raw", "t_raw").alias("raw"), F.coalesce("created_at", "t_created_at").alias("created_at"), F.lit("user").alias("role"))
    said = r.where("r.event.type = 'content.part' AND r.event.part.type = 'text'").select("session", "line", F.col("r.event.uuid").alias("source_id"), F.col("r.event.part.text").alias("raw"), at.alias("created_at"), F.lit("assistant").alias("role"))
    return _finished(users.unionByName(said), F.col("raw"), F.lit(None).cast("string"))


def flag_log(lines: DataFrame) -> DataFrame:
    """Logs of records with id, role, content and visibility."""
    r = _parsed(lines, "id string, role string, content string, visible boolean, createTime string")
    why = F.when(F.col("torn"), "torn_line").when(~F.coalesce(F.col("r.visible"), F.lit(True)), "meta").when(~F.coalesce(F.col("r.role").isin("user", "assistant"), F.lit(False)), "non_message")
    rows = r.select("session", "line", F.col("r.id").alias("source_id"), F.col("r.role").alias("role"), F.col("r.content").alias("raw"), times.normalized(F.col("r.createTime")).alias("created_at"), why.alias("why"))
    return _finished(rows, F.col("raw"), F.col("why"))


def message_parts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns of a relational log: messages (id, session, role, millis) with their text parts (message_id, id, text) joined by blank lines."""
    texts = parts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("p")).withColumnRenamed("message_id", "id")
    rows = messages.join(texts, "id", "left").select("session", F.lit(0).alias("line"), F.col("id").alias("source_id"), "role", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("raw"), times.from_millis(F.col("millis")).alias("created_at"))
    return _finished(rows, F.col("raw"), F.lit(None).cast("string"))


def paired_turns(rows: DataFrame) -> DataFrame:
    """Turns of a relational log whose rows (session, turn_index, user_message, assistant_response, at) hold two each."""
    side = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("raw"))
    each = rows.select("session", F.col("turn_index").alias("line"), times.normalized(F.col("at")).alias("created_at"), F.inline(F.array(side("user", "user_message"), side("assistant", "assistant_response"))))
    each = each.withColumn("source_id", F.concat_ws(":", F.col("line").cast("string"), "role"))
    return _finished(each, F.col("raw"), F.lit(None).cast("string"))


def sqlite_table(spark: SparkSession, paths: str | list[str] | DataFrame, query: str, schema: str) -> DataFrame:
    """A query's rows from SQLite files (paths, or a table of column path) that every worker can open, read-only.

    Each file is one row of a table and is read by the task that has the row, so files are read in parallel
    and each once.
    """
    if not isinstance(paths, DataFrame):
        listed = [paths] if isinstance(paths, str) else paths
        paths = spark.createDataFrame([(p,) for p in listed], "path string").repartition(max(1, len(listed)), "path")

    def run(batches):
        import sqlite3

        import pandas as pd

        for b in batches:
            for path in b["path"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    yield from pd.read_sql_query(query, c, chunksize=10_000)

    return paths.select("path").mapInPandas(run, schema)


def turns_only(turns: DataFrame) -> DataFrame:
    return turns.where("dropped IS NULL").drop("dropped")


def filter_stats(turns: DataFrame) -> DataFrame:
    """reason, n of the records that gave no turn."""
    return turns.where("dropped IS NOT NULL").groupBy(F.col("dropped").alias("reason")).agg(F.count("*").alias("n"))


def json_messages(rows: DataFrame) -> DataFrame:
    """Turns of a relational log whose rows (session, row, message_id, role, content_json, seconds) hold blocks; a row without an id gets one of its number."""
    made = rows.select("session", F.col("row").cast("int").alias("line"), F.coalesce("message_id", F.concat(F.lit("row:"), F.col("row").cast("string"))).alias("source_id"), "role", "content_json", times.from_millis(F.col("seconds") * 1000).alias("created_at"))
    why = F.when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "non_message")
    return _finished(made, block_text(F.col("content_json")), why)


def counters(turns: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """reason, n for every one of COUNTERS: records that gave no turn, turns that were cut, and, of block logs' lines, blocks by kind.

    Replayed steps count as no message, an instant that can't be read as an unknown record.
    """
    merged_as = {"replayed": "non_message", "bad_time": "unknown_record"}
    why = F.coalesce(F.create_map(*[F.lit(x) for kv in merged_as.items() for x in kv])[F.col("dropped")], F.col("dropped"))
    found = turns.where("dropped IS NOT NULL").select(why.alias("reason"), F.lit(1).alias("n"))
    found = found.unionAll(turns.where(F.col("text").rlike(r"\n\[truncated \d+ characters\]\z")).select(F.lit("truncated"), F.lit(1)))
    if lines is not None:
        blocks = F.from_json(F.get_json_object("value", "$.message.content"), BLOCK)
        kinds = lines.select(F.explode(F.transform(F.filter(blocks, lambda b: b["type"].isin("thinking", "tool_use", "tool_result")), lambda b: b["type"])).alias("reason"))
        found = found.unionAll(kinds.select("reason", F.lit(1)))
    return merged(found)


def merged(*counts: DataFrame) -> DataFrame:
    """reason, n: the sums of several reads' counters, 0 where nothing was counted."""
    zeros = counts[0].sparkSession.createDataFrame([(c, 0) for c in COUNTERS], "reason string, n int")
    every = zeros.select("reason", F.col("n").cast("long").alias("n"))
    for c in counts:
        every = every.unionAll(c.select("reason", F.col("n").cast("long")))
    return every.groupBy("reason").agg(F.sum("n").alias("n"))


#: Harnesses, and the reader of the lines of each; those without one keep no log that can be read.
READERS = {
    "claude-code": block_log, "openclaude": block_log, "codex": two_channel_log, "opencode": message_parts, "kimi": prompt_log, "vscode": None, "cursor": None, "antigravity": step_log, "goose": json_messages,
    "copilot-cli": paired_turns, "qwen": block_log, "grok": chunk_log, "zcode": message_parts, "deepcode": flag_log, "poe-code": None, "kilo": None, "mimocode": None, "warp": None, "cline": None, "aichat": None, "bailian": None,
}


def reader(harness: str):
    """The reader of a harness; an unknown one, or one without a reader, is an error and never an empty result."""
    if harness not in READERS:
        raise ValueError(f"unknown harness: {harness}")
    if READERS[harness] is None:
        raise NotImplementedError(f"no reader for the sessions of {harness}")
    return READERS[harness]
