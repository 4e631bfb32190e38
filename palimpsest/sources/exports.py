"""Importers of exported chats: Texinfo archives, Markdown and terminal scrollback.

Each takes exports (name, text, and anchor, the instant from which messages without one count) and gives
messages: name, nth, agent, role, created_at, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import ids, times
from palimpsest.functions import text as tx

HEADING = r"^@(?:chapter|section) Message by (.+) \(([^()]+)\)\s* at \s*(\S+)\s*$"
SPEAKER = r"^## (User|Assistant)(?:\s*$| \(.*$)"
GLYPHS = "^[❯●]"
#: Fixed value: glyphs of tool results, spinners and status lines, which end what was said.
CHROME = "^[⎿✻⏺]"
#: A line of a single @ in Texinfo, and the one that ends an archive.
MARKUP, BYE = "^@(?:[^@]|$)", r"^@bye\s*$"
CREATED = r"^\s*\*\*Created:\*\*\s*(\d+)/(\d+)/(\d+), (\d+):(\d+)(?::(\d+))? ([AaPp][Mm])\s*$"
HEADER_LINES = 40
FORMATS = ("texinfo", "markdown", "scrollback")
MESSAGE = ("name", "nth", "agent", "role", "created_at", "text")
LINE_END = "\r?\n"


def sniffed(text: Column) -> Column:
    """texinfo, markdown, scrollback, or null."""
    return F.when(F.contains(text, F.lit("\\input texinfo")) | text.rlike(r"(?m)^@(?:chapter|section) Message by "), "texinfo").when(text.rlike(f"(?m){SPEAKER}"), "markdown").when(text.rlike(f"(?m){GLYPHS}"), "scrollback")


def read_exports(spark: SparkSession, path: str, recursive: bool = False, forced: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """name (the file), text, format (null where none matches), anchor (its change time), scope of the files below path.

    A file of more than ``most_bytes`` fails the read before its content is loaded.
    """
    if forced is not None and forced not in FORMATS:
        raise ValueError(f"no such format: {forced}")
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("at"), "value")
    # Sizes are metadata: neither branch loads the text of a file that the other one takes.
    large = files.where(F.col("bytes") > most_bytes).select("name", "bytes", "at", F.raise_error(F.concat(F.lit("too large: "), "name")).cast("string").alias("value"))
    rows = files.where(F.col("bytes") <= most_bytes).unionAll(large)
    kind = F.lit(forced) if forced else sniffed(F.col("value"))
    return rows.select("name", F.col("value").alias("text"), kind.alias("format"), times.as_text(F.col("at")).alias("anchor"), tx.chat_scope(F.regexp_replace("name", "^[a-z]+:/+", "/")).alias("scope"))


def imported(exports: DataFrame, scope: str | None = None) -> DataFrame:
    """Messages of exports (name, text, format, anchor, scope) of all formats, with scope and id; one of no format fails."""
    kind = F.coalesce("format", F.raise_error(F.concat(F.lit("not recognised: "), "name")).cast("string"))
    # All formats in one pass: a branch for each would read every file again.
    found = _messages(exports.withColumns({"format": kind, "scope": F.lit(scope) if scope else F.col("scope")}), "scope")
    ident = ids.import_id(F.col("scope"), F.col("agent"), F.col("role"), F.col("created_at"), F.col("text"))
    return found.select(ident.alias("id"), "scope", *MESSAGE)


def _by_format(texinfo: Column, markdown: Column, scrollback: Column) -> Column:
    kind = F.col("format")
    return F.when(kind == "texinfo", texinfo).when(kind == "markdown", markdown).when(kind == "scrollback", scrollback)


def _messages(exports: DataFrame, *more: str, markdown: str = "opencode", scrollback: str = "claude-code") -> DataFrame:
    """Messages of exports (name, text, format, and perhaps anchor) in one pass, with more of the exports' columns; markdown, scrollback: the agents.

    A line that begins or ends a message starts a run of lines; a run that a heading begins is a message.
    """
    if "anchor" not in exports.columns:
        exports = exports.withColumn("anchor", F.lit(None).cast("string"))
    value = F.col("value")
    lines = exports.select("name", "format", "anchor", *more, F.posexplode(F.split("text", LINE_END)).alias("line", "value"))
    is_head = _by_format(value.rlike(HEADING), value.rlike(SPEAKER), value.rlike(GLYPHS))
    is_end = _by_format(value.rlike(BYE), F.lit(False), value.rlike(CHROME))
    lines = lines.withColumns({"is_head": is_head, "is_end": is_end})
    lines = lines.withColumn("run", F.sum((F.col("is_head") | F.col("is_end")).cast("int")).over(W.partitionBy("name").orderBy("line")))
    at = F.when(F.col("format") == "markdown", created(value))
    own = F.min_by(at, F.when(at.isNotNull() & (F.col("line") < HEADER_LINES), F.col("line"))).over(W.partitionBy("name"))
    lines = lines.withColumn("anchor", F.coalesce(own, F.col("anchor").cast("timestamp")))
    # In scrollback the heading's own line is speech too.
    lines = lines.withColumn("said", F.when(F.col("format") == "scrollback", tx.trimmed(F.regexp_replace("value", GLYPHS, ""))).otherwise(value))
    inner = ~F.col("is_head") & ~F.col("is_end")
    kept = _by_format(inner & ~value.rlike(MARKUP), inner & (F.rtrim("value") != "---"), ~F.col("is_end") & (F.col("said") != ""))
    body = F.array_sort(F.collect_list(F.when(kept, F.struct("line", "said"))))
    runs = lines.groupBy("name", "run").agg(F.max(F.when(F.col("is_head"), value)).alias("head"), body.alias("b"), *[F.max(c).alias(c) for c in ("format", "anchor", *more)]).where("head IS NOT NULL")
    said = F.transform("b", lambda x: x["said"])
    runs = runs.withColumn("body", F.when(F.col("format") == "scrollback", F.array_join(said, " ")).otherwise(F.array_join(said, "\n"))).drop("b")
    text = _by_format(_unescaped(F.col("body")), tx.trimmed(F.col("body")), F.col("body"))
    rows = runs.withColumn("text", text).where(F.when(F.col("format") == "texinfo", tx.trimmed(F.col("text"))).otherwise(F.col("text")) != "")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("name").orderBy("run")) - 1)
    # Those without instants of their own are a second apart, from the anchor on.
    timed = times.as_text(F.timestamp_seconds(F.unix_timestamp("anchor") + F.col("nth")))
    by, role, at = _heading()
    speaker = F.lower(F.regexp_extract("head", SPEAKER, 1))
    glyph = F.when(F.startswith("head", F.lit("❯")), "user").otherwise("assistant")
    rows = rows.withColumns({"agent": _by_format(by, F.lit(markdown), F.lit(scrollback)), "role": _by_format(role, speaker, glyph), "created_at": _by_format(at, timed, timed)})
    return rows.select(*MESSAGE, *more)


def _heading() -> tuple[Column, Column, Column]:
    """agent, role, created_at of a Texinfo heading; one without an instant fails."""
    part = lambda i: F.regexp_extract("head", HEADING, i)
    return tx.texinfo_unescaped(part(1)), part(2), F.coalesce(times.normalized(part(3)), F.raise_error(F.concat(F.lit("no instant in: "), "head")))


def _unescaped(body: Column) -> Column:
    return tx.texinfo_unescaped(F.regexp_replace(body, r"\n+\z", ""))


def _formatted(exports: DataFrame, kind: str, anchor: str | None = None) -> DataFrame:
    exports = exports.withColumn("format", F.lit(kind))
    return exports if anchor is None else exports.withColumn("anchor", F.lit(anchor))


def texinfo(exports: DataFrame) -> DataFrame:
    """Messages of Texinfo archives. A line of a single @ is markup, never text, and @bye ends a message."""
    return _messages(_formatted(exports, "texinfo"))


def texinfo_chapters(rows: DataFrame) -> DataFrame:
    """The same from an archive's chapters (name, place, text), each read in its own row; nth is the place."""
    lines = F.split("text", LINE_END)
    after = F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines)))
    end = F.array_position(F.transform(after, lambda x: F.rtrim(x)), "@bye")
    body = F.filter(F.when(end > 0, F.slice(after, F.lit(1), end.cast("int") - 1)).otherwise(after), lambda x: ~x.rlike(MARKUP))
    agent, role, at = _heading()
    rows = rows.withColumns({"head": F.get(lines, F.lit(0)), "nth": F.col("place"), "text": _unescaped(F.array_join(body, "\n"))}).where(tx.trimmed(F.col("text")) != "")
    return rows.withColumns({"agent": agent, "role": role, "created_at": at}).select(*MESSAGE)


def created(line: Column) -> Column:
    """The instant of a header line such as **Created:** 7/7/2026, 9:39:41 PM (month first, UTC); null for other lines."""
    part = lambda i: F.regexp_extract(line, CREATED, i).try_cast("int")
    pm, hour = F.upper(F.regexp_extract(line, CREATED, 7)) == "PM", part(4)
    hour = F.when(pm & (hour < 12), hour + 12).when(~pm & (hour == 12), 0).otherwise(hour)
    return F.when(line.rlike(CREATED), F.try_make_timestamp(part(3), part(1), part(2), hour, part(5), F.coalesce(part(6), F.lit(0))))


def markdown(exports: DataFrame, anchor: str | None = None, agent: str = "opencode") -> DataFrame:
    """Messages of Markdown exports, a second apart from the header's **Created:** or the anchor on."""
    return _messages(_formatted(exports, "markdown", anchor), markdown=agent)


def scrollback(exports: DataFrame, anchor: str | None = None, agent: str = "claude-code") -> DataFrame:
    """Messages of terminal scrollback: a glyph in the first column starts a speaker, other lines go on, chrome ends it."""
    return _messages(_formatted(exports, "scrollback", anchor), scrollback=agent)
