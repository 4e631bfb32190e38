"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of a text is addressed by its SHA-256. The ledger holds, for each blob and rule version,
the spans found; a scan reads only blobs whose pair with a rule version it lacks, once for all copies,
and findings are joined back to every path that has the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import text_of, written

#: Tasks that the copies of one blob are dealt to when findings are joined back.
SALTS = 16
LEDGER = "blob binary, rule string, spans array<struct<start:int, end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group ``group`` has at least ``least`` characters.

    Any match holds one of ``needs``, so texts without them are spared the pattern.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which spans of equal start are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    # Runs are maximal, so the shorter ones need not be made to be dropped.
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds that the ledger adds to the base ones, listed after them.
ADDED_RULES = (
    Rule("github", 1, r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40, ("gho_", "ghp_", "ghs_", "ghu_")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32, ("eyJ",)),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x0A\x0D]*", 0, 27, ("-----BEGIN ",)),
)
RULES = (*BASE_RULES, *ADDED_RULES)
#: Code points of a block, in which a place is found by counting from the block's start.
BLOCK = 4096


def parts_of(text: Column, rule: Rule) -> Column:
    """The rule's matches in text, leftmost and not overlapping: characters, whether it counts, characters of the text before it."""
    pattern = F.lit(rule.pattern)
    hits, gaps = F.regexp_extract_all(text, pattern, 0), F.split(text, rule.pattern)
    one = lambda h, g: F.struct(F.char_length(h).alias("n"), (F.char_length(g) >= rule.least).alias("ok"))
    parts = F.transform(hits, lambda h: one(h, h)) if rule.group == 0 else F.zip_with(hits, F.regexp_extract_all(text, pattern, rule.group), one)
    parts = F.zip_with(parts, gaps, lambda p, gap: F.struct(p["n"].alias("n"), p["ok"].alias("ok"), F.char_length(gap).alias("gap")))
    parts = F.filter(parts, lambda p: p["n"].isNotNull())  # behind the last match is one more gap
    # Texts without a match, nearly all, are read once, and by literals where a rule has any.
    some = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in rule.needs]) if rule.needs else text.rlike(rule.pattern)
    return F.when(some, parts).otherwise(F.array().cast("array<struct<n:int,ok:boolean,gap:int>>"))


def placed(found: DataFrame) -> DataFrame:
    """blob, rule, spans of rows (blob, rule, parts): places by running sums over a text's matches, however many."""
    each = found.select("blob", "rule", F.posexplode_outer("parts").alias("i", "p"))
    end = F.sum(F.col("p.gap") + F.col("p.n")).over(W.partitionBy("blob", "rule").orderBy("i")).cast("int")
    each = each.select("blob", "rule", F.when(F.col("p.ok"), F.struct((end - F.col("p.n")).alias("start"), end.alias("end"))).alias("s"))
    return each.groupBy("blob", "rule").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """versions with blob, the SHA-256 of the text (null as empty) in UTF-8; an old column blob is replaced."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.encode(text_of(versions, text), "UTF-8"), 256)))


def scanned(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows for those pairs of the versions' blobs and the rules that the ledger lacks; nothing else is scanned.

    versions: a row for each historical version, with its text and any other columns; a null text counts
    as empty, copies are scanned once, and an empty table adds nothing. ledger: what earlier calls gave
    (LEDGER). Copies are dropped before the shuffle as well, so a blob with very many copies stays small.
    """
    known = addressed(versions, text)
    blobs = known.select("blob", text_of(known, text).alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin([r.id for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    fresh = lambda r: ~F.coalesce(F.array_contains("seen", r.id), F.lit(False))
    scans = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.when(fresh(r), parts_of(F.col("text"), r)).alias("parts")) for r in rules])
    return written(placed(blobs.select("blob", F.inline(scans)).where("parts IS NOT NULL")))


def updated(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger with all pairs of the versions' blobs and the rules: the old rows as they are, and those of ``scanned``."""
    new = scanned(versions, ledger, rules, text)
    return new if ledger is None else ledger.select("blob", "rule", "spans").unionAll(new)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep_text: bool = False) -> DataFrame:
    """versions with found: array of (kind, start, end) by start, then by the rules' order; without the text, unless asked for.

    A column found is replaced; columns of any other name stay as they are.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.id, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    hits = ledger.where(F.col("rule").isin([r.id for r in rules]) & (F.size("spans") > 0))
    each = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(order, F.col("rule")).alias("nth"), s["end"].alias("end"))).alias("s"))
    # At most one row for each rule and blob.
    by_blob = each.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    by_blob = by_blob.select("blob", F.transform("s", lambda x: F.struct(F.get(kinds, x["nth"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
    rest = [c for c in versions.columns if c != "found" and (keep_text or c != text)]
    rows = versions.select(F.struct(*[versions[c] for c in rest]).alias("row"), F.unhex(F.sha2(F.encode(text_of(versions, text), "UTF-8"), 256)).alias("blob"))
    # Copies of one blob are dealt to SALTS tasks; the few blobs with findings go to each of them.
    salt = F.xxhash64(*[F.col("row")[c] for c in rest if c != text]) if set(rest) - {text} else F.monotonically_increasing_id()
    rows = rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    by_blob = by_blob.select("blob", "found", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    none = F.array().cast("array<struct<kind:string, start:int, end:int>>")
    done = rows.join(by_blob, ["blob", "salt"], "left")
    return done.select(*[F.col("row")[c].alias(c) for c in rest], F.coalesce("found", none).alias("found"))


def oracle() -> str:
    """``secrets`` by plain matching, for DuckDB."""
    text = "coalesce(text, '')"
    kinds = []
    for nth, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        kinds.append(f"""
  SELECT doc_id, {nth} AS nth, '{r.kind}' AS kind, unnest(range(len(hits))) + 1 AS i, hits, gaps, groups, {r.least} AS least FROM (
    SELECT doc_id, regexp_extract_all({text}, {p}) AS hits, string_split_regex({text}, {p}) AS gaps, regexp_extract_all({text}, {p}, {r.group}) AS groups FROM documents)""")
    return f"""
WITH each AS ({" UNION ALL ".join(kinds)}),
placed AS (
  SELECT doc_id, nth, kind, length(groups[i]) >= least AS ok, length(hits[i]) AS n,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start_at FROM each),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start_at || ':' || (start_at + n), ',' ORDER BY start_at, nth) FILTER (nth < {len(BASE_RULES)}) AS base,
    string_agg(kind || ':' || start_at || ':' || (start_at + n), ',' ORDER BY start_at, nth) AS spans FROM placed WHERE ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f USING (doc_id)"""


def redacted(rows: DataFrame, text: str = "text", found: str = "found", mark: str = "[SECRET]") -> DataFrame:
    """rows with each run of overlapping spans of ``found`` (sorted by start) in text replaced by ``mark``.

    Texts are cut into blocks of BLOCK code points once, so that a place is found by counting within a block
    and the work is a text's length and BLOCK for each span. A text without spans, and a null one, stays.
    """
    names = rows.columns
    spans = F.when(F.size(F.col(found)) > 0, F.col(found))
    # A span opens a run if none before it reaches its start: the greatest end so far, from sorted starts and ends.
    # Starts that are no less than as many ends as there are spans before them lie behind all those.
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
    packed = rows.select(F.struct(*[rows[c] for c in names]).alias("row"), spans.alias("spans"), F.col(text).alias("of"))
    # What lambdas read of other arrays is a column of its own, made once for a row and not for each element.
    packed = once(packed, ends=F.sort_array(F.transform("spans", lambda s: s["end"])), blocks=F.when(F.col("spans").isNotNull(), F.regexp_extract_all(F.col("of"), F.lit(f"(?s).{{1,{BLOCK}}}"), 0)))
    spans, ends = F.col("spans"), F.col("ends")
    opens = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (F.get(ends, i - 1) <= s["start"]), s["start"])), lambda x: x.isNotNull())
    closes = F.filter(F.transform(ends, lambda e, i: F.when((i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] >= e), e)), lambda x: x.isNotNull())
    inner = once(packed, opens=opens, closes=closes)

    def piece(lo: Column, hi: Column) -> Column:
        """The text from place lo to hi."""
        a, b = F.floor(lo / BLOCK).cast("int"), F.floor(hi / BLOCK).cast("int")
        block = lambda k: F.coalesce(F.get("blocks", k), F.lit(""))
        far = F.concat(F.substring(block(a), lo % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice("blocks", a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(block(b), F.lit(1), hi % BLOCK))
        return F.when(a == b, F.substring(block(a), lo % BLOCK + 1, hi - lo)).otherwise(far)

    whole = (F.size("blocks") * BLOCK).cast("int")  # a place in no block, behind the last character
    pieces = F.transform(F.sequence(F.lit(0), F.size("opens")), lambda i: piece(F.when(i == 0, 0).otherwise(F.get("closes", i - 1)), F.coalesce(F.get("opens", i), whole)))
    out = F.when(F.size("opens") > 0, F.array_join(pieces, mark)).otherwise(F.col("row")[text])
    return inner.select(*[out.alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    The counts and base_sha256 are of BASE_RULES' spans, which stay as they are; spans lists those of
    ADDED_RULES as well. The ledger starts empty; every row is one version. Null texts count as empty.
    """
    versions = docs.select("doc_id", "text")
    found = findings(versions, updated(versions))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = listed(F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES])))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
