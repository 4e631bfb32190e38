"""Conversation structure repair by Knuth's lightest derivation.

What a repair may do is a weighted hypergraph. Its axioms are the edits that each row allows, with their costs; an
item (i, state) says that i rows are repaired and that the roles so far leave the pattern ``(s?(ua)+)?`` in
``state``; a deduction ties an item and an edit to the next item and writes the edit's initial. A value is a (cost,
audit), ordered by cost, then by the audit's bytes. Deductions are superior functions: what they give is never below
what they take (an edit's own audit is empty, as "KD" + "R" would be below "R"). So the agenda pops values in
order, the first value popped for an item is its lightest, and the work ends when a goal item is popped.

Order is kept when audits are continued: of two audits of equal cost for the same rows neither is a prefix of the other,
because the longer one would have paid for its further edits. Hence a long conversation is read in blocks:
the lightest items of a block's end are the axioms of the next, and edits that all of them share are final
and leave memory. Spark sorts the rows; a task streams through them.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import crc_mod

#: Rows whose deductions are held at a time.
BLOCK_ROWS = 64
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the pattern: nothing yet, after s, after u, after a. Nothing and a whole pair may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one role that a new or changed row can take in each state.
ROLE = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
#: From any state any other's way on can be had for this much: four for a pair of new rows, three for a system row that must go.
DETOUR = 7

Value = tuple[int, str]


@dataclass
class Deduction:
    """From values of all of ``tail`` the value of ``head`` follows: costs are summed, audits joined, and ``letter`` added."""

    head: Hashable
    tail: tuple[Hashable, ...]
    letter: str
    open: int = field(init=False)

    def __post_init__(self) -> None:
        self.open = len(self.tail)


def lightest(axioms: dict[Hashable, Value], deductions: Iterable[Deduction], goal: Callable[[Hashable], bool]) -> dict[Hashable, Value]:
    """The least value of every item up to the first goal item, in the order in which they became final."""
    uses: dict[Hashable, list[Deduction]] = {}
    for d in deductions:
        for item in d.tail:
            uses.setdefault(item, []).append(d)
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    final: dict[Hashable, Value] = {}
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if goal(item):
            break
        for d in uses.get(item, ()):
            d.open -= 1
            if not d.open and d.head not in final:
                values = [final[x] for x in d.tail]
                heapq.heappush(agenda, ((sum(c for c, _ in values), "".join(a for _, a in values) + d.letter), d.head))
    return final


def edits_of(fault: int) -> list[tuple[str, int]]:
    """The edits that a row allows besides insertion, each with its cost."""
    if fault in (BLANK, DUPLICATE):
        return [(DELETE, COSTS[DELETE])]
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    return [(DELETE, COSTS[DELETE]), (KEEP, COSTS[KEEP] + more), (REROLE, COSTS[REROLE] + more)]


def block_ends(starts: dict[int, Value], rows: list[tuple[str, int]], last: bool) -> dict[int, Value]:
    """From the values of the states before rows (initial, fault), those after them; after the last rows, that of the goal.

    Items are ("at", i, state), edits ("edit", i, letter); i counts the rows of the block.
    """
    axioms: dict[Hashable, Value] = {("at", 0, q): v for q, v in starts.items()}
    deductions = []
    for i in range(len(rows) + 1):
        axioms["edit", i, INSERT] = (COSTS[INSERT], "")
        deductions += [Deduction(("at", i, NEXT[q, ROLE[q][0]]), (("at", i, q), ("edit", i, INSERT)), INSERT) for q in ROLE]
    for i, (initial, fault) in enumerate(rows):
        for letter, cost in edits_of(fault):
            axioms["edit", i, letter] = (cost, "")
            for q in ROLE:
                to = q if letter == DELETE else NEXT.get((q, initial if letter == KEEP else ROLE[q][0]))
                if to is not None:
                    deductions.append(Deduction(("at", i + 1, to), (("at", i, q), ("edit", i, letter)), letter))
    n = len(rows)
    ends = {("at", n, q) for q in ENDS}
    final = lightest(axioms, deductions, (lambda item: item in ends) if last else (lambda item: False))
    if last:
        item = next(reversed(final))
        return {item[2]: final[item]}
    found = {q: final["at", n, q] for q in ROLE if ("at", n, q) in final}
    least = min(c for c, _ in found.values())
    return {q: v for q, v in found.items() if v[0] <= least + DETOUR}


class Repair:
    """One conversation's rows, taken in order; ``edits`` come out as soon as they are final."""

    def __init__(self) -> None:
        self.states: dict[int, Value] = {START: (0, "")}
        self.cost = 0
        self.state = START
        self.held: list[tuple] = []  # rows whose edits aren't final
        self.unread = 0  # of these, rows that no block has held
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.turn = self.initial = None
        self.distinct = 0

    def row(self, turn: int | None, role: str, text: str, fault: int) -> Iterator[tuple]:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.distinct = turn, self.distinct + 1
        if fault:
            self.counts[("blank", "duplicate", "truncated")[fault - 1]] += 1
        self.initial = initial
        self.held.append((turn, role, text, fault))
        self.unread += 1
        if self.unread == BLOCK_ROWS:
            yield from self._block(last=False)

    def end(self) -> Iterator[tuple]:
        yield from self._block(last=True)
        if self.first is not None:
            self.counts["gaps"] = self.turn - self.first + 1 - self.distinct

    def _block(self, last: bool) -> Iterator[tuple]:
        rows = self.held[len(self.held) - self.unread :]
        self.unread = 0
        self.states = block_ends(self.states, [(role[:1], fault) for _, role, _, fault in rows], last)
        sure = os.path.commonprefix([a for _, a in self.states.values()])
        least = min(c for c, _ in self.states.values())
        self.cost += least
        self.states = {q: (c - least, a[len(sure) :]) for q, (c, a) in self.states.items()}
        at = 0
        for letter in sure:
            turn, role, text, _ = (None, None, "", None) if letter == INSERT else self.held[at]
            at += letter != INSERT
            if letter == DELETE:
                yield letter, turn, role, text
                continue
            role = role if letter == KEEP else ROLE[self.state]
            self.state = NEXT[self.state, role[0]]
            yield letter, turn, role, text
        del self.held[:at]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, present: the rows after damage that crc32 of ``conv_id:turn`` modulo 20 decides.

    0 drops a row (present is false), 1 empties its text, 2 takes its stops, 3 repeats it, 4 makes it the user's.
    A null role or text, or a null in ``conv_id:turn``, is one blank.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role").alias("role"), said("text").alias("text"), F.concat(said("conv_id"), F.lit(":"), said("turn")).alias("key"))
    rows = rows.withColumn("code", crc_mod(F.col("key"), 20))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") != 0).alias("present"), F.explode(copies).alias("copy"))


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present, fault, each conversation's rows together and in order (turn, nulls first, role, text, copy).

    One shuffle, by conv_id; both orders are sorts within its partitions.
    """
    stripped = F.rtrim("text", F.lit(BLANKS))
    seen = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    rows = turns.repartition("conv_id").withColumn("nth", F.row_number().over(seen)).withColumn("last", F.right(stripped, F.lit(1)))
    ends: Column = F.col("last").isin(*STOPS)
    fault = F.when(F.col("last") == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~ends, TRUNCATED).otherwise(SOUND)
    rows = rows.select("conv_id", "turn", "role", "text", "present", fault.alias("fault"), "copy")
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy").drop("copy")


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows) in order; the rows of one must be read before the next is asked for."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def own() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == conv:  # noqa: B023
                yield row[1:]
                row = next(rows, None)

        yield conv, own()


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role, text: the edits of every conversation in order, with the rows that they leave.

    Rows of ``turns`` (as ``damaged`` gives them) that aren't present are passed over. A deleted row keeps its
    role and text beside the edit D; an inserted one has no turn and an empty text. A null conv_id is a
    conversation too. Other columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits() -> Iterator[tuple]:
            for conv, rows in conversations_of(batches):
                r, place = Repair(), 0
                for part in (*((turn, role, text, fault) for turn, role, text, present, fault in rows if present), None):
                    for edit in r.end() if part is None else r.row(*part):
                        yield conv, place, *edit
                        place += 1

        yield from in_batches(edits(), "conv_id long, place long, edit string, turn long, role string, text string")

    return ordered(turns).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(turns: DataFrame) -> DataFrame:
    """One row for every conv_id of ``turns``: what was wrong, the lightest repair's cost and audit, and a digest of what it leaves.

    gaps, blank, duplicate, truncated, illegal count faults of the rows that are present: turns that are missing
    between the first and last (rows without a turn don't count), each row's first fault, and neighbours whose
    initials aren't su, ua or au. An empty role has no initial and fits no place of the pattern. The digest is the SHA-256 of the repaired rows as ``role:text``, joined by \\n. A
    conversation without rows has zeros, an empty audit and the digest of nothing. Repeated rows are duplicates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_out() -> Iterator[tuple]:
            for conv, rows in conversations_of(batches):
                r, audit, digest, lead = Repair(), [], hashlib.sha256(), b""

                def take(edits: Iterator[tuple]) -> None:
                    nonlocal lead
                    for letter, _, role, text in edits:
                        audit.append(letter)  # noqa: B023
                        if letter != DELETE:
                            digest.update(lead + f"{role}:{text}".encode())  # noqa: B023
                            lead = b"\n"

                for turn, role, text, present, fault in rows:
                    if present:
                        take(r.row(turn, role, text, fault))
                take(r.end())
                yield conv, *r.counts.values(), r.cost, "".join(audit), digest.hexdigest()

        yield from in_batches(rows_out(), REPORT)

    return ordered(turns).mapInArrow(run, REPORT)


def in_batches(rows: Iterator[tuple], schema: str, n: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of longs and strings as batches."""
    fields = [f.split() for f in schema.split(", ")]
    kind = pa.schema([(name, pa.int64() if t == "long" else pa.string()) for name, t in fields])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)


def oracle() -> str:
    """The query as SQL: values are texts of nine digits for the cost and then the audit, so that least() takes the lightest."""
    add = lambda x, cost, letter: f"lpad(CAST(CAST({x}[:9] AS INT) + {cost} AS VARCHAR), 9, '0') || {x}[10:] || '{letter}'"
    closed = f"""SELECT * EXCLUDE (q2, q3), q2, least(q3, {add("q2", 2, "I")}) AS q3 FROM (
    SELECT * EXCLUDE (q2), least(q2, {add("q0", 2, "I")}, {add("q1", 2, "I")}, {add("q3", 2, "I")}) AS q2 FROM {{}})"""
    keep = lambda x, initial: f"CASE WHEN NOT must_go AND r.initial = '{initial}' THEN {add(x, '0 + cut', 'K')} END"
    turn = lambda x: f"CASE WHEN NOT must_go THEN {add(x, '2 + cut', 'R')} END"
    to_user = ", ".join(f"{keep(x, 'u')}, {turn(x)}" for x in ("p.q0", "p.q1", "p.q3"))
    return rf"""
WITH RECURSIVE crc_steps AS (
  SELECT range AS b, 0 AS k, range AS c FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda a, x: xor(a // 256, t[1 + xor(a, x) % 256])), 4294967295) % 20 AS code
  FROM conversations, crc_table),
damage AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE code <> 0),
seen AS (
  SELECT *, role[:1] AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1:] AS last,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damage),
rows_in AS MATERIALIZED (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM seen),
r AS MATERIALIZED (SELECT conv_id, i, initial, fault IN (1, 2) AS must_go, CAST(fault = 3 AS INT) AS cut FROM rows_in),
p AS (
  {closed.format("(SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, CAST(NULL AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3 FROM (SELECT DISTINCT conv_id FROM r))")}
  UNION ALL
  {closed.format(f'''(SELECT p.conv_id, r.i, {add("p.q0", 3, "D")} AS q0, least({add("p.q1", 3, "D")}, {keep("p.q0", "s")}) AS q1,
      least({add("p.q2", 3, "D")}, {to_user}) AS q2, least({add("p.q3", 3, "D")}, {keep("p.q2", "a")}, {turn("p.q2")}) AS q3
    FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)''')}),
best AS (
  SELECT conv_id, CAST(v[:9] AS BIGINT) AS cost, v[10:] AS audit FROM (SELECT conv_id, least(q0, q3) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS z FROM p) WHERE z = 1),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS k FROM best WHERE audit <> ''),
placed AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS n FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
lines AS (
  SELECT x.conv_id, k, e, n, y.role, y.text, CAST(max(n = 1 AND e = 'K' AND y.initial = 's') OVER (PARTITION BY x.conv_id) AS INT) AS led
  FROM placed x LEFT JOIN rows_in y ON y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.i = x.i AND x.e <> 'I' WHERE e <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (n - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS t FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_in GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM c.conv_id"""
