"""The registered queries as SQL for DuckDB, on the same tables."""

from __future__ import annotations

from palimpsest.plans import queries as q
from palimpsest.sources.projections import NOW, START

#: Fixed values, written out here as well so that a fault in the library's own doesn't hide: how facts begin, what
#: negates, what readers count, credentials (prefix, kind, least characters after it), and what queries ask for, cut into terms.
MARKERS = (
    "decided:", "decision:", "todo", "fixme", "note:", "rule:", "fix:", "fixed:", "chose:", "chosen:", "rejected:",
    "constraint:", "gotcha:", "warning:", "never ", "always ", "must ", "do not ", "don't ",
)
NEGATIONS = ("not ", "never ", "no longer ", "don't ", "do not ", "isn't ", "wasn't ", "stopped ")
COUNTERS = ("unknown_record", "torn_line", "missing_uuid", "non_message", "pending", "thinking", "tool_use", "tool_result", "meta", "sidechain", "command_synthetic", "empty", "truncated")
CREDENTIALS = (
    ("github_pat_", "github-token", 16), ("sk-proj-", "openai-key", 16), ("ctx7sk-", "context7-key", 16), ("sk-ant-", "anthropic-key", 16), ("xoxb-", "slack-token", 12), ("xoxp-", "slack-token", 12),
    ("ghp_", "github-token", 16), ("gho_", "github-token", 16), ("ghs_", "github-token", 16), ("AKIA", "aws-access-key", 12), ("ASIA", "aws-access-key", 12), ("AIza", "google-api-key", 30), ("sk-", "api-key", 20),
)
CREDENTIAL_KINDS = ("private-key", "bearer-token", "anthropic-key", "openai-key", "github-token", "aws-access-key", "slack-token", "google-api-key", "context7-key", "api-key")
PHRASES = {
    "thing of-the Éauxré lichen ertion ciónmente the": [["thing"], ["of", "the"], ["eauxre"], ["lichen"], ["ertion"], ["cionmente"], ["the"]],
    "thing Éauxré lichen": [["thing"], ["eauxre"], ["lichen"]],
    "the of and": [["the"], ["of"], ["and"]],
    "lichen thing": [["lichen"], ["thing"]],
    "ertion ciónmente": [["ertion"], ["cionmente"]],
    "of-the": [["of", "the"]],
}

ORACLE: dict[str, str] = {}

NULLS = "NULL::VARCHAR AS rule_id, NULL::VARCHAR AS status, NULL::VARCHAR AS valid_from, NULL::VARCHAR AS valid_to, NULL::VARCHAR AS superseded_by"


def at(minutes: str) -> str:
    return f"strftime(TIMESTAMP '{START}' + to_minutes(CAST({minutes} AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


#: Shared subqueries; a query names those that it needs, in order.
PARTS = {
    "mem_conv": f"""
      SELECT id, 'agent' || (conv_id % 4) AS agent, 's' || (conv_id % 7) AS scope, CASE WHEN role = 'system' THEN 'rule' ELSE role END AS role,
        CASE WHEN role = 'system' THEN body WHEN (conv_id + turn) % 5 = 0 THEN 'Decided: ' || body
          WHEN (conv_id + turn) % 5 = 1 THEN body || chr(10) || '- TODO ' || substr(body, 1, 40) ELSE body END AS content,
        created_at, CASE WHEN role = 'system' THEN printf('r%06d', conv_id) END AS rule_id,
        CASE WHEN role = 'system' THEN CASE WHEN conv_id % 2 = 1 THEN 'retired' ELSE 'active' END END AS status, NULL::VARCHAR AS valid_from,
        CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN lead(created_at) OVER (PARTITION BY conv_id, role ORDER BY turn) END AS valid_to,
        CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN lead(id) OVER (PARTITION BY conv_id, role ORDER BY turn) END AS superseded_by
      FROM (SELECT *, coalesce(text, '') AS body, printf('c%06d-%03d', conv_id, turn) AS id, {at("conv_id * 60 + turn")} AS created_at FROM conversations)""",
    "mem_docs": f"SELECT printf('d%06d', doc_id) AS id, 'importer' AS agent, lang AS scope, 'note' AS role, coalesce(text, '') AS content, {at('doc_id')} AS created_at, {NULLS} FROM documents",
    "mem_secret": f"""
      SELECT * REPLACE (CASE n WHEN 0 THEN content || ' ghp_' || repeat('A', 30) WHEN 1 THEN content || ' Bearer ' || repeat('b', 20)
        WHEN 2 THEN chr(27) || '[31m<system-reminder>hidden</system-reminder>' || content ELSE content END AS content)
      FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) % 17 AS n FROM mem_docs)""",
    "mem_neg": "SELECT * REPLACE (CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 1 THEN 'it is not ' || content ELSE content END AS content) FROM mem_docs",
    "vec": "SELECT printf('d%06d', v.vec_id) AS memory_id, 'm' AS model, CAST(coalesce(t.embedding, v.embedding) AS DOUBLE[]) AS embedding FROM embeddings v LEFT JOIN embeddings t ON t.vec_id % 10 = 0 AND v.vec_id = t.vec_id + 1",
    "access_log": "SELECT printf('d%06d', event_id % (SELECT count(*) FROM documents)) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts FROM events WHERE event_type = 'view'",
    "fact_units": r"""
      SELECT id AS memory_id, scope, created_at, list_transform(flatten(list_transform(string_split(content, chr(10)), lambda line:
          CASE WHEN len(string_split(regexp_replace(line, '([.!?]) (\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1))) > 1
            THEN list_concat([line], string_split(regexp_replace(line, '([.!?]) (\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1))) ELSE [line] END)),
          lambda u: ltrim(regexp_replace(trim(u, ' ' || chr(9) || chr(13)), '^(- |\* |• )', ''))) AS units
      FROM mem_conv WHERE valid_to IS NULL AND rule_id IS NULL""",
    "fact_lists": f"SELECT *, list_filter(units, lambda u: length(u) >= 12 AND len(list_filter({array(MARKERS)}, lambda m: starts_with(lower(u), m))) > 0) AS kept FROM fact_units",
    "fact_rows": """
      SELECT memory_id, scope, created_at, fact FROM (
        SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY i) AS n FROM (
          SELECT memory_id, scope, created_at, fact, min(i) AS i FROM (SELECT memory_id, scope, created_at, unnest(kept) AS fact, unnest(range(len(kept))) AS i FROM fact_lists) GROUP BY ALL)) WHERE n <= 8""",
}


for part, source in (("fact_units", "mem_conv"), ("fact_lists", "fact_units"), ("fact_rows", "fact_lists")):
    # The same of the documents.
    PARTS["doc_" + part] = PARTS[part].replace(f"FROM {source}", "FROM " + ("mem_docs" if source == "mem_conv" else "doc_" + source))


def uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({name}))"
    variant = f"printf('%02x', (CAST('0x' || substr({h}, 17, 2) AS INTEGER) & 63) | 128)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"


def phrase_count(terms: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({terms}, lambda t: t = {quoted(phrase[0])}))"
    n = len(phrase)
    return f"len(list_filter(range(1, len({terms}) - {n} + 2), lambda i: {terms}[i:i + {n - 1}] = {array(phrase)}))"


TERMS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"


def bm25(source: str, text: str, query: str) -> str:
    """Rows of the source that match, with score."""
    phrases = PHRASES[query]
    counts = ", ".join(f"{phrase_count('tt', p)} AS f{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    idf = lambda i: f"ln((every - n{i} + 0.5) / (n{i} + 0.5))"
    score = " + ".join(f"(CASE WHEN {idf(i)} <= 0 THEN 1e-6 ELSE {idf(i)} END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    return f"""
      (WITH counted AS (SELECT *, len(tt) AS dl, {counts} FROM (SELECT *, {TERMS.format(text)} AS tt FROM {source})),
       stats AS (SELECT count(*) AS every, avg(dl) AS avgdl, {stats} FROM counted)
       SELECT counted.* EXCLUDE (tt), {score} AS score FROM counted, stats WHERE {" OR ".join(f"f{i} > 0" for i in range(len(phrases)))})"""


def ranked(rows: str, limit: int, order: str = "round(score, 10) DESC, id") -> str:
    return f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS rank FROM {rows}) WHERE rank < {limit})"


def oracle(name: str, body: str, *parts: str) -> None:
    needs = {"fact_rows": ["mem_conv", "fact_units", "fact_lists"], "fact_lists": ["mem_conv", "fact_units"], "doc_fact_rows": ["mem_docs", "doc_fact_units", "doc_fact_lists"], "mem_secret": ["mem_docs"], "mem_neg": ["mem_docs"]}
    order = list(dict.fromkeys(x for p in parts for x in [*needs.get(p, []), p]))
    head = ",\n".join(f"{p} AS ({PARTS[p]})" for p in order)
    ORACLE[name] = f"WITH {head}{'' if body.startswith(',') else chr(10)}{body}" if head else body  # a leading comma goes on with subqueries


S, O = quoted(q.SCOPE), quoted(q.OTHER)
oracle("get_by_id", "SELECT * FROM mem_conv WHERE id = 'c000003-001'", "mem_conv")
oracle("export_history", f"SELECT id, role, content, created_at, superseded_by FROM mem_conv WHERE scope = {S} AND role <> 'rule'", "mem_conv")


def recall(limit: int, where: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY created_at, id) - 1 AS INTEGER) AS place, id, scope, role, created_at, valid_to FROM
      (SELECT * FROM mem_conv WHERE scope = {S} AND {where} ORDER BY created_at DESC, id DESC LIMIT {limit})"""


oracle("recall_current", recall(50, "valid_to IS NULL"), "mem_conv")
oracle("recall_as_of", recall(50, f"coalesce(valid_from, created_at) <= '{q.AS_OF}' AND (valid_to IS NULL OR valid_to > '{q.AS_OF}')"), "mem_conv")
oracle("recall_all", recall(1000, "true"), "mem_conv")
ACTIVE = "rule_id IS NOT NULL AND (status IS NULL OR status <> 'retired')"
TOKENS = "CAST(greatest(1, ceil(length(content) / 4)) AS BIGINT)"
oracle("rules_active", f"SELECT scope, rule_id, content, status FROM mem_conv WHERE {ACTIVE}", "mem_conv")
oracle("rules_all", "SELECT scope, rule_id, agent, created_at, status FROM mem_conv WHERE rule_id IS NOT NULL", "mem_conv")
oracle("rules_tokens", f"SELECT scope, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM mem_conv WHERE {ACTIVE} GROUP BY scope", "mem_conv")
oracle("fts_match", f"SELECT id, scope FROM {bm25('mem_docs', 'content', 'thing Éauxré lichen')}", "mem_docs")
oracle("fts_search", f"SELECT rank, id, scope, round(score, 6) AS score FROM {ranked(bm25('mem_docs', 'content', q.WORDS), 20)}", "mem_docs")
fr = f"(SELECT * FROM {bm25('mem_docs', 'content', q.WORDS)} WHERE scope = 'fr')"
oracle("fts_search_scoped", f"SELECT rank, id, round(score, 6) AS score FROM {ranked(fr, 50)}", "mem_docs")
oracle("fts_search_unindexed", f"SELECT rank, id, scope, round(score, 6) AS score FROM {ranked('(SELECT * FROM ' + bm25('mem_conv', 'content', q.WORDS) + ' WHERE valid_to IS NULL)', 20)}", "mem_conv")
oracle("fts_sanitize", r"""SELECT id, array_to_string(list_transform(list_filter(regexp_split_to_array(translate(content, 'zq', chr(160) || chr(8195)), '[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda t: t <> ''), lambda t: '"' || replace(t, '"', '""') || '"'), ' OR ') AS quoted FROM mem_conv""", "mem_conv")
oracle("token_estimate", f"SELECT id, {TOKENS} AS tokens FROM mem_docs", "mem_docs")
fact_id = uuid5("'memory-fact:' || memory_id || ':' || fact")
oracle("facts_extract", f"SELECT {fact_id} AS id, memory_id, scope, fact FROM fact_rows", "fact_rows")
oracle("facts_report", "SELECT (SELECT count(*) FROM fact_units) AS scanned, count(*) AS facts, count(DISTINCT memory_id) AS memories_with_facts FROM fact_rows", "fact_rows")
FACT_HITS = f"(SELECT memory_id AS id, max(round(score, 10)) AS score FROM {bm25('fact_rows', 'fact', q.WORDS)} GROUP BY memory_id)"
oracle("fact_candidates", f"SELECT rank, id, round(score, 6) AS score FROM {ranked(FACT_HITS, 50)}", "fact_rows")
COS = "coalesce(CASE WHEN len({0}) = len({1}) THEN list_inner_product({0}, {1}) / nullif(sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})), 0) END, 0)"
NEAR = f"(SELECT memory_id AS id, {COS.format('v.embedding', 'z.e')} AS score FROM vec v JOIN mem_docs m ON m.id = v.memory_id, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0) z)"
oracle("vector_topk", f"SELECT rank, id, round(score, 6) AS score FROM {ranked(NEAR, 50)}", "mem_docs", "vec")
oracle("vector_count", "SELECT model, count(*) AS n FROM vec GROUP BY model", "vec")
oracle("vector_upsert", "SELECT memory_id, CASE WHEN CAST(substr(memory_id, 2) AS BIGINT) % 3 = 0 THEN 'n' ELSE model END AS model, CAST(len(embedding) AS INTEGER) AS dim FROM vec", "vec")
LACK = "FROM mem_docs m WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.memory_id = m.id)"
oracle("unindexed", f"SELECT id, created_at {LACK}", "mem_docs", "vec")
oracle("unindexed_count", f"SELECT scope, count(*) AS n {LACK} GROUP BY scope", "mem_docs", "vec")
oracle("index_progress", f"SELECT (SELECT count(*) FROM mem_docs) - (SELECT count(*) {LACK}) AS indexed, (SELECT count(*) {LACK}) AS remaining", "mem_docs", "vec")
oracle("cosine_pairs", f"SELECT a.memory_id, b.memory_id AS other, round({COS.format('a.embedding', 'b.embedding')}, 6) AS cosine FROM vec a JOIN vec b ON CAST(substr(b.memory_id, 2) AS BIGINT) = CAST(substr(a.memory_id, 2) AS BIGINT) + 1", "vec")
CHANNELS = f"""
  SELECT 'fts' AS channel, id, rank FROM {ranked(bm25('mem_docs', 'content', q.WORDS), 50)}
  UNION ALL SELECT 'vector', id, rank FROM {ranked(NEAR, 50)}"""
FACTS_ON_DOCS = f"(SELECT memory_id AS id, max(round(score, 10)) AS score FROM {bm25('doc_fact_rows', 'fact', q.WORDS)} GROUP BY memory_id)"
ALL_CHANNELS = f"{CHANNELS} UNION ALL SELECT 'facts', id, rank FROM {ranked(FACTS_ON_DOCS, 50)}"
FUSED = f"(SELECT id, sum(1.0 / (60 + rank)) AS score FROM ({ALL_CHANNELS}) GROUP BY id)"
oracle("rrf_fuse", f"SELECT id, round(score, 8) AS score FROM {FUSED}", "mem_docs", "vec", "doc_fact_rows")
oracle("hybrid_search", f"SELECT rank, id, scope, round(score, 8) AS score FROM {ranked(FUSED, 20)} JOIN mem_docs USING (id)", "mem_docs", "vec", "doc_fact_rows")
oracle("hybrid_channel_counts", f"SELECT c.channel, count(x.id) AS n FROM (VALUES ('fts'), ('facts'), ('vector')) c(channel) LEFT JOIN ({ALL_CHANNELS}) x ON x.channel = c.channel GROUP BY c.channel", "mem_docs", "vec", "doc_fact_rows")
oracle("hybrid_gate", "SELECT m.model, count(v.model) AS n_vectors, CASE WHEN count(v.model) > 0 THEN 'hybrid' ELSE 'fts' END AS mode FROM (VALUES ('m'), ('absent')) m(model) LEFT JOIN vec v ON v.model = m.model GROUP BY m.model", "vec")


def packed(rows: str, budget: str, order: str) -> str:
    """Costs and whether each row is taken, in an order: a fold by recursion over places."""
    return f"""
      line AS MATERIALIZED (SELECT id, {TOKENS} AS cost, row_number() OVER (ORDER BY {order}) - 1 AS nth FROM {rows}),
      fold AS (
        SELECT CAST(-1 AS BIGINT) AS nth, CAST({budget} AS BIGINT) AS remain, false AS included, NULL::VARCHAR AS id, NULL::BIGINT AS cost
        UNION ALL SELECT l.nth, CASE WHEN l.cost <= f.remain THEN f.remain - l.cost ELSE f.remain END, l.cost <= f.remain, l.id, l.cost FROM fold f JOIN line l ON l.nth = f.nth + 1)"""


def recursive(name: str, body: str, *parts: str) -> None:
    oracle(name, body, *parts)
    ORACLE[name] = ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)


def with_fold(name: str, fold: str, body: str, *parts: str) -> None:
    recursive(name, f", {fold}\n{body}", *parts)


PACKED = "SELECT id, cost, included, CAST(nth AS INTEGER) AS nth FROM fold WHERE nth >= 0"
RECENT = f"(SELECT * FROM mem_conv WHERE scope = {S} AND valid_to IS NULL ORDER BY created_at DESC, id DESC LIMIT 50)"
with_fold("budget_recall", packed(RECENT, str(q.BUDGET), "created_at DESC, id DESC"), PACKED, "mem_conv")
with_fold("budget_search", packed(ranked(bm25("mem_docs", "content", q.WORDS), 20), "2500", "rank"), PACKED, "mem_docs")
RULE_TOKENS = f"(SELECT coalesce(sum({TOKENS}), 0) FROM mem_conv WHERE scope = {S} AND {ACTIVE})"
LEFT = f"(SELECT greatest(0, {q.BUDGET} - {RULE_TOKENS}))"
NOT_RULES = f"(SELECT * FROM {RECENT} WHERE rule_id IS NULL)"
CHOSEN = "SELECT f.id, f.cost, m.created_at FROM fold f JOIN mem_conv m USING (id) WHERE included"
with_fold("context_recency", packed(NOT_RULES, LEFT, "created_at DESC, id DESC"), CHOSEN, "mem_conv")
SCOPED = f"(SELECT * FROM {bm25('mem_conv', 'content', q.WORDS)} WHERE scope = {S} AND valid_to IS NULL)"
SCOPED_FACTS = f"(SELECT f.* FROM {FACT_HITS} f JOIN mem_conv USING (id) WHERE scope = {S})"
IN_SCOPE = f"""(SELECT m.*, score FROM (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (
    SELECT id, row_number() OVER (ORDER BY rank) - 1 AS rank FROM {ranked(SCOPED, 50)} WHERE rule_id IS NULL
    UNION ALL SELECT id, rank FROM {ranked(SCOPED_FACTS, 50)}
    UNION ALL SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 FROM {NOT_RULES}) GROUP BY id) JOIN mem_conv m USING (id))"""
with_fold("context_query", packed(IN_SCOPE, LEFT, "round(score, 10) DESC, id"), CHOSEN, "mem_conv", "fact_rows")
with_fold(
    "context_report",
    packed(NOT_RULES, LEFT, "created_at DESC, id DESC"),
    f"""SELECT CAST({q.BUDGET} AS INTEGER) AS requested, CAST(coalesce(sum(cost) FILTER (included), 0) AS BIGINT) AS estimated, count(*) FILTER (included) AS included, count(*) FILTER (NOT included) AS dropped,
      coalesce(string_agg(id, ',' ORDER BY nth) FILTER (NOT included), '') AS dropped_ids, 'recency' AS channel, count(*) AS candidates,
      (SELECT count(*) FROM mem_conv WHERE scope = {S} AND {ACTIVE}) AS rules, CAST({RULE_TOKENS} AS BIGINT) AS rules_tokens FROM fold WHERE nth >= 0""",
    "mem_conv",
)
KEY = r"trim(regexp_replace(lower(content), '\s+', ' ', 'g'))"
oracle("dedup_exact", f"SELECT scope, min(id) AS first_id, count(*) AS n FROM mem_docs GROUP BY scope, {KEY} HAVING count(*) > 1", "mem_docs")
EDGES = f"""SELECT a.scope, a.memory_id AS a, b.memory_id AS b, {COS.format('a.embedding', 'b.embedding')} AS similarity
  FROM (SELECT v.*, m.scope FROM vec v JOIN mem_docs m ON m.id = v.memory_id) a JOIN (SELECT v.*, m.scope FROM vec v JOIN mem_docs m ON m.id = v.memory_id) b
  ON a.scope = b.scope AND a.memory_id < b.memory_id WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.92"""
oracle("dedup_vector_edges", f"SELECT scope, a, b, round(similarity, 6) AS similarity FROM ({EDGES})", "mem_docs", "vec")
GRAPH = f""",
  keyed AS MATERIALIZED (SELECT id, scope, created_at, {KEY} AS k FROM mem_docs),
  near AS MATERIALIZED (SELECT scope, a, b FROM ({EDGES})),
  firsts AS MATERIALIZED (SELECT scope, k, min(id) AS a FROM keyed GROUP BY scope, k HAVING count(*) > 1),
  edge AS MATERIALIZED (SELECT f.a, y.id AS b, 'exact' AS by FROM firsts f JOIN keyed y ON y.scope = f.scope AND y.k = f.k AND y.id <> f.a
    UNION ALL SELECT a, b, 'vector' FROM near),
  both_ways AS MATERIALIZED (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
  reach AS (SELECT DISTINCT a AS id, a AS other FROM both_ways UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
  part AS MATERIALIZED (SELECT id, min(other) AS component FROM reach GROUP BY id)"""
GROUPS = """,
  winner AS MATERIALIZED (SELECT component, scope, arg_max(id, created_at || id) AS winner FROM part JOIN keyed USING (id) GROUP BY component, scope)"""
recursive("dedup_components", f"{GRAPH}\nSELECT id, component FROM part", "mem_docs", "vec")
recursive(
    "dedup_groups",
    f"""{GRAPH}{GROUPS}
SELECT w.scope, w.winner, (SELECT string_agg(k.id, ',' ORDER BY k.created_at, k.id) FROM part p JOIN keyed k USING (id) WHERE p.component = w.component AND k.id <> w.winner) AS losers,
  (SELECT string_agg(DISTINCT e.by, ',' ORDER BY e.by) FROM edge e JOIN part p ON p.id = e.a WHERE p.component = w.component) AS detectors FROM winner w""",
    "mem_docs", "vec",
)
recursive(
    "dedup_apply",
    f"""{GRAPH}{GROUPS}
SELECT m.id, m.scope, CASE WHEN w.winner IS NOT NULL AND w.winner <> m.id THEN '{NOW}' END AS valid_to, CASE WHEN w.winner <> m.id THEN w.winner END AS superseded_by
FROM mem_docs m LEFT JOIN part p USING (id) LEFT JOIN winner w USING (component)""",
    "mem_docs", "vec",
)
WORD_CLASSES = rf""", every AS MATERIALIZED (SELECT id, scope, created_at, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> ''))) AS w,
    len(list_filter({array(NEGATIONS)}, lambda m: contains(lower(content), m))) > 0 AS neg FROM mem_neg),
  r AS MATERIALIZED (SELECT scope, w, neg, arg_min(id, created_at || id) AS id, min(created_at) AS created_at FROM every WHERE len(w) > 0 GROUP BY scope, w, neg)"""
oracle(
    "contradictions",
    rf"""{WORD_CLASSES},
  e AS MATERIALIZED (SELECT id, scope, neg, unnest(w) AS word FROM r),
  p AS (SELECT x.id AS p, y.id AS q, count(*) AS n FROM e x JOIN e y ON x.scope = y.scope AND x.word = y.word AND x.neg AND NOT y.neg GROUP BY ALL)
SELECT x.scope, CASE WHEN x.created_at || p < y.created_at || q THEN p ELSE q END AS a, CASE WHEN x.created_at || p < y.created_at || q THEN q ELSE p END AS b,
  round(n / (len(x.w) + len(y.w) - n), 6) AS jaccard, p AS negated
FROM p JOIN r x ON x.id = p JOIN r y ON y.id = q WHERE n / (len(x.w) + len(y.w) - n) >= 0.5""",
    "mem_neg",
)
oracle("contradiction_members", rf"{WORD_CLASSES} SELECT e.scope, r.id AS class, e.id FROM every e JOIN r ON r.scope = e.scope AND r.w = e.w AND r.neg = e.neg", "mem_neg")
ACCESS = "(SELECT id, count(*) AS access_count, max(ts) AS last_accessed_at FROM access_log GROUP BY id)"
oracle("access_counts", f"SELECT * FROM {ACCESS}", "access_log")
oracle(
    "decay_top20",
    f"""SELECT id, scope, round(age, 6) AS age_days, n AS access_count, last_accessed_at, round(age + 30.0 / (1 + n), 6) AS staleness FROM (
  SELECT m.id, m.scope, greatest(0, date_diff('second', CAST(replace(m.created_at, 'Z', '') AS TIMESTAMP), TIMESTAMP '2024-02-01')) / 86400.0 AS age, coalesce(c.access_count, 0) AS n, last_accessed_at
  FROM mem_docs m LEFT JOIN {ACCESS} c USING (id)) ORDER BY age + 30.0 / (1 + n) DESC, id LIMIT 20""",
    "mem_docs", "access_log",
)
oracle("supersede_fold", "SELECT id, valid_to, superseded_by FROM mem_conv", "mem_conv")
oracle(
    "supersede_outcome",
    """SELECT id AS target, asked AS scope, CASE WHEN asked <> scope THEN 'not-found' WHEN rule_id IS NOT NULL THEN 'target-is-rule' WHEN valid_to IS NOT NULL THEN 'already-superseded' ELSE 'superseded' END AS outcome
FROM (SELECT *, CASE WHEN right(id, 1) = '1' THEN 's9' ELSE scope END AS asked FROM mem_conv)""",
    "mem_conv",
)
recursive(
    "supersession_chain",
    """, walk AS (SELECT id, superseded_by AS head, 1 AS depth FROM mem_conv WHERE superseded_by IS NOT NULL
  UNION ALL SELECT w.id, m.superseded_by, depth + 1 FROM walk w JOIN mem_conv m ON m.id = w.head WHERE m.superseded_by IS NOT NULL)
SELECT id, arg_max(head, depth) AS head, CAST(max(depth) AS INTEGER) AS depth FROM walk GROUP BY id""",
    "mem_conv",
)
N = "CAST(substr(rule_id, 2) AS BIGINT)"
oracle(
    "rule_fold",
    f"""SELECT scope, rule_id, CASE WHEN again THEN upper(content) ELSE content END AS text, CASE WHEN purged THEN '{NOW}' ELSE created_at END AS created_at,
  CASE WHEN again OR odd THEN '{NOW}' ELSE created_at END AS updated_at, CASE WHEN again THEN 'active' WHEN odd THEN 'retired' ELSE 'active' END AS status
FROM (SELECT *, {N} % 3 = 0 AS again, {N} % 2 = 1 AS odd, {N} % 5 = 0 AS fifth, odd AND fifth AS purged FROM mem_conv WHERE rule_id IS NOT NULL) WHERE NOT purged OR again""",
    "mem_conv",
)
ASKED = "SELECT scope, rule_id, status FROM mem_conv WHERE rule_id IS NOT NULL UNION ALL SELECT scope, id, 'none' FROM mem_conv WHERE role = 'user'"
for name, retired, active in (("retire", "already-retired", "retired"), ("purge", "purged", "not-retired")):
    oracle(f"rule_{name}_outcome", f"SELECT scope, rule_id, CASE status WHEN 'none' THEN 'not-found' WHEN 'retired' THEN '{retired}' ELSE '{active}' END AS outcome FROM ({ASKED})", "mem_conv")
oracle(
    "rule_validate",
    r"""SELECT id, CASE WHEN trim(rid) = '' THEN 'empty id' WHEN regexp_matches(rid, '\s') THEN 'blank in id' WHEN strlen(rid) > 96 THEN 'long id' WHEN trim(content) = '' THEN 'empty text' WHEN contains(content, 'rules:') THEN 'sentinel in text' END AS fault
FROM (SELECT *, CASE WHEN rule_id IS NOT NULL THEN rule_id WHEN role = 'user' THEN substr(content, 1, 100) ELSE replace(content, ' ', '-') END AS rid FROM mem_conv)""",
    "mem_conv",
)
TRIM = r"regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '')"
oracle(
    "rules_render",
    f"""SELECT scope, '## Rules of ' || scope || ' (' || count(*) || ')' || chr(10) || chr(10) || string_agg('### `' || rule_id || '`' || chr(10) || chr(10) || {TRIM} || chr(10) || chr(10) || '*Added ' || created_at || ' by ' || agent || '.*' || chr(10) || chr(10), '' ORDER BY rule_id) AS block
FROM mem_conv WHERE {ACTIVE} GROUP BY scope""",
    "mem_conv",
)
ESC = "replace(replace(replace({0}, '@', '@@'), chr(123), '@' || chr(123)), chr(125), '@' || chr(125))"
oracle(
    "archive_render",
    f"""SELECT scope, '\\input texinfo' || chr(10) || '@documentencoding UTF-8' || chr(10) || '@settitle Chat history for scope: ' || {ESC.format("scope")} || chr(10) || '@c Messages: ' || count(*) || chr(10) || '@c Through: ' || arg_max(created_at, created_at || id) || chr(10) || chr(10)
  || '@node Top' || chr(10) || '@top Chat history for scope: ' || {ESC.format("scope")} || chr(10) || chr(10)
  || string_agg('@chapter Message by ' || {ESC.format("agent")} || ' (' || {ESC.format("role")} || ') at ' || created_at || chr(10) || {ESC.format("content")} || chr(10) || chr(10), '' ORDER BY created_at, id) || '@bye' || chr(10) AS document
FROM mem_conv WHERE role <> 'rule' GROUP BY scope""",
    "mem_conv",
)
oracle("texinfo_roundtrip", f"SELECT id, md5({ESC.format('t')}) AS escaped, true AS same FROM (SELECT id, replace(replace(content, 'e', chr(123) || 'e'), 'a', '@' || chr(125)) AS t FROM mem_conv)", "mem_conv")
oracle("rescope_counts", f"SELECT count(*) FILTER (rule_id IS NULL) AS memories, count(*) FILTER (rule_id IS NOT NULL) AS rules, (SELECT count(*) FROM fact_rows WHERE scope = {S}) AS facts FROM mem_conv WHERE scope = {S}", "mem_conv", "fact_rows")
oracle("rescope_conflicts", f"SELECT DISTINCT rule_id FROM mem_conv WHERE rule_id IS NOT NULL AND scope = {S}", "mem_conv")
oracle("rescope_apply", f"SELECT id, CASE WHEN scope = {S} AND role = 'user' THEN {O} ELSE scope END AS scope FROM mem_conv", "mem_conv")
STORE = "right(id, 1) IN ('0', '1')"
oracle("ingest_insert_or_ignore", f"SELECT id, content FROM mem_conv WHERE NOT {STORE}", "mem_conv")
oracle(
    "ingest_preview",
    f"""SELECT count(*) FILTER (NOT {STORE}) AS inserted, CAST(sum(CASE WHEN {STORE} THEN 1 + CAST(role = 'assistant' AS INTEGER) ELSE CAST(role = 'assistant' AS INTEGER) END) AS BIGINT) AS skipped_existing,
  CAST(coalesce(sum(1 + CAST(role = 'assistant' AS INTEGER)) FILTER ({STORE} AND scope <> {S}), 0) AS BIGINT) AS in_other_scopes FROM mem_conv""",
    "mem_conv",
)
oracle("ingest_other_scopes", f"SELECT scope, CAST(sum(1 + CAST(role = 'assistant' AS INTEGER)) AS BIGINT) AS n FROM mem_conv WHERE {STORE} AND scope <> {S} GROUP BY scope", "mem_conv")
oracle("session_bytes", "SELECT s.conv_id, CAST(coalesce(sum(length(t.text)), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT conv_id FROM conversations UNION SELECT DISTINCT -conv_id - 1 FROM conversations) s LEFT JOIN conversations t ON t.conv_id = s.conv_id AND t.role <> 'system' GROUP BY s.conv_id")
oracle("project_fields", "SELECT role, id, scope FROM mem_conv", "mem_conv")
oracle("grid_filter", "SELECT id, status FROM mem_conv WHERE contains(lower(id), 'tive') OR contains(lower(agent), 'tive') OR contains(lower(content), 'tive') OR contains(lower(coalesce(status, '')), 'tive')", "mem_conv")
oracle("grid_sort", "SELECT CAST(row_number() OVER (ORDER BY value IS NULL, value, event_id) - 1 AS INTEGER) AS rank, event_id, value FROM events")
oracle("grid_sections", f"SELECT 'rules' AS section, id, rule_id, status, NULL AS role FROM mem_conv WHERE {ACTIVE} UNION ALL SELECT 'memories', id, NULL, NULL, role FROM mem_conv WHERE valid_to IS NULL AND rule_id IS NULL", "mem_conv")
oracle("out_json", """SELECT '{"id":"' || id || '","scope":"' || scope || '","role":"' || role || '"' || coalesce(',"rule_id":"' || rule_id || '"', '') || '}' AS record FROM mem_conv""", "mem_conv")
CSV = r"""CASE WHEN regexp_matches(coalesce({0}, ''), '[",\r\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE coalesce({0}, '') END"""
oracle("out_csv", "SELECT id, " + " || ',' || ".join(CSV.format(c) for c in ("id", "scope", "content", "status")) + " AS line FROM mem_conv", "mem_conv")
ANSI = r"regexp_replace(content, '\x1b\[[0-9;]*[a-zA-Z]', '', 'g')"
REMIND = r"regexp_replace({0}, '(?s)<system-reminder>.*?</system-reminder>', '', 'g')"
scrub = "content"
STEPS = [("bearer-token", r"Bearer [A-Za-z0-9_.\-]{12,}", "Bearer [redacted:bearer-token]")] + [(kind, rf"{prefix}[A-Za-z0-9_\-]{{{least},}}", f"[redacted:{kind}]") for prefix, kind, least in CREDENTIALS]
for _, pattern, note in STEPS:
    scrub = f"regexp_replace({scrub}, {quoted(pattern)}, {quoted(note)}, 'g')"
oracle("redact_scrub", f"SELECT id, md5({scrub}) AS digest, contains({scrub}, '[redacted:') AS hit FROM mem_secret", "mem_secret")
kinds = {k: [p for kind, p, _ in STEPS if kind == k] for k in CREDENTIAL_KINDS}
counts = ", ".join("CAST(sum(" + (" + ".join(f"len(regexp_extract_all(content, {quoted(p)}))" for p in ps) or "0") + f") AS BIGINT) AS {k.replace('-', '_')}" for k, ps in kinds.items())
oracle("redaction_counts", f"SELECT {counts} FROM mem_secret", "mem_secret")
oracle("strip_ansi", f"SELECT id, md5({ANSI}) AS digest FROM mem_secret", "mem_secret")
oracle("strip_reminders", f"SELECT id, md5({REMIND.format('content')}) AS digest FROM mem_secret", "mem_secret")
CLEAN = rf"regexp_replace(regexp_replace({REMIND.format(ANSI)}, '^\s+', ''), '\s+$', '')"
oracle("normalize_turns", f"SELECT id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n FROM (SELECT id, CASE WHEN c = '' THEN NULL WHEN length(c) > 32768 THEN substr(c, 1, 32768) || chr(10) || '[truncated ' || (length(c) - 32768) || ' characters]' ELSE c END AS t FROM (SELECT id, {CLEAN} AS c FROM mem_secret))", "mem_secret")
BLANK = r"[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
oracle("normalize_text_key", f"SELECT id, md5(trim(regexp_replace(lower(translate(content, 'zq', chr(160) || chr(8195))), '{BLANK}', ' ', 'g'))) AS digest FROM mem_docs", "mem_docs")
oracle("mangle_path", r"SELECT page_id, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_\-]', '-', 'g'), ''), 'unknown') AS path, regexp_full_match(url, '[A-Za-z0-9_\-]+') AS safe FROM pages")
oracle("percent_decode", "SELECT page_id, url_decode(url || '%20' || '%2B%41') AS decoded FROM pages")
oracle("uuid5_turn_id", "SELECT conv_id, turn, " + uuid5("'memory-turn:claude-code:' || conv_id || ':' || turn") + " AS id FROM conversations")
oracle("uuid5_import_id", "SELECT id, " + uuid5("'memory-import:' || scope || ':' || agent || ':' || role || ':' || created_at || ':' || content") + " AS import_id FROM mem_conv", "mem_conv")
oracle("uuid5_fact_id", "SELECT id, " + uuid5("'memory-fact:' || id || ':' || content") + " AS fact_id FROM mem_docs", "mem_docs")
oracle("ts_normalize", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS utc, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.005Z') AS millis FROM events")
oracle("ordered_in_second", "SELECT event_id, strftime(make_timestamp((sec * 1000 + least(row_number() OVER (PARTITION BY sec ORDER BY event_id) - 1, 999)) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM (SELECT event_id, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS sec FROM events)")
oracle("anchor_series", f"SELECT conv_id, turn, strftime(TIMESTAMP '{START}' + to_seconds(CAST(conv_id * 60 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM conversations")
HELD = " UNION ALL ".join(f"SELECT {quoted(text)} AS query, '{kind}' AS kind, id FROM (SELECT id, {TERMS.format('content')} AS tt FROM mem_conv WHERE valid_to IS NULL AND rule_id IS NULL) WHERE list_contains(tt, {quoted(PHRASES[text][0][0])})" for text, kind in q.MEASURED)
QRELS = f"({HELD})"
FOUND = " UNION ALL ".join(f"SELECT {quoted(text)} AS query, id, rank FROM {ranked('(SELECT * FROM ' + bm25('mem_conv', 'content', text) + ' WHERE valid_to IS NULL)', 10)}" for text, _ in q.MEASURED)
oracle(
    "eval_metrics",
    f"""SELECT kind, count(*) AS queries, round(avg(h5 / n), 6) AS recall_at_5, round(avg(h10 / n), 6) AS recall_at_10, round(avg(coalesce(1.0 / (first + 1), 0)), 6) AS mrr FROM (
  SELECT query, kind, count(*) AS n, count(*) FILTER (rank < 5) AS h5, count(*) FILTER (rank < 10) AS h10, min(rank) AS first FROM {QRELS} LEFT JOIN ({FOUND}) USING (query, id) GROUP BY query, kind) GROUP BY kind""",
    "mem_conv",
)
oracle("eval_kind_shares", f"SELECT kind, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT kind, count(DISTINCT query) AS n FROM {QRELS} GROUP BY kind)", "mem_conv")
PARTS["msg"] = f"""SELECT 'session-' || conv_id AS session, CAST(turn AS INTEGER) AS line, role, coalesce(text, '') AS raw, strftime(TIMESTAMP '{START}' + to_seconds(CAST(conv_id * 3600 + turn AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, conv_id, turn FROM conversations"""
STORED = r"regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '')"
GOOD = f"role IN ('user', 'assistant') AND {STORED} <> ''"
KEYED = "session, session || '-' || line AS source_id, role"


def turn_query(name: str, columns: str, where: str = "true") -> None:
    oracle(name, f"SELECT {columns}, {STORED} AS text, created_at FROM msg WHERE {GOOD} AND {where}", "msg")


turn_query("src_claude_turns", KEYED, "line NOT IN (3, 4, 5)")
oracle(
    "filter_stats",
    f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN line = 5 THEN 'torn_line' WHEN role = 'system' THEN 'non_message' WHEN line = 3 THEN 'meta' WHEN line = 4 THEN 'sidechain' WHEN {STORED} = '' THEN 'empty' END AS reason FROM msg) WHERE reason IS NOT NULL GROUP BY reason",
    "msg",
)
oracle("json_blocks", "SELECT session, line, md5(CASE WHEN line % 2 = 0 THEN raw ELSE raw || chr(10) || chr(10) || '[tool_use: search]' END) AS digest FROM msg WHERE line <> 5", "msg")
POSITION = "({0}) || ':' || replace({1}, '-', '')"
turn_query("src_codex_turns", f"session, {POSITION.format('line * 2', uuid5(STORED))} AS source_id, role")
turn_query("src_kimi_turns", KEYED, "conv_id % 9 < 7")
turn_query("src_deepcode_turns", KEYED, "line <> 3")
oracle("src_opencode_turns", rf"SELECT {KEYED}, regexp_replace(regexp_replace(replace(raw, chr(10), chr(10) || chr(10)), '^\s+', ''), '\s+$', '') AS text, created_at FROM msg WHERE {GOOD}", "msg")
oracle(
    "src_copilot_unpivot",
    f"""SELECT session, (turn // 2) || ':' || role AS source_id, role, max({STORED}) AS text, min(least_at) AS created_at
FROM (SELECT *, min(created_at) OVER (PARTITION BY session, turn // 2) AS least_at FROM msg) WHERE {GOOD} GROUP BY session, turn // 2, role""",
    "msg",
)
FLAT = r"trim(regexp_replace(raw, '\s+', ' ', 'g'))"
oracle(
    "import_texinfo",
    f"SELECT scope AS name, CAST(row_number() OVER (PARTITION BY scope ORDER BY created_at, id) - 1 AS INTEGER) AS nth, agent, role, created_at, md5(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n+$', '')) AS digest FROM mem_conv WHERE role <> 'rule' AND {TRIM} <> ''",
    "mem_conv",
)
oracle("import_sniff", "SELECT session AS name, CASE WHEN conv_id % 2 = 0 THEN 'markdown' ELSE 'scrollback' END AS format FROM msg WHERE role <> 'system' GROUP BY session, conv_id", "msg")
SAID = {0: ("opencode", f"trim('## Root cause' || chr(10) || {FLAT}, ' ' || chr(10))"), 1: ("claude-code", f"trim({FLAT} || ' goes on')")}
SAYING = {
    odd: f"""SELECT session AS name, CAST(n AS INTEGER) AS nth, '{agent}' AS agent, role,
  strftime(CASE WHEN conv_id % 4 = 2 THEN TIMESTAMP '2026-07-07 00:39:41' ELSE TIMESTAMP '{START}' END + to_seconds(CAST(n AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, {text} AS text
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) - 1 AS n FROM msg WHERE role <> 'system' AND conv_id % 2 = {odd})"""
    for odd, (agent, text) in SAID.items()
}
oracle("import_markdown", SAYING[0], "msg")
oracle("import_scrollback", SAYING[1], "msg")
oracle("import_files", f"SELECT name, nth, 'proj' AS scope, agent, role, text FROM ({SAYING[0]} UNION ALL {SAYING[1]})", "msg")
turn_query("src_goose_turns", "session, CASE WHEN line % 2 = 0 THEN session || '-' || line ELSE 'row:' || line END AS source_id, role")
oracle("workspace_of", "SELECT page_id, '/w/' || regexp_replace(url, '[^a-z0-9/]', ' ', 'g') AS folder FROM pages")
oracle("stream_ingest", "SELECT " + uuid5("'memory-turn:log:' || session || ':' || line") + " AS id, 'chat' AS scope, role, raw AS text, created_at FROM msg WHERE role <> 'system'", "msg")
KIND = "CASE role WHEN 'user' THEN 'USER_INPUT' ELSE 'PLANNER_RESPONSE' END"
BODY = "CASE role WHEN 'user' THEN '<USER_REQUEST>' || raw || '</USER_REQUEST>' ELSE raw END"
STEP = f"""'["' || {KIND} || '","s",' || line || ',"' || created_at || '",' || CAST(to_json({BODY}) AS VARCHAR) || ',null,' || calls || ']'"""
oracle(
    "src_antigravity_turns",
    f"""SELECT session, replace({uuid5(STEP)}, '-', '') AS source_id, role, {STORED} AS text, CASE nth WHEN 0 THEN created_at ELSE replace(created_at, '.000Z', '.001Z') END AS created_at
FROM (SELECT *, unnest(['null', '[{{"args":{{"a":2,"z":1}},"name":"b"}}]']) AS calls, unnest([0, 1]) AS nth FROM msg WHERE conv_id % 10 <> 9) WHERE {GOOD}""",
    "msg",
)
oracle(
    "src_grok_runs",
    f""", marked AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY session ORDER BY line) = role THEN 0 ELSE 1 END AS new FROM msg WHERE role <> 'system'),
  runs AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY line) AS run FROM marked),
  closed AS (SELECT * FROM (SELECT *, max(run) OVER (PARTITION BY session) AS last FROM runs) WHERE run < last),
  joined AS (SELECT session, role, min(line) AS line, string_agg(raw, '' ORDER BY line) AS raw, min(created_at) AS created_at, arg_min(substr(raw, 1, length(raw) // 2), line) AS part FROM closed GROUP BY session, run, role)
SELECT session, {POSITION.format('line * 2', uuid5('part'))} AS source_id, role, {STORED} AS text, created_at FROM joined WHERE {STORED} <> ''""",
    "msg",
)

oracle("rescope_refused", f"SELECT id, scope FROM mem_conv UNION ALL SELECT id || 'x', {O} FROM mem_conv WHERE rule_id IS NOT NULL AND scope = {S}", "mem_conv")
oracle("rescope_whole", f"SELECT id, CASE WHEN scope = {S} THEN {O} ELSE scope END AS scope FROM mem_conv", "mem_conv")
oracle("rescope_facts", f"SELECT memory_id, CASE WHEN scope = {S} THEN {O} ELSE scope END AS scope, fact FROM fact_rows", "fact_rows")
LOGGED = uuid5("'memory-turn:log:' || session || ':' || line")
oracle("rescope_session", f"SELECT {LOGGED} AS id, CASE WHEN session = 'session-3' THEN {O} ELSE {S} END AS scope FROM msg", "msg")
oracle("store_migrate", "SELECT id, created_at, NULL::VARCHAR AS rule_id, NULL::VARCHAR AS status, NULL::VARCHAR AS valid_to, NULL::INTEGER AS access_count FROM mem_conv", "mem_conv")
oracle("remember", f"SELECT scope, agent, count(*) AS ids, CAST(sum(length(content)) AS BIGINT) AS chars, '{NOW}' AS created_at, CAST(0 AS BIGINT) AS closed FROM mem_conv GROUP BY scope, agent", "mem_conv")
oracle(
    "json_envelope",
    f"""SELECT '{{"metadata":{{"command":"recall","timestamp":"{NOW}"}},"data":[' || string_agg('{{"place":' || place || ',"id":"' || id || '","role":"' || role || '"}}', ',' ORDER BY place) || ']}}' AS envelope FROM ({recall(50, "valid_to IS NULL")})""",
    "mem_conv",
)
RECORD = """'{"id":"' || id || '","scope":"' || scope || '","role":"' || role || '"' || coalesce(',"rule_id":"' || rule_id || '"', '') || '}'"""
oracle("out_jsonl", f"""SELECT 0 AS part, '{{"metadata":{{"command":"export","timestamp":"{NOW}"}},"data":null}}' AS line UNION ALL SELECT 1, {RECORD} FROM mem_conv""", "mem_conv")
#: The 32 bits of a number: its sign, exponent and fraction, by their definition.
EXPONENT = "CAST(greatest(floor(log2(abs(x))), -126) AS INTEGER)"
FRACTION = f"CAST((abs(x) / pow(2.0, {EXPONENT}) - 1) * 8388608 AS BIGINT)"
WORD = f"CASE WHEN x = 0 THEN 0 ELSE ({EXPONENT} + 127) * 8388608 + {FRACTION} END + CASE WHEN x < 0 THEN 2147483648 ELSE 0 END"
LITTLE = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"
oracle("vector_codec", f"SELECT vec_id, string_agg({LITTLE}, '' ORDER BY i) AS blob, true AS same FROM (SELECT vec_id, i, printf('%08x', CAST({WORD} AS BIGINT)) AS h FROM (SELECT vec_id, CAST(unnest(CAST(embedding AS FLOAT[])) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY vec_id")
oracle("json_canonical", """SELECT id, '{"c":' || length(content) || ',"m":{"a":["' || id || '","' || agent || '"],"b":"' || role || '"},"z":"' || scope || '"}' AS json FROM mem_conv""", "mem_conv")
oracle("protocol_versions", "SELECT event_id, event_id % 3 > 1 OR (event_id % 3 = 1 AND event_id % 13 >= 3) AS timed, true AS malformed FROM events")
oracle("import_scope", "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'notes' ELSE 'p' || (page_id % 7) END AS scope FROM pages")
oracle("session_listing", "SELECT 'session-' || conv_id AS session, conv_id % 6 = 1 AS nested FROM conversations WHERE conv_id % 3 = 1 AND conv_id % 5 <> 4 GROUP BY conv_id")
oracle(
    "session_selected",
    """, s AS (SELECT conv_id, '/logs/session-' || conv_id || '.jsonl' AS session FROM conversations GROUP BY conv_id)
SELECT 'latest' AS asked, arg_max(session, conv_id) AS session FROM s UNION ALL SELECT 'session-3', session FROM s WHERE conv_id = 3 UNION ALL SELECT 'all', session FROM s""",
    "msg",
)
oracle(
    "filter_counters",
    f"""SELECT reason, CAST(2 * sum(n) AS BIGINT) AS n FROM (
  SELECT unnest({array(COUNTERS)}) AS reason, 0 AS n
  UNION ALL SELECT CASE WHEN line = 5 THEN 'torn_line' WHEN role = 'system' THEN 'non_message' WHEN line = 3 THEN 'meta' WHEN line = 4 THEN 'sidechain' WHEN {STORED} = '' THEN 'empty' END, 1 FROM msg
  UNION ALL SELECT 'tool_use', 1 FROM msg WHERE line % 2 = 1 AND line <> 5) WHERE reason IS NOT NULL GROUP BY reason""",
    "msg",
)

#: What the commits of the kept store come to.
KEPT = f"""
  SELECT id, CASE WHEN scope = 's1' AND role = 'user' THEN 's2' ELSE scope END AS scope, CASE WHEN again THEN 'keeper' ELSE agent END AS agent, CASE WHEN again THEN 'active' ELSE status END AS status,
    CASE WHEN again THEN '{NOW}' END AS updated_at, CASE WHEN valid_to IS NOT NULL THEN '{NOW}' END AS valid_to, superseded_by, CASE WHEN again THEN 'reworded thing: ' || content ELSE content END AS content,
    CASE WHEN role = 'assistant' THEN CASE WHEN right(id, 1) = '1' THEN 2 ELSE 1 END END AS access_count, role, created_at
  FROM (SELECT *, coalesce(role = 'rule' AND n % 3 = 0 AND n % 5 <> 0, false) AS again FROM (SELECT *, CAST(substr(rule_id, 2) AS BIGINT) AS n FROM mem_conv)) WHERE NOT coalesce(role = 'rule' AND n % 5 = 0, false)"""
oracle("store_now", f"SELECT id, scope, agent, status, updated_at, valid_to, superseded_by, CAST(access_count AS INTEGER) AS access_count, md5(content) AS digest FROM ({KEPT})", "mem_conv")
oracle("store_current", "SELECT id, scope, created_at FROM mem_conv WHERE valid_to IS NULL", "mem_conv")
oracle("store_search", f"SELECT rank, id, scope, round(score, 6) AS score FROM {ranked('(SELECT * FROM ' + bm25('(' + KEPT + ')', 'content', q.WORDS) + ' WHERE valid_to IS NULL)', 50)}", "mem_conv")
oracle(
    "store_versions",
    """SELECT CAST(v AS INTEGER) AS version, count(*) FILTER (NOT (v >= 5 AND purged)) AS memories, count(*) FILTER (v >= 3 AND valid_to IS NOT NULL) AS closed, count(*) FILTER (v >= 4 AND role = 'assistant') AS counted,
      count(*) FILTER (NOT (v >= 5 AND purged) AND (scope = 's2' OR v >= 6 AND scope = 's1' AND role = 'user')) AS moved
    FROM (SELECT *, coalesce(role = 'rule' AND CAST(substr(rule_id, 2) AS BIGINT) % 5 = 0, false) AS purged FROM mem_conv), range(1, 7) t(v) WHERE v >= 2 OR right(id, 1) IN ('0', '1') GROUP BY v""",
    "mem_conv",
)
oracle("vector_codec_special", ORACLE["vector_codec"].replace("string_agg(", "", 0).replace(" AS blob, true", " || '00000000000000800000807f000080ff0000c07f' AS blob, true"))
oracle(
    "stream_steps",
    f"""SELECT {uuid5("'memory-turn:antigravity:' || session || ':' || source_id")} AS id, 'antigravity' AS agent, role, text AS content, created_at FROM (
SELECT session, replace({uuid5(STEP)}, '-', '') AS source_id, role, {STORED} AS text, CASE nth WHEN 0 THEN created_at ELSE replace(created_at, '.000Z', '.001Z') END AS created_at
FROM (SELECT *, unnest(['null', '[{{"args":{{"a":2,"z":1}},"name":"b"}}]']) AS calls, unnest([0, 1]) AS nth FROM msg) WHERE {GOOD})""",
    "msg",
)
ORACLE["stream_chunks"] = ORACLE["src_grok_runs"].replace("SELECT session, (line", f"SELECT {uuid5(chr(39) + 'memory-turn:grok:' + chr(39) + ' || session || ' + chr(39) + ':' + chr(39) + ' || source_id')} AS id, 'grok' AS agent, role, text AS content, created_at FROM (SELECT session, (line") + ")"
oracle(
    "synthetic_turns",
    f"""SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT unnest(['command_synthetic', 'empty', 'non_message']) AS reason, 0 AS n
  UNION ALL SELECT CASE WHEN role = 'system' THEN 'non_message' WHEN line = 2 THEN 'command_synthetic' WHEN line NOT IN (3, 4) AND {STORED} = '' THEN 'empty' END, 1 FROM msg WHERE line <> 5) WHERE reason IS NOT NULL GROUP BY reason""",
    "msg",
)
PART = 40
CHAPTER = f"'@chapter Message by ' || {ESC.format('agent')} || ' (' || {ESC.format('role')} || ') at ' || created_at || chr(10) || {ESC.format('content')} || chr(10) || chr(10)"
oracle(
    "archive_parts",
    f"""SELECT scope, part, md5(CASE WHEN part = 0 THEN head ELSE '' END || body || CASE WHEN part = most THEN '@bye' || chr(10) ELSE '' END) AS digest FROM (
  SELECT *, max(part) OVER (PARTITION BY scope) AS most, '\\input texinfo' || chr(10) || '@documentencoding UTF-8' || chr(10) || '@settitle Chat history for scope: ' || {ESC.format("scope")} || chr(10) || '@c Messages: ' || sum(n) OVER (PARTITION BY scope) || chr(10)
    || '@c Through: ' || max(through) OVER (PARTITION BY scope) || chr(10) || chr(10) || '@node Top' || chr(10) || '@top Chat history for scope: ' || {ESC.format("scope")} || chr(10) || chr(10) AS head
  FROM (SELECT scope, place // {PART} AS part, count(*) AS n, max(created_at) AS through, string_agg({CHAPTER}, '' ORDER BY place) AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at, id) - 1 AS place FROM mem_conv WHERE role <> 'rule') GROUP BY scope, place // {PART}))""",
    "mem_conv",
)
NEEDLES = "['thing', 'Eaux', 'er', 'ß', 'q', 'no such text at all', '. th']"
oracle("substring_search", f"SELECT needle, id FROM mem_docs, (SELECT unnest({NEEDLES}) AS needle) WHERE contains(lower(content), lower(needle))", "mem_docs")
oracle("store_as_of", f"SELECT id, scope, valid_to FROM mem_conv WHERE created_at <= '{q.AS_OF}' AND (valid_to IS NULL OR valid_to > '{q.AS_OF}')", "mem_conv")
oracle("session_recorded", "SELECT '/logs/rollout-' || conv_id || '.jsonl' AS session FROM conversations WHERE conv_id % 3 = 1 AND conv_id % 5 <> 4 AND conv_id % 7 <> 6 GROUP BY conv_id")
oracle("session_located", "SELECT CAST(conv_id AS VARCHAR) AS asked, '/logs/rollout-' || conv_id || '.jsonl' AS session FROM conversations WHERE conv_id IN (1, 3) GROUP BY conv_id")
