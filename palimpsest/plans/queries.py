"""The registered queries over the driver's tables: each applies one operator to whole projections."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from functools import reduce

from palimpsest.functions import ids, times
from palimpsest.functions import text as tx
from palimpsest.operators import consolidate as cx
from palimpsest.operators import facts as fx
from palimpsest.operators import fuse as ux
from palimpsest.operators import grams as gr
from palimpsest.operators import grid as gx
from palimpsest.operators import lifecycle as lx
from palimpsest.operators import postings as pi
from palimpsest.operators import search as sx
from palimpsest.operators import store as ox
from palimpsest.operators import vectors as vx
from palimpsest.sources import exports as ex
from palimpsest.sources import files
from palimpsest.sources import projections as px
from palimpsest.sources import transcripts as tr
from palimpsest.streaming import ingest as si
from palimpsest.streaming import sessions as ss
from palimpsest.sources.projections import NOW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: What the search queries ask: words of all four languages, and a phrase.
WORDS = "thing of-the Éauxré lichen ertion ciónmente the"
SCOPE, OTHER, BUDGET = "s1", "s2", 600
AS_OF = "2024-01-03T00:00:00.000Z"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def ready(spark: SparkSession) -> None:
    """Iterative operators need a checkpoint folder; a session without one (as in tests) gets its own."""
    import tempfile

    if spark.sparkContext.getConf().get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ready(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (conf or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


_made: dict[tuple, object] = {}


def once(spark: SparkSession, rows: DataFrame, name: str, make: Callable[[str], object]) -> object:
    """What ``make`` makes in a folder of its own, once for an application, plan and state (paths, sizes, times) of the files that it reads."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, rows.semanticHash(), files.state(spark, rows.inputFiles()))
    if key not in _made:
        _made[key] = make(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[key]


def index_of(spark: SparkSession, rows: DataFrame, text: str = "content") -> pi.Index:
    """The full-text index of a projection."""
    return once(spark, rows.select("id", text), "index", lambda path: pi.build(rows, path, text))


def facts_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The facts of a projection, extracted and written, as a store holds them beside its memories."""

    def write(path: str) -> tuple:
        facts = fx.extract(rows)
        facts.write.parquet(path)
        return path, facts.schema

    path, schema = once(spark, rows, "facts", write)
    return spark.read.schema(schema).parquet(path)


LIST = ("id", "scope", "role", "created_at", "valid_to")


@query
def get_by_id(spark, d):
    return sx.get(px.mem_conv(spark, d), "c000003-001").select(*px.MEMORY)


@query
def export_history(spark, d):
    return sx.export_history(px.mem_conv(spark, d), SCOPE).select("id", "role", "content", "created_at", "superseded_by")


@query
def recall_current(spark, d):
    return sx.recall(px.mem_conv(spark, d), SCOPE).select("place", *LIST)


@query
def recall_as_of(spark, d):
    return sx.recall(px.mem_conv(spark, d), SCOPE, validity=sx.Validity(as_of=AS_OF)).select("place", *LIST)


@query
def recall_all(spark, d):
    return sx.recall(px.mem_conv(spark, d), SCOPE, limit=1000, validity=sx.Validity(all=True)).select("place", *LIST)


@query
def rules_active(spark, d):
    return ux.active_rules(px.mem_conv(spark, d)).select("scope", "rule_id", "content", "status")


@query
def rules_all(spark, d):
    return px.mem_conv(spark, d).where("rule_id IS NOT NULL").select("scope", "rule_id", "agent", "created_at", "status")


@query
def rules_tokens(spark, d):
    return ux.active_rules(px.mem_conv(spark, d)).groupBy("scope").agg(F.sum(tx.tokens_about(F.col("content"))).alias("tokens"))


@query
def fts_match(spark, d):
    m = px.mem_docs(spark, d)
    return sx.matching(m, "thing Éauxré lichen", index=index_of(spark, m)).select("id", "scope")


@query
def fts_search(spark, d):
    m = px.mem_docs(spark, d)
    return sx.search(m, WORDS, index=index_of(spark, m)).select("rank", "id", "scope", F.round("score", 6).alias("score"))


@query
def fts_search_scoped(spark, d):
    m = px.mem_docs(spark, d)
    return sx.search(m, WORDS, scope="fr", limit=50, index=index_of(spark, m)).select("rank", "id", F.round("score", 6).alias("score"))


@query
def fts_search_unindexed(spark, d):
    """The same search of turns without an index: every text is read."""
    return sx.search(px.mem_conv(spark, d), WORDS).select("rank", "id", "scope", F.round("score", 6).alias("score"))


def _blanks(text: F.Column) -> F.Column:
    """Some letters as white space of other scripts: a no-break space and an em space."""
    return F.translate(text, "zq", "\u00a0\u2003")


@query
def fts_sanitize(spark, d):
    return px.mem_conv(spark, d).select("id", tx.fts_quoted(_blanks(F.col("content"))).alias("quoted"))


@query
def token_estimate(spark, d):
    return px.mem_docs(spark, d).select("id", tx.tokens_about(F.col("content")).alias("tokens"))


@query
def facts_extract(spark, d):
    return fx.extract(px.mem_conv(spark, d)).select("id", "memory_id", "scope", "fact")


@query
def facts_report(spark, d):
    return fx.report(px.mem_conv(spark, d))


@query
def fact_candidates(spark, d):
    m = px.mem_conv(spark, d)
    facts = facts_of(spark, m)
    return fx.candidates(facts, m, WORDS, limit=50, index=index_of(spark, facts, "fact")).select("rank", "id", F.round("score", 6).alias("score"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The query's vector: that of vec_id 0."""
    row = px.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row["embedding"]) if row else [0.0]


@query
def vector_topk(spark, d):
    found = vx.topk(px.vectors(spark, d), px.mem_docs(spark, d), _query_vector(spark, d), "m", limit=50)
    return found.select("rank", "id", F.round("score", 6).alias("score"))


@query
def vector_count(spark, d):
    return px.vectors(spark, d).groupBy("model").agg(F.count("*").alias("n"))


@query
def vector_upsert(spark, d):
    v = px.vectors(spark, d)
    new = v.where(F.substring("memory_id", 2, 18).cast("long") % 3 == 0).withColumn("model", F.lit("n"))
    return vx.upsert(v, new).select("memory_id", "model", F.size("embedding").alias("dim"))


@query
def unindexed(spark, d):
    return vx.unindexed(px.mem_docs(spark, d), px.vectors(spark, d), "m").select("id", "created_at")


@query
def unindexed_count(spark, d):
    return vx.unindexed(px.mem_docs(spark, d), px.vectors(spark, d), "m").groupBy("scope").agg(F.count("*").alias("n"))


@query
def index_progress(spark, d):
    return vx.progress(px.mem_docs(spark, d), px.vectors(spark, d), "m")


@query
def cosine_pairs(spark, d):
    v = px.vectors(spark, d).select("memory_id", "embedding")
    n = F.format_string("d%06d", F.substring("memory_id", 2, 18).cast("long") + 1)
    nxt = v.select(F.col("memory_id").alias("other"), F.col("embedding").alias("next"))
    return v.join(nxt, n == nxt["other"]).select("memory_id", "other", F.round(vx.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def _channels(spark, d):
    m = px.mem_docs(spark, d)
    facts = facts_of(spark, m)
    return m, ux.channels_of(m, facts, px.vectors(spark, d), WORDS, _query_vector(spark, d), "m", index=index_of(spark, m), fact_index=index_of(spark, facts, "fact"))


@query
def rrf_fuse(spark, d):
    _, channels = _channels(spark, d)
    return ux.fuse(channels).select("id", F.round("score", 8).alias("score"))


@query
def hybrid_search(spark, d):
    m, channels = _channels(spark, d)
    return ux.hybrid(m, channels).select("rank", "id", "scope", F.round("score", 8).alias("score"))


@query
def hybrid_channel_counts(spark, d):
    return ux.channel_counts(_channels(spark, d)[1])


@query
def hybrid_gate(spark, d):
    v = px.vectors(spark, d)
    return ux.gate(v, "m").unionAll(ux.gate(v, "absent"))


@query
def budget_recall(spark, d):
    return ux.budget_recall(px.mem_conv(spark, d), SCOPE, BUDGET).select("id", "cost", "included", "nth")


@query
def budget_search(spark, d):
    m = px.mem_docs(spark, d)
    return ux.budget_search(m, WORDS, 2500, index=index_of(spark, m)).select("id", "cost", "included", "nth")


@query
def context_recency(spark, d):
    m = px.mem_conv(spark, d)
    _, rows = ux.context(m, fx.extract(m), SCOPE, BUDGET)
    return rows.where("included").select("id", "cost", "created_at")


@query
def context_query(spark, d):
    m = px.mem_conv(spark, d)
    facts = facts_of(spark, m)
    _, rows = ux.context(m, facts, SCOPE, BUDGET, query=WORDS, index=index_of(spark, m), fact_index=index_of(spark, facts, "fact"))
    return rows.where("included").select("id", "cost", "created_at")


@query
def context_report(spark, d):
    m = px.mem_conv(spark, d)
    rules, rows = ux.context(m, fx.extract(m), SCOPE, BUDGET)
    n = rules.agg(F.count("*").alias("rules"), F.coalesce(F.sum(tx.tokens_about(F.col("content"))), F.lit(0)).alias("rules_tokens"))
    return ux.budget_report(rows, BUDGET, "recency").crossJoin(n)


@query
def dedup_exact(spark, d):
    return cx.exact_groups(px.mem_docs(spark, d))


@query
def dedup_vector_edges(spark, d):
    return vx.twin_pairs(px.vectors(spark, d), px.mem_docs(spark, d), "m").select("scope", "a", "b", F.round("similarity", 6).alias("similarity"))


def _edges(spark, d):
    ready(spark)
    m = px.mem_docs(spark, d)
    return m, vx.twin_edges(px.vectors(spark, d), m, "m")


@query
def dedup_components(spark, d):
    m, near = _edges(spark, d)
    return cx.components(cx.exact_edges(m).select("a", "b").unionAll(near.select("a", "b")))


@query
def dedup_groups(spark, d):
    return cx.dedup_groups(*_edges(spark, d))


@query
def dedup_apply(spark, d):
    m, near = _edges(spark, d)
    return cx.losers_closed(m, cx.dedup_losers(m, near), NOW).select("id", "scope", "valid_to", "superseded_by")


@query
def contradictions(spark, d):
    ready(spark)
    return cx.contradictions(px.mem_neg(spark, d)).select("scope", "a", "b", F.round("jaccard", 6).alias("jaccard"), "negated")


@query
def contradiction_members(spark, d):
    """The memories of each class that ``contradictions`` pairs."""
    ready(spark)
    return cx.word_classes(px.mem_neg(spark, d))[1]


@query
def access_counts(spark, d):
    return cx.access_counts(px.access_log(spark, d))


@query
def decay_top20(spark, d):
    rows = cx.decay(px.mem_docs(spark, d), cx.access_counts(px.access_log(spark, d)), NOW)
    return rows.withColumn("age_days", F.round("age_days", 6)).withColumn("staleness", F.round("staleness", 6))


def _log(spark, d):
    m = px.mem_conv(spark, d).where("valid_to IS NOT NULL")
    first = m.select("id", "valid_to", "superseded_by", F.lit(1).alias("seq"))
    return first.unionAll(first.select("id", F.lit(NOW), F.lit("x"), F.lit(2)))


@query
def supersede_fold(spark, d):
    return lx.superseded(px.mem_conv(spark, d), _log(spark, d)).select("id", "valid_to", "superseded_by")


@query
def supersede_outcome(spark, d):
    m = px.mem_conv(spark, d)
    asked = m.select(F.col("id").alias("target"), F.when(F.substring("id", -1, 1) == "1", "s9").otherwise(F.col("scope")).alias("scope"))
    return lx.supersede_outcome(m, asked)


@query
def supersession_chain(spark, d):
    ready(spark)
    return lx.chain(px.mem_conv(spark, d))


def _events(spark, d):
    r = px.mem_conv(spark, d).where("rule_id IS NOT NULL").withColumn("n", F.substring("rule_id", 2, 18).cast("long"))
    event = lambda op, ts, seq, text="content": F.struct(F.lit(op).alias("op"), F.col(text).alias("text"), ts.alias("ts"), F.lit(seq).alias("seq"))
    none = F.lit(None).cast("struct<op:string,text:string,ts:string,seq:int>")
    later = F.lit(NOW)
    each = F.array(
        event("add", F.col("created_at"), 1), F.when(F.col("n") % 2 == 1, event("retire", later, 2)).otherwise(none), F.when(F.col("n") % 5 == 0, event("purge", later, 3)).otherwise(none),
        F.when(F.col("n") % 3 == 0, event("add", later, 4, "upper")).otherwise(none),
    )
    # One letter for one, as in SQL: the sharp s has a capital of its own and doesn't become two.
    rows = r.withColumn("upper", F.upper(F.translate("content", "ß", "ẞ"))).select("scope", "rule_id", "agent", F.explode(each).alias("e")).where("e IS NOT NULL")
    return rows.select("scope", "rule_id", "agent", "e.*")


@query
def rule_fold(spark, d):
    return lx.rules(_events(spark, d)).select("scope", "rule_id", "text", "created_at", "updated_at", "status")


def _asked(spark, d):
    m = px.mem_conv(spark, d)
    return m, m.where("rule_id IS NOT NULL").select("scope", "rule_id").unionAll(m.where("role = 'user'").select("scope", F.col("id").alias("rule_id")))


@query
def rule_retire_outcome(spark, d):
    return lx.retire_outcome(*_asked(spark, d))


@query
def rule_purge_outcome(spark, d):
    return lx.purge_outcome(*_asked(spark, d))


@query
def rule_validate(spark, d):
    m = px.mem_conv(spark, d)
    rid = F.when(F.col("rule_id").isNotNull(), F.col("rule_id")).when(F.col("role") == "user", F.substring("content", 1, 100)).otherwise(F.replace(F.col("content"), F.lit(" "), F.lit("-")))
    return m.select("id", tx.rule_fault(rid, F.col("content")).alias("fault"))


@query
def rules_render(spark, d):
    return lx.rules_block(ux.active_rules(px.mem_conv(spark, d)))


@query
def archive_render(spark, d):
    return lx.archive(px.mem_conv(spark, d))


@query
def archive_parts(spark, d):
    """Archives in parts of 40 chapters."""
    ready(spark)
    return lx.archive_parts(px.mem_conv(spark, d), 40).select("scope", "part", F.md5(F.encode("document", "UTF-8")).alias("digest"))


@query
def texinfo_roundtrip(spark, d):
    text = F.replace(F.replace(F.col("content"), F.lit("e"), F.lit("{e")), F.lit("a"), F.lit("@}"))
    t = px.mem_conv(spark, d).select("id", text.alias("t"))
    return t.select("id", F.md5(F.encode(tx.texinfo_escaped(F.col("t")), "UTF-8")).alias("escaped"), (tx.texinfo_unescaped(tx.texinfo_escaped(F.col("t"))) == F.col("t")).alias("same"))


@query
def rescope_counts(spark, d):
    m = px.mem_conv(spark, d)
    return lx.rescope_counts(m, fx.extract(m), SCOPE)


@query
def rescope_conflicts(spark, d):
    m = px.mem_conv(spark, d)
    twice = m.unionAll(m.where("rule_id IS NOT NULL AND scope = 's1'").withColumn("scope", F.lit(OTHER)))
    return lx.rescope_conflicts(twice, OTHER, SCOPE)


@query
def rescope_apply(spark, d):
    m = px.mem_conv(spark, d)
    return lx.rescoped(m, SCOPE, OTHER, m.where("role = 'user'").select("id")).select("id", "scope")


def _turns(spark, d):
    """A store of the first half of each conversation, and all turns, some twice, as a batch."""
    m = px.mem_conv(spark, d).withColumn("ordinal", F.lit(1))
    store = m.where("substr(id, -1) IN ('0', '1')").drop("ordinal")
    batch = m.unionAll(m.where("role = 'assistant'").withColumn("ordinal", F.lit(2)).withColumn("content", F.lit("again")))
    return store, batch


@query
def ingest_insert_or_ignore(spark, d):
    return lx.insert_or_ignore(*_turns(spark, d)).select("id", "content")


@query
def ingest_preview(spark, d):
    store, batch = _turns(spark, d)
    return lx.ingest_report(store, batch, SCOPE)


@query
def ingest_other_scopes(spark, d):
    return lx.other_scopes(*_turns(spark, d), SCOPE)


@query
def rescope_refused(spark, d):
    """A whole scope isn't moved where one of its rules meets one of the target."""
    m = px.mem_conv(spark, d)
    twice = m.unionAll(m.where("rule_id IS NOT NULL AND scope = 's1'").withColumn("scope", F.lit(OTHER)).withColumn("id", F.concat("id", F.lit("x"))))
    return lx.rescoped(twice, SCOPE, OTHER).select("id", "scope")


@query
def rescope_whole(spark, d):
    return lx.rescoped(px.mem_conv(spark, d), SCOPE, OTHER).select("id", "scope")


@query
def rescope_facts(spark, d):
    m = px.mem_conv(spark, d)
    return lx.facts_rescoped(fx.extract(m), m, lx.rescoped(m, SCOPE, OTHER)).select("memory_id", "scope", "fact")


@query
def rescope_session(spark, d):
    """Ingested turns of which those of one session change their scope."""
    turns = _message(spark, d).select("session", F.col("line").cast("string").alias("source_id"))
    m = turns.select(ids.turn_id(F.lit("log"), F.col("session"), F.col("source_id")).alias("id"), F.lit(SCOPE).alias("scope"), F.lit(None).cast("string").alias("rule_id"))
    return lx.rescoped(m, SCOPE, OTHER, lx.session_selection(turns, "log", "session-3")).select("id", "scope")


@query
def store_migrate(spark, d):
    """A store of the first version, with today's columns."""
    old = px.mem_conv(spark, d).select(*[c for c, _ in lx.MEMORY_SCHEMA[:6]])
    return lx.migrated(old).select("id", "created_at", "rule_id", "status", "valid_to", "access_count")


@query
def remember(spark, d):
    """Turns remembered as new memories, whose ids are as many as they."""
    base = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    lx.remember(base, px.mem_conv(spark, d).select("agent", "scope", "role", "content"), NOW)
    back = spark.read.parquet(base)
    return back.groupBy("scope", "agent").agg(F.countDistinct("id").alias("ids"), F.sum(F.char_length("content")).alias("chars"), F.min("created_at").alias("created_at"), F.count("valid_to").alias("closed"))


def _kept(spark, d) -> ox.Store:
    """A store that turns were ingested into (half of them, then all), in which some were superseded, counted, moved and made rules of, in one commit each."""
    m = px.mem_conv(spark, d)

    def make(path: str) -> ox.Store:
        store, plain = ox.Store(spark, path), m.drop("valid_from", "valid_to", "superseded_by")
        store.ingest(plain.where("substr(id, -1) IN ('0', '1')"))
        store.ingest(plain)
        store.supersede(m.where("valid_to IS NOT NULL").select(F.col("id").alias("target"), "scope", "superseded_by"), NOW)
        seen = m.where("role = 'assistant'").select("id", F.lit(NOW).alias("ts"))
        store.touch(seen.unionAll(seen.where("substr(id, -1) = '1'")))
        r = m.where("rule_id IS NOT NULL").withColumn("n", F.substring("rule_id", 2, 18).cast("long"))
        event = lambda rows, op, seq, text: rows.select("scope", "rule_id", F.lit("keeper").alias("agent"), F.lit(op).alias("op"), text.alias("text"), F.lit(NOW).alias("ts"), F.lit(seq).alias("seq"))
        none = F.lit(None).cast("string")
        fives = r.where("n % 5 = 0")
        events = event(fives, "retire", 1, none).unionAll(event(fives, "purge", 2, none)).unionAll(event(r.where("n % 3 = 0 AND n % 5 <> 0"), "add", 3, F.concat(F.lit("reworded thing: "), "content")))
        store.set_rules(events)
        store.rescope(SCOPE, OTHER, m.where("role = 'user'").select("id"))
        return store

    return once(spark, m, "kept", make)


@query
def store_now(spark, d):
    """What the commits leave."""
    return _kept(spark, d).memories().select("id", "scope", "agent", "status", "updated_at", "valid_to", "superseded_by", "access_count", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query
def store_versions(spark, d):
    """Every version as it was."""
    store = _kept(spark, d)
    one = lambda n: store.memories(n).agg(F.lit(n).alias("version"), F.count("*").alias("memories"), F.count("valid_to").alias("closed"), F.count("access_count").alias("counted"), F.count_if(F.col("scope") == OTHER).alias("moved"))
    return reduce(DataFrame.unionAll, [one(n) for n in range(1, 1 + store.version().number)], one(0).limit(0))


@query
def store_current(spark, d):
    """Current memories after compaction, from their own files."""
    store = ox.Store(spark, f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}")
    m = px.mem_conv(spark, d)
    store.ingest(m)
    store.compact()
    return store.memories(validity=sx.CURRENT).select("id", "scope", "created_at")


@query
def store_as_of(spark, d):
    """Memories as they were at an instant, without the months that were closed before it."""
    store = ox.Store(spark, f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}")
    store.ingest(px.mem_conv(spark, d))
    store.compact()
    return store.memories(validity=sx.Validity(as_of=AS_OF)).select("id", "scope", "valid_to")


@query
def store_search(spark, d):
    """A search by the index that the commits have kept in step: superseded turns leave it, reworded rules are found by their new words."""
    store = _kept(spark, d)
    return sx.search(store.memories(), WORDS, limit=50, index=store.index()).select("rank", "id", "scope", F.round("score", 6).alias("score"))


@query
def json_envelope(spark, d):
    rows = sx.recall(px.mem_conv(spark, d), SCOPE).select("place", "id", "role")
    return gx.enveloped(rows, "recall", NOW, "place")


@query
def out_jsonl(spark, d):
    return gx.json_lines(px.mem_conv(spark, d).select("id", "scope", "role", "rule_id"), "export", NOW)


@query
def vector_codec(spark, d):
    v = px.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    v = v.select("vec_id", "v", F.inline(F.array(F.struct(vx.encoded(F.col("v")).alias("blob")))))
    return v.select("vec_id", F.lower(F.hex("blob")).alias("blob"), (vx.decoded(F.col("blob")) == F.col("v")).alias("same"))


@query
def vector_codec_special(spark, d):
    """Every vector with zeros of both signs, infinities and what is no number behind it."""
    special = F.array(*[F.lit(x).cast("float") for x in (0.0, -0.0, float("inf"), float("-inf"), float("nan"))])
    v = px.table(spark, d, "embeddings").select("vec_id", F.concat(F.col("embedding").cast("array<float>"), special).alias("v"))
    v = v.select("vec_id", "v", F.inline(F.array(F.struct(vx.encoded(F.col("v")).alias("blob")))))
    return v.select("vec_id", F.lower(F.hex("blob")).alias("blob"), (vx.decoded(F.col("blob")) == F.col("v")).alias("same"))


@query
def json_canonical(spark, d):
    """An object's keys in order, whatever their order was."""
    m = px.mem_conv(spark, d)
    given = F.to_json(F.struct(F.col("scope").alias("z"), F.struct(F.col("role").alias("b"), F.array("id", "agent").alias("a")).alias("m"), F.length("content").alias("c")))
    return m.select("id", tx.canonical_json(given).alias("json"))


@query
def protocol_versions(spark, d):
    e = px.table(spark, d, "events").select("event_id", F.concat_ws(".", (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 13).cast("string")).alias("v"))
    timed = tx.protocol(F.col("v")) >= F.struct(F.lit(1).alias("major"), F.lit(3).alias("minor"))
    return e.select("event_id", timed.alias("timed"), tx.protocol(F.concat("v", F.lit("x"))).isNull().alias("malformed"))


@query
def import_scope(spark, d):
    """The project of exports that lie in, below or outside a chat folder."""
    n = F.col("page_id") % 3
    path = F.concat(F.lit("/home/u/p"), (F.col("page_id") % 7).cast("string"), F.when(n == 0, "/chat/x.texi").when(n == 1, "/chats/2026/x.texi").otherwise("/notes/x.texi"))
    return px.table(spark, d, "pages").select("page_id", tx.chat_scope(path).alias("scope"))


def _summaries(spark, d):
    t = px.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    uris = F.concat(F.lit('["file:///w/p'), (F.col("conv_id") % 3).cast("string"), F.lit('","https://x/y"]'))
    return t.select(
        "conv_id", F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("conversation_id"), F.when(F.col("conv_id") % 5 == 4, "torn").otherwise(uris).alias("workspace_uris"),
        F.when(F.col("conv_id") % 6 == 1, "session-0").otherwise("").alias("parent_conversation_id"), F.lit(0).alias("nesting_depth"),
    )


@query
def session_listing(spark, d):
    """The sessions of one working folder, by what their harness knows of them."""
    s = _summaries(spark, d)
    listing = s.select(F.col("conversation_id").alias("session"), F.timestamp_seconds(F.col("conv_id")).alias("modified"))
    return tr.in_workspace(listing, tr.session_owners(s), "/w/p1").select("session", "nested")


def _recorded(spark, d):
    """The first lines of logs: most record their working folder, some are torn or of another kind."""
    t = px.table(spark, d, "conversations").select("conv_id").distinct()
    kind = F.when(F.col("conv_id") % 7 == 6, "event_msg").otherwise("session_meta")
    line = _json(type=kind, payload=F.struct(F.concat(F.lit("/w/p"), (F.col("conv_id") % 3).cast("string")).alias("cwd")))
    name = F.concat(F.lit("/logs/rollout-"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    value = F.when(F.col("conv_id") % 5 == 4, F.substring(line, 1, 30)).otherwise(line)
    first = t.select("conv_id", name.alias("session"), F.lit(0).alias("line"), value.alias("value"))
    # A later record of the kind changes nothing.
    return first, first.drop("conv_id").unionAll(first.select("session", F.lit(1), F.lit('{"type":"session_meta","payload":{"cwd":"/w/p1"}}')))


@query
def session_recorded(spark, d):
    """The sessions of a working folder, by what their first lines record."""
    first, lines = _recorded(spark, d)
    listing = first.select("session", F.timestamp_seconds(F.col("conv_id")).alias("modified"))
    return tr.in_workspace(listing, tr.recorded_owners(lines), "/w/p1").select("session")


@query
def session_located(spark, d):
    """Sessions asked for by name from one working folder: its own, another folder's, and one that isn't there."""
    first, lines = _recorded(spark, d)
    listing = first.select("session", F.timestamp_seconds(F.col("conv_id")).alias("modified"))
    mine = tr.in_workspace(listing, tr.recorded_owners(lines), "/w/p1")
    return reduce(DataFrame.unionAll, [tr.located(mine, listing, f"rollout-{n}").select(F.lit(n).alias("asked"), "session") for n in ("1", "3", "none")])


@query
def session_selected(spark, d):
    s = _summaries(spark, d)
    listing = s.select(F.concat(F.lit("/logs/"), "conversation_id", F.lit(".jsonl")).alias("session"), F.timestamp_seconds(F.col("conv_id")).alias("modified"))
    pick = lambda which: tr.selected(listing, which).select(F.lit(which).alias("asked"), "session")
    return pick("latest").unionAll(pick("session-3")).unionAll(pick("absent")).unionAll(pick("all"))


@query
def filter_counters(spark, d):
    """All thirteen counters of a reader, twice, merged."""
    lines = _block_lines(spark, d)
    once = tr.counters(tr.block_log(lines), lines)
    return tr.merged(once, once)


@query
def session_bytes(spark, d):
    t = px.table(spark, d, "conversations")
    sessions = t.select("conv_id").distinct().unionAll(t.select((-F.col("conv_id") - 1).alias("conv_id")).distinct())
    return sessions.join(t.where("role <> 'system'").select("conv_id", F.char_length("text").alias("n")), "conv_id", "left").groupBy("conv_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"))


@query
def project_fields(spark, d):
    return gx.projected(px.mem_conv(spark, d), ["role", "id", "absent", "scope", "id"])


@query
def grid_filter(spark, d):
    return gx.filtered(px.mem_conv(spark, d).select("id", "agent", "content", "status"), "TIVE").select("id", "status")


#: Texts that substring searches look for: of all lengths, with letters of other cases.
NEEDLES = ("thing", "Eaux", "er", "ß", "q", "no such text at all", ". th")


@query
def substring_search(spark, d):
    """Rows that contain a text, by an index of three letters."""
    m = px.mem_docs(spark, d)
    grams = once(spark, m.select("id", "content"), "grams", lambda path: gr.build(m, path))
    return reduce(DataFrame.unionAll, [gr.containing(grams, m, x).select(F.lit(x).alias("needle"), "id") for x in NEEDLES])


@query
def grid_sort(spark, d):
    ready(spark)
    return gx.ranked(px.table(spark, d, "events").select("event_id", "value"), "value", "event_id").select("rank", "event_id", "value")


@query
def grid_sections(spark, d):
    m = px.mem_conv(spark, d)
    return gx.sections({"rules": ux.active_rules(m).select("id", "rule_id", "status"), "memories": cx.plain(m).select("id", "role")}).select("section", "id", "rule_id", "status", "role")


@query
def out_json(spark, d):
    return gx.as_json(px.mem_conv(spark, d).select("id", "scope", "role", "rule_id"))


@query
def out_csv(spark, d):
    return gx.as_csv(px.mem_conv(spark, d).select("id", "scope", "content", "status"), "id")


@query
def redact_scrub(spark, d):
    return px.mem_secret(spark, d).select("id", F.md5(F.encode(tx.scrubbed(F.col("content")), "UTF-8")).alias("digest"), F.contains(tx.scrubbed(F.col("content")), F.lit("[redacted:")).alias("hit"))


@query
def redaction_counts(spark, d):
    m = px.mem_secret(spark, d)
    return m.agg(*[F.sum(n).alias(kind.replace("-", "_")) for kind, n in tx.redactions(F.col("content"))])


@query
def strip_ansi(spark, d):
    return px.mem_secret(spark, d).select("id", F.md5(F.encode(tx.without_ansi(F.col("content")), "UTF-8")).alias("digest"))


@query
def strip_reminders(spark, d):
    return px.mem_secret(spark, d).select("id", F.md5(F.encode(tx.without_reminders(F.col("content")), "UTF-8")).alias("digest"))


@query
def normalize_turns(spark, d):
    t = tx.normalized(F.col("content"))
    return px.mem_secret(spark, d).select("id", F.md5(F.encode(t, "UTF-8")).alias("digest"), F.char_length(t).alias("n"))


@query
def normalize_text_key(spark, d):
    return px.mem_docs(spark, d).select("id", F.md5(F.encode(tx.dedup_key(_blanks(F.col("content"))), "UTF-8")).alias("digest"))


@query
def mangle_path(spark, d):
    return px.table(spark, d, "pages").select("page_id", tx.mangled_path(F.col("url")).alias("path"), tx.is_path_safe(F.col("url")).alias("safe"))


@query
def percent_decode(spark, d):
    return px.table(spark, d, "pages").select("page_id", tx.percent_decoded(F.concat(F.col("url"), F.lit("%20+%41"))).alias("decoded"))


@query
def uuid5_turn_id(spark, d):
    t = px.table(spark, d, "conversations")
    return t.select("conv_id", "turn", ids.turn_id(F.lit("claude-code"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))


@query
def uuid5_import_id(spark, d):
    m = px.mem_conv(spark, d)
    return m.select("id", ids.import_id(F.col("scope"), F.col("agent"), F.col("role"), F.col("created_at"), F.col("content")).alias("import_id"))


@query
def uuid5_fact_id(spark, d):
    return px.mem_docs(spark, d).select("id", ids.fact_id(F.col("id"), F.col("content")).alias("fact_id"))


@query
def ts_normalize(spark, d):
    e = px.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    given = F.concat(F.date_format(F.timestamp_seconds(F.unix_timestamp("ts") + 7200), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return e.select("event_id", times.normalized(given).alias("utc"), times.from_millis(F.unix_timestamp("ts") * 1000 + 5).alias("millis"))


@query
def ordered_in_second(spark, d):
    e = px.table(spark, d, "events").select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) % 600).alias("second"))
    n = F.least(F.row_number().over(sx.W.partitionBy("second").orderBy("event_id")) - 1, F.lit(999))
    return e.select("event_id", times.from_millis(F.col("second") * 1000 + n).alias("at"))


@query
def anchor_series(spark, d):
    t = px.table(spark, d, "conversations")
    n = F.row_number().over(sx.W.partitionBy("conv_id").orderBy("turn")) - 1
    return t.select("conv_id", "turn", times.as_text(F.timestamp_seconds(F.unix_timestamp(F.lit(px.START)) + F.col("conv_id") * 60 + n)).alias("at"))


#: Queries that are measured, and their kinds.
MEASURED = (("the of and", "common"), ("lichen thing", "rare"), ("ertion ciónmente", "rare"), ("of-the", "phrase"))


def _qrels(spark, d):
    """What is relevant to each measured query: current turns that hold its first word."""
    m = px.mem_conv(spark, d).where("valid_to IS NULL AND rule_id IS NULL")
    first = [(q, kind, tx.phrases_of(q)[0][0]) for q, kind in MEASURED]
    asked = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(kind).alias("kind"), F.lit(w).alias("word")) for q, kind, w in first])
    held = m.select("id", tx.terms(F.col("content")).alias("t"), F.explode(asked).alias("q"))
    return held.where(F.array_contains("t", F.col("q.word"))).select("q.query", "q.kind", "id")


def _ranking(spark, d):
    """The engine's own ranks of the measured queries."""
    m = px.mem_conv(spark, d)
    index = index_of(spark, m)
    each = [sx.search(m, q, limit=10, index=index).select(F.lit(q).alias("query"), "id", "rank") for q, _ in MEASURED]
    return reduce(DataFrame.unionAll, each)


@query
def eval_metrics(spark, d):
    done = gx.quality(_ranking(spark, d), _qrels(spark, d))
    return done.select("kind", "queries", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")])


@query
def eval_kind_shares(spark, d):
    return gx.kind_shares(_qrels(spark, d)).withColumn("share", F.round("share", 6))


def _message(spark, d):
    """Conversation turns with what session logs need: session, line, text, instant."""
    t = px.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    at = times.as_text(F.timestamp_seconds(F.unix_timestamp(F.lit(px.START)) + F.col("conv_id") * 3600 + F.col("turn")))
    return t.select(F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").cast("int").alias("line"), "role", "text", at.alias("at"), "conv_id", "turn")


def _json(**columns):
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def _block_lines(spark, d):
    m = _message(spark, d)
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("search").alias("name")),
    )
    head = {"type": F.col("role"), "uuid": F.concat_ws("-", "session", "line"), "timestamp": F.col("at"), "isMeta": F.col("line") == 3, "isSidechain": F.col("line") == 4}
    plain, rich = _json(**head, message=F.struct(F.col("text").alias("content"))), _json(**head, message=F.struct(blocks.alias("content")))
    line = F.when(F.col("line") % 2 == 0, plain).otherwise(rich)
    return m.select("session", "line", F.when(F.col("line") == 5, F.substring(line, 1, 20)).otherwise(line).alias("value"))


TURN_KEYS = ("session", "source_id", "role", "text", "created_at")


@query
def src_claude_turns(spark, d):
    return tr.turns_only(tr.block_log(_block_lines(spark, d))).select(*TURN_KEYS)


@query
def filter_stats(spark, d):
    return tr.filter_stats(tr.block_log(_block_lines(spark, d)))


@query
def synthetic_turns(spark, d):
    """Turns that a harness has written itself, among those of people: counted as such, and not as empty."""
    lines = _block_lines(spark, d).where("line <> 5")
    said = F.replace("value", F.lit('"content":"'), F.when(F.col("line") == 2, F.lit('"content":"  <command-name>/model</command-name> ')).otherwise(F.lit('"content":"')))
    turns = tr.block_log(lines.withColumn("value", said))
    return tr.counters(turns, lines).where("reason IN ('command_synthetic', 'empty', 'non_message')")


@query
def json_blocks(spark, d):
    rows = _block_lines(spark, d).withColumn("c", F.get_json_object("value", "$.message.content"))
    return rows.where("line <> 5").select("session", "line", F.md5(F.encode(tr.block_text(F.col("c"), tools=True), "UTF-8")).alias("digest"))


@query
def src_codex_turns(spark, d):
    m = _message(spark, d).where("role <> 'system'")
    event = _json(timestamp=F.col("at"), type=F.lit("event_msg"), payload=F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")))
    response = _json(timestamp=F.col("at"), type=F.lit("response_item"), payload=F.struct(F.lit("message").alias("type"), "role", F.array(F.struct("text")).alias("content")))
    both = F.when(F.col("conv_id") % 2 == 0, F.array(event, response)).otherwise(F.array(response))
    lines = m.select("session", F.posexplode(both).alias("p", "value"), "line").select("session", (F.col("line") * 2 + F.col("p")).alias("line"), "value")
    return tr.turns_only(tr.two_channel_log(lines)).select(*TURN_KEYS)


def _step_lines(spark, d):
    m = _message(spark, d)
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("INFO")
    body = F.when(F.col("role") == "user", F.concat(F.lit("<USER_REQUEST>"), "text", F.lit("</USER_REQUEST>"))).otherwise(F.col("text"))
    calls = F.array(F.struct(F.lit("b").alias("name"), F.struct(F.lit(1).alias("z"), F.lit(2).alias("a")).alias("args")))

    def step(status: str, **more: F.Column) -> F.Column:
        return _json(type=kind, source=F.lit("s"), step_index=F.col("line"), status=F.lit(status), created_at=F.col("at"), content=body, **more)

    # The last step differs from the others in its tool calls alone, so it is no replay.
    lines = m.select("session", "line", F.posexplode(F.array(step("RUNNING"), step("DONE"), step("DONE"), step("DONE", tool_calls=calls))).alias("p", "value"))
    return lines.select("session", (F.col("line") * 4 + F.col("p")).alias("line"), "value")


@query
def src_antigravity_turns(spark, d):
    nested = _message(spark, d).where("conv_id % 10 = 9").select("session").distinct()
    return tr.turns_only(tr.step_log(_step_lines(spark, d), nested=nested)).select(*TURN_KEYS)


def _chunk_lines(spark, d):
    m = _message(spark, d).where("role <> 'system'")
    kind = F.when(F.col("role") == "user", "user_message_chunk").otherwise("agent_message_chunk")
    chunk = lambda text: _json(method=F.lit("session/update"), timestamp=F.unix_timestamp(F.col("at").cast("timestamp")), params=F.struct(F.struct(kind.alias("sessionUpdate"), F.struct(F.lit("text").alias("type"), text.alias("text")).alias("content")).alias("update")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    lines = m.select("session", "line", F.posexplode(F.array(chunk(F.substring(F.col("text"), F.lit(1), half)), chunk(F.substring(F.col("text"), half + 1, F.char_length("text"))))).alias("p", "value"))
    return lines.select("session", (F.col("line") * 2 + F.col("p")).alias("line"), "value")


@query
def src_grok_runs(spark, d):
    return tr.turns_only(tr.chunk_log(_chunk_lines(spark, d))).select(*TURN_KEYS)


@query
def src_kimi_turns(spark, d):
    m = _message(spark, d).where("role <> 'system'")
    ms = F.unix_timestamp(F.col("at").cast("timestamp")) * 1000
    ident = F.concat_ws("-", "session", "line")
    prompt = lambda kind, text: _json(type=F.lit(kind), time=ms, promptId=ident, input=F.array(F.struct(text.alias("text"))))
    said = _json(type=F.lit("loop"), time=ms, event=F.struct(F.lit("content.part").alias("type"), ident.alias("uuid"), F.struct(F.lit("text").alias("type"), "text").alias("part")))
    lines = m.select("session", "line", F.explode(F.when(F.col("role") == "assistant", F.array(said)).when(F.col("line") % 2 == 0, F.array(prompt("turn.prompt", F.lit("typed")), prompt("prompt.accepted", F.col("text")))).otherwise(F.array(prompt("turn.prompt", F.col("text"))))).alias("value"))
    # Some sessions' protocol is too old to bear times, and some name none.
    head = m.where("conv_id % 9 <> 7").select("session", F.lit(-1).alias("line"), _json(type=F.lit("metadata"), protocol_version=F.when(F.col("conv_id") % 9 == 8, "1.2").otherwise("1.10")).alias("value")).distinct()
    lines = head.unionAll(lines)
    return tr.turns_only(tr.prompt_log(lines)).select(*TURN_KEYS)


@query
def src_deepcode_turns(spark, d):
    m = _message(spark, d)
    line = _json(id=F.concat_ws("-", "session", "line"), role=F.col("role"), content=F.col("text"), visible=F.col("line") != 3, createTime=F.col("at"))
    return tr.turns_only(tr.flag_log(m.select("session", "line", line.alias("value")))).select(*TURN_KEYS)


@query
def src_opencode_turns(spark, d):
    m = _message(spark, d).where("role <> 'system'").withColumn("id", F.concat_ws("-", "session", "line"))
    messages = m.select("id", "session", "role", (F.unix_timestamp(F.col("at").cast("timestamp")) * 1000).alias("millis"))
    parts = m.select(F.col("id").alias("message_id"), F.posexplode(F.split("text", "\n")).alias("n", "text")).select("message_id", F.format_string("%06d", "n").alias("id"), "text")
    return tr.turns_only(tr.message_parts(messages, parts)).select(*TURN_KEYS)


@query
def src_copilot_unpivot(spark, d):
    m = _message(spark, d)
    pairs = m.groupBy("session", F.floor(F.col("turn") / 2).cast("int").alias("turn_index")).agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_message"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("assistant_response"), F.min("at").alias("at"))
    return tr.turns_only(tr.paired_turns(pairs)).select(*TURN_KEYS)


@query
def import_texinfo(spark, d):
    ready(spark)
    # What a signed archive, or a second one in the same file, puts behind a message.
    rest = F.lit("@c Signed by: x\n@chapter Chat history for scope: y\n@bye\ntail\n")
    rows = lx.chapters(px.mem_conv(spark, d)).withColumn("text", F.concat("text", rest))
    return ex.texinfo_chapters(rows.withColumnRenamed("scope", "name")).select("name", "nth", "agent", "role", "created_at", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def _exports(spark, d):
    """Conversations as Markdown (even ids) and as scrollback."""
    m = _message(spark, d).where("role <> 'system'").withColumn("flat", F.regexp_replace("text", r"\s+", " "))
    more = F.when(F.col("line") % 3 == 1, " (Build · m · 3.2s)").otherwise("")
    written = F.concat(F.lit("## "), F.initcap("role"), more, F.lit("\n\n## Root cause\n"), "flat", F.lit("\n\n--- \n"))
    shown = F.concat(F.when(F.col("role") == "user", "❯ ").otherwise("● "), "flat", F.lit("\n  goes on\n"), F.when(F.col("line") % 2 == 0, "⎿ tool output\n  and more of it\n✻ Thinking\n").otherwise(""))
    part = F.when(F.col("conv_id") % 2 == 0, written).otherwise(shown)
    g = m.groupBy(F.col("session").alias("name"), (F.col("conv_id") % 2).alias("odd"), (F.col("conv_id") % 4 == 2).alias("dated")).agg(F.array_sort(F.collect_list(F.struct("line", part.alias("p")))).alias("ps"))
    head = F.when(F.col("dated"), F.lit("# Chat\n\n**Created:** 7/7/2026, 12:39:41 AM\n\n")).otherwise(F.lit(""))
    return g.select("name", "odd", F.concat(head, F.array_join(F.transform("ps", lambda x: x["p"]), "")).alias("text"))


@query
def import_sniff(spark, d):
    return _exports(spark, d).select("name", ex.sniffed(F.col("text")).alias("format"))


@query
def import_markdown(spark, d):
    return ex.markdown(_exports(spark, d).where("odd = 0"), px.START).select(*ex.MESSAGE)


@query
def import_scrollback(spark, d):
    return ex.scrollback(_exports(spark, d).where("odd = 1"), px.START).select(*ex.MESSAGE)


@query
def import_files(spark, d):
    """The exports written as files below a project's chat folder, walked, recognised and read back."""
    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/proj/chat"
    _exports(spark, d).select("name", "text").write.partitionBy("name").text(base)
    found = ex.imported(ex.read_exports(spark, base, recursive=True))
    return found.select(F.regexp_extract("name", "name=([^/]*)", 1).alias("name"), "nth", "scope", "agent", "role", "text")


@query
def src_goose_turns(spark, d):
    m = _message(spark, d).withColumn("row", F.col("line"))
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text")))
    ident = F.when(F.col("line") % 2 == 0, F.concat_ws("-", "session", "line"))
    return tr.turns_only(tr.json_messages(m.select("session", "row", ident.alias("message_id"), "role", blocks.alias("content_json"), F.unix_timestamp(F.col("at").cast("timestamp")).alias("seconds")))).select(*TURN_KEYS)


@query
def workspace_of(spark, d):
    uri = F.concat(F.lit("file:///w/"), F.regexp_replace("url", "[^a-z0-9/]", "%20"), F.when(F.col("page_id") % 2 == 0, "/x.code-workspace").otherwise(""))
    return px.table(spark, d, "pages").select("page_id", tx.workspace(uri).alias("folder"))


@query
def stream_ingest(spark, d):
    """Conversations written as a log, taken in by the streaming job, twice."""
    ready(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    m = _message(spark, d).where("role <> 'system'")
    m.select("session", F.col("line").cast("string").alias("source_id"), "role", "text", F.col("at").alias("created_at")).write.json(f"{base}/log")
    for _ in range(2):
        si.ingest(spark, f"{base}/log", f"{base}/store", f"{base}/state", "session string, source_id string, role string, text string, created_at string", lambda df: df, "log", "chat")
    return spark.read.schema(si.STORED).parquet(f"{base}/store").select("id", "scope", "role", "text", "created_at")


@query
def stream_steps(spark, d):
    """Logs of steps, cut into pieces at every third line, as a stream whose reader keeps state: running steps and replays lie in other pieces than the steps that they are of."""
    return _followed(spark, _step_lines(spark, d), "antigravity")


@query
def stream_chunks(spark, d):
    """Logs of chunks, cut into pieces within messages; the message that is open at a session's end waits."""
    return _followed(spark, _chunk_lines(spark, d), "grok")


def _followed(spark, lines, harness):
    base = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    store = ox.Store(spark, f"{base}/store")
    cut = F.floor(F.percent_rank().over(sx.W.partitionBy("session").orderBy("line")) * 2.999)
    lines = lines.withColumn("piece", cut).checkpoint()
    for piece in range(3):  # lines come in order, in three pieces
        lines.where(F.col("piece") == piece).drop("piece").write.mode("append").json(f"{base}/log/{piece}")
        ss.follow(spark, f"{base}/log/*", store, f"{base}/state", harness, "chat")
    return store.memories().select("id", "agent", "role", "content", "created_at")
