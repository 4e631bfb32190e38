"""Upkeep: duplicates, contradictions, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import times
from palimpsest.operators import overlap

DECAY_TOP = 20


def plain(memories: DataFrame) -> DataFrame:
    """Current memories that aren't rules."""
    return memories.where("valid_to IS NULL AND rule_id IS NULL")


def exact_edges(memories: DataFrame) -> DataFrame:
    """scope, a, b: each memory of a group of equal normalised texts tied to the group's smallest id.

    The keys are checkpointed, so texts are normalised once.
    """
    rows = plain(memories).select("id", "scope", F.sha2(tx.dedup_key(F.col("content")), 256).alias("key")).checkpoint()
    least = rows.groupBy("scope", "key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, ["scope", "key"]).where("id <> a").select("scope", "a", F.col("id").alias("b"))


def exact_groups(memories: DataFrame) -> DataFrame:
    """scope, first_id, n of each group of equal normalised texts."""
    rows = plain(memories).select("id", "scope", F.sha2(tx.dedup_key(F.col("content")), 256).alias("key"))
    return rows.groupBy("scope", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("scope", "first_id", "n")


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that edges (a, b) reach. Each round's labels are checkpointed.

    A round gives every id the smallest label among its neighbours' and its own, then the label of that
    label, so paths halve.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("id"), "label").checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("id").alias("k"), F.col("label").alias("far"))
        new = step.join(jump, step["label"] == jump["k"], "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "old").checkpoint()
        if new.where("label <> old").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")


def _members(memories: DataFrame, vector_edges: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with what found them, the components they make, and the memories in one (component, scope, id, created_at).

    The edges are checkpointed, so vectors are compared once.
    """
    edges = exact_edges(memories).withColumn("by", F.lit("exact"))
    if vector_edges is not None:
        edges = edges.unionByName(vector_edges.select("scope", "a", "b", F.lit("vector").alias("by")))
    edges = edges.checkpoint()
    parts = components(edges)
    return edges, parts, plain(memories).select("id", "scope", "created_at").join(parts, "id")


def dedup_losers(memories: DataFrame, vector_edges: DataFrame | None = None) -> DataFrame:
    """scope, winner, loser: one row for each loser of each group of duplicates, however large the group."""
    _, _, rows = _members(memories, vector_edges)
    best = rows.groupBy("component", "scope").agg(F.max_by("id", F.struct("created_at", "id")).alias("winner"))
    return rows.join(best, ["component", "scope"]).where("id <> winner").select("scope", "winner", F.col("id").alias("loser"))


def dedup_groups(memories: DataFrame, vector_edges: DataFrame | None = None) -> DataFrame:
    """scope, winner, losers (ascending time, comma-joined), detectors of each group of duplicates.

    The newest memory wins, equal times by greater id. A group is one row here; ``dedup_losers`` has no such row.
    """
    edges, parts, rows = _members(memories, vector_edges)
    detectors = edges.join(parts, F.col("a") == F.col("id")).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("by")), ",").alias("detectors"))
    best = rows.groupBy("component", "scope").agg(F.max_by("id", F.struct("created_at", "id")).alias("winner"), F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("all"))
    losers = F.array_join(F.transform(F.filter("all", lambda m: m["id"] != F.col("winner")), lambda m: m["id"]), ",")
    return best.join(detectors, "component").select("scope", "winner", losers.alias("losers"), "detectors")


def dedup_applied(memories: DataFrame, groups: DataFrame, now: str) -> DataFrame:
    """Memories with each group's losers closed at ``now`` in favour of its winner; closed ones stay as they are."""
    return losers_closed(memories, groups.select("winner", F.explode(F.split("losers", ",")).alias("loser")), now)


def losers_closed(memories: DataFrame, losers: DataFrame, now: str) -> DataFrame:
    """The same from rows (winner, loser)."""
    gone = losers.select("winner", "loser")
    close = F.col("loser").isNotNull() & F.col("valid_to").isNull()
    rows = memories.join(gone, F.col("id") == F.col("loser"), "left")
    rows = rows.withColumn("superseded_by", F.when(close, F.col("winner")).otherwise(F.col("superseded_by")))
    return rows.withColumn("valid_to", F.when(close, F.lit(now)).otherwise(F.col("valid_to"))).drop("winner", "loser")


def word_classes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (scope, key, neg, class, created_at, n, bytes, text) of current memories with the same scope, words and negation, and their members (scope, class, id).

    A class is named by its oldest member; its text is its n different words in order, joined by blanks.
    """
    made = F.struct(F.sort_array(tx.words(F.col("content"))).alias("w"), tx.is_negated(F.col("content")).alias("neg"))
    # Behind a generator a text is cut once, however many columns read its words.
    rows = plain(memories).select("id", "scope", "created_at", F.inline(F.array(made))).where(F.size("w") > 0)
    rows = rows.select("id", "scope", "created_at", "neg", F.size("w").alias("n"), F.array_join("w", " ").alias("text"))  # words hold no blank
    rows = rows.select("*", F.md5(F.encode("text", "UTF-8")).alias("key"), F.octet_length("text").alias("bytes"))
    same = ["n", "bytes", "text"]
    classes = rows.groupBy("scope", "key", "neg").agg(F.min(F.struct("created_at", "id")).alias("first"), *[F.any_value(c).alias(c) for c in same])
    classes = classes.select("scope", "key", "neg", F.col("first.id").alias("class"), F.col("first.created_at").alias("created_at"), *same)
    members = rows.select("id", "scope", "key", "neg").join(classes.select("scope", "key", "neg", "class"), ["scope", "key", "neg"])
    return classes, members.select("scope", "class", "id")


#: Bytes of words in a block, about, at most and at least; up to SPREAD blocks are made of fewer bytes than the most, so that tasks are many.
BLOCK_BYTES, LEAST_BYTES, SPREAD = 32 << 20, 2 << 20, 4
#: Bytes of words that a task of cells gets, at least about, and parts of a whole that a class's place among those of its size may have.
CELL_BYTES, PARTS = 1 << 20, 1 << 20


def blocks_of(classes: DataFrame) -> DataFrame:
    """scope, neg, n, first, last, and before, own, total, blocks: in which blocks of its scope and sign the classes of n words lie.

    Classes are in order of n, and blocks cut that order into even parts by bytes.
    """
    sizes = classes.groupBy("scope", "neg", "n").agg(F.sum("bytes").alias("own"))
    side = W.partitionBy("scope", "neg")
    sizes = sizes.withColumn("before", F.sum("own").over(side.orderBy("n")) - F.col("own")).withColumn("total", F.sum("own").over(side))
    parts = F.greatest(F.least(F.ceil(F.col("total") / LEAST_BYTES), F.lit(SPREAD)), F.ceil(F.col("total") / BLOCK_BYTES))
    sizes = sizes.withColumn("blocks", parts)
    return sizes.select("*", block_at(F.lit(0)).alias("first"), block_at(F.lit(PARTS - 1)).alias("last"))


def block_at(part: Column) -> Column:
    """The block of a class that has this place, of PARTS, among those of its size."""
    return F.floor((F.col("before") + F.col("own") * part / PARTS) * F.col("blocks") / F.col("total")).cast("int")


def cells_of(sizes: DataFrame, percent: int) -> DataFrame:
    """scope, i, j, bytes: the blocks i of negated and j of other classes of a scope that hold sets of fitting sizes; for_i and for_j (least, most): the sizes that fit the other block's."""
    each = sizes.select("scope", "neg", "n", (F.col("own") / (F.col("last") - F.col("first") + 1)).alias("own"), F.explode(F.sequence("first", "last")).alias("block"))
    blocks = each.groupBy("scope", "neg", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("own").alias("bytes"))
    blocks = blocks.withColumn("fits", F.struct(F.ceil(F.col("low") * percent / 100).alias("least"), F.floor(F.col("high") * 100 / percent).alias("most")))
    l, r = blocks.where("neg").alias("l"), blocks.where("NOT neg").alias("r")
    fit = (F.col("l.high") >= F.col("r.fits.least")) & (F.col("l.low") <= F.col("r.fits.most"))
    cells = l.join(r, (F.col("l.scope") == F.col("r.scope")) & fit)
    return cells.select("l.scope", F.col("l.block").alias("i"), F.col("r.block").alias("j"), (F.col("l.bytes") + F.col("r.bytes")).alias("bytes"), F.col("r.fits").alias("for_i"), F.col("l.fits").alias("for_j"))


def likely_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """scope, p, p_at, q, q_at, jaccard: classes, p negated and q not, whose sets are that alike.

    A cell is two blocks, and each pair of classes of fitting sizes meets in one cell. Words are moved once to make the classes and once
    for each cell of a class's block whose other block's sizes fit, never for a pair.
    """
    # Without their words, which are cut anew for the cells: so neither words nor texts are kept.
    small = classes.select("scope", "key", "neg", "n", "bytes").checkpoint()
    sizes = blocks_of(small).checkpoint()
    cells = cells_of(sizes, percent).checkpoint()
    count, size = cells.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0.0))).first()
    tasks = 1 + int(min(2 * count, size // CELL_BYTES))
    meet = lambda neg, block: cells.select("scope", F.lit(neg).alias("neg"), F.col(block).alias("block"), F.struct("i", "j", f"for_{block}.*").alias("cell"))
    meet = meet(True, "i").unionAll(meet(False, "j")).groupBy("scope", "neg", "block").agg(F.collect_list("cell").alias("cells"))
    placed = small.join(sizes, ["scope", "neg", "n"]).select("scope", "key", "neg", "n", block_at(F.pmod(F.xxhash64("key"), F.lit(PARTS))).alias("block"))
    fitting = F.filter("cells", lambda c: F.col("n").between(c["least"], c["most"]))
    placed = placed.join(meet, ["scope", "neg", "block"]).select("scope", "key", "neg", F.transform(fitting, lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"))).alias("cells"))
    rows = classes.join(placed, ["scope", "key", "neg"]).select("scope", "neg", "n", "class", "created_at", "text", F.inline("cells"))
    found = rows.repartition(tasks, "scope", "i", "j").groupBy("scope", "i", "j")
    return found.applyInArrow(overlap.pairs_of(percent), "scope string, p string, p_at string, q string, q_at string, jaccard double")


def contradictions(memories: DataFrame, percent: int = 50) -> DataFrame:
    """scope, a, b, jaccard, negated: pairs of classes of a scope, one of them negated, whose word sets are that alike.

    A class stands for all memories of one word set (``word_classes`` has the members), so copies make one pair
    and not all of theirs. a is the older.
    """
    pairs = likely_pairs(word_classes(memories)[0], percent)
    first = F.struct("p_at", "p") < F.struct("q_at", "q")
    return pairs.select("scope", F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b"), "jaccard", F.col("p").alias("negated"))


def decay(memories: DataFrame, counts: DataFrame, now: str, top: int = DECAY_TOP) -> DataFrame:
    """id, scope, age_days, access_count, last_accessed_at, staleness of the stalest memories."""
    rows = plain(memories).select("id", "scope", "created_at").join(counts, "id", "left")
    rows = rows.withColumn("access_count", F.greatest(F.coalesce("access_count", F.lit(0)), F.lit(0))).withColumn("age_days", times.age_days(F.col("created_at"), now))
    rows = rows.withColumn("staleness", F.col("age_days") + 30.0 / (1.0 + F.col("access_count")))
    return rows.orderBy(F.desc("staleness"), "id").limit(top).select("id", "scope", "age_days", "access_count", "last_accessed_at", "staleness")


def access_counts(log: DataFrame) -> DataFrame:
    """id, access_count, last_accessed_at from a log of (id, ts)."""
    return log.groupBy("id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed_at"))
