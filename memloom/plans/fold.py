"""Projections as pure functions of the event log.

A fold never gathers one record's events into a list: the last event that sets
a row anew is a maximum, counters are sums, and each field's last change is a
maximum by sequence number, so partial sums do most of the work before a
shuffle and a record with millions of reads is no heavier than another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MUTABLE, RECORD

UTILITY_STEP, UTILITY_MAX = 0.1, 1.0


def once(events: DataFrame) -> DataFrame:
    """Each sequence number once, so a batch that is delivered again changes nothing."""
    return events.dropDuplicates(["seq"])


def _utility(start: Column, times: Column) -> Column:
    """Repeated steps up to the maximum, added as they came; a dozen steps reach it from 0."""
    steps = F.sequence(F.lit(1), F.least(times, F.lit(12)).cast("int"))
    return F.when(times > 0, F.aggregate(steps, start, lambda u, _: F.least(u + UTILITY_STEP, F.lit(UTILITY_MAX)))).otherwise(start)


def fold_records(events: DataFrame) -> DataFrame:
    """The current records of a log.

    A write replaces the row; a transition changes allowed fields of a row that
    is there; a hard forget removes it, a soft one closes it once; a retrieval
    counts and lifts utility.  All else is ignored.  Events of one ``seq``
    count once."""
    e = once(events)
    p = F.col("payload")
    whole = F.col("kind").isin("memory.write", "memory.decay_transition") & p["record"].isNotNull()
    hard = (F.col("kind") == "memory.forget") & F.coalesce(p["hard"], F.lit(False))
    resets = e.where(whole | hard).select(F.when(whole, p["record"]["record_id"]).otherwise(p["record_id"]).alias("id"), "seq", F.when(whole, p["record"]).alias("row"))
    last = resets.groupBy("id").agg(F.max("seq").alias("since"), F.max_by("row", "seq").alias("row")).where("row is not null")

    soft = (F.col("kind") == "memory.forget") & ~hard
    change = (F.col("kind") == "memory.decay_transition") & p["record"].isNull()
    read = F.col("kind") == "memory.retrieve"
    ids = F.when(read, p["record_ids"]).otherwise(F.array(p["record_id"]))
    later = e.where(soft | change | read).select("seq", "ts", F.when(soft, "soft").when(change, "set").otherwise("read").alias("what"), F.when(change, p["set"]).alias("set"), F.explode(ids).alias("id"))
    later = later.join(last.select("id", "since", F.col("row.status").alias("first_status")), "id").where("seq > since")

    reads = later.where("what = 'read'").groupBy("id").agg(F.count(F.lit(1)).alias("reads"), F.max("ts").alias("read_at"))
    # a soft forget acts only on a row that is not deleted yet: look at the change of status before it
    sets = later.where("what <> 'read'").withColumn("to", F.when(F.col("what") == "soft", F.lit("deleted")).otherwise(F.col("set")["status"]))
    moves = Window.partitionBy("id").orderBy("seq")
    before = F.coalesce(F.last("to", ignorenulls=True).over(moves.rowsBetween(Window.unboundedPreceding, -1)), F.col("first_status"))
    sets = sets.withColumn("acts", (F.col("what") == "set") | (before != "deleted")).where("acts")
    closed = F.map_from_arrays(F.array(F.lit("status"), F.lit("valid_to"), F.lit("superseded_at")), F.array(F.lit("deleted"), F.col("ts").cast("string"), F.col("ts").cast("string")))
    sets = sets.withColumn("set", F.when(F.col("what") == "soft", closed).otherwise(F.col("set")))
    last_set = [F.max_by(F.struct(F.col("set")[f].alias("v")), F.when(F.map_contains_key("set", f), F.col("seq"))).alias(f"new_{f}") for f in MUTABLE]
    changed = sets.groupBy("id").agg(*last_set)

    out = last.join(reads, "id", "left").join(changed, "id", "left")
    n = F.coalesce("reads", F.lit(0))
    s = F.col("row.scoring")
    scoring = F.when(n == 0, s).otherwise(
        F.struct(s["recency"].alias("recency"), s["relevance"].alias("relevance"), s["importance"].alias("importance"), _utility(F.coalesce(s["utility"], F.lit(0.0)), n).alias("utility"), (F.coalesce(s["access_count"], F.lit(0)) + n).alias("access_count"), F.greatest(s["last_accessed_at"], F.col("read_at")).alias("last_accessed_at"))
    )
    cols = []
    for f in RECORD:
        old = scoring if f.name == "scoring" else F.col(f"row.{f.name}")
        if f.name in MUTABLE:
            new = F.col(f"new_{f.name}")
            value = F.unbase64(new["v"]) if MUTABLE[f.name] == "binary" else new["v"].cast(MUTABLE[f.name])
            old = F.when(new.isNotNull(), value).otherwise(old)
        cols.append(old.alias(f.name))
    return out.select(*cols)


def _last_writes(events: DataFrame) -> DataFrame:
    """id, row and seq of each record's last write that no forget of either kind follows."""
    e = once(events).where(F.col("kind").isin("memory.write", "memory.forget"))
    write = F.col("kind") == "memory.write"
    key = F.when(write, F.col("payload.record.record_id")).otherwise(F.col("payload.record_id"))
    last = e.select(key.alias("id"), "seq", F.when(write, F.col("payload.record")).alias("row"))
    return last.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("row", "seq").alias("row")).where("row is not null")


def fold_vectors(events: DataFrame, embed) -> DataFrame:
    """(record_id, namespace, vector): the last write's content, embedded; any forget removes it.
    ``embed`` maps a text column to a vector column."""
    rows = _last_writes(events)
    return rows.select(F.col("id").alias("record_id"), F.col("row.namespace").alias("namespace"), embed(F.col("row.content")).alias("vector"))


def fold_lexical(events: DataFrame) -> DataFrame:
    """(record_id, namespace, content) of the text index, control characters stripped."""
    from ..functions.text import strip_controls

    rows = _last_writes(events)
    return rows.select(F.col("id").alias("record_id"), F.col("row.namespace").alias("namespace"), strip_controls(F.coalesce("row.content", F.lit(""))).alias("content"))


def fold_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, namespace) and edges (src, dst, rel, weight, reason, seq).

    A write makes a node and a ``derived_from`` edge to each member that it
    was derived from; a link sets its edge, a later one replaces it; a forget
    removes the node and every edge at it that is older."""
    p = F.col("payload")
    # all sums below are maxima, which an event that is delivered again does not change; each kind on its
    # own with no more columns than it needs, so a log without a kind costs nothing for it
    of = lambda kind, *cols: events.where(F.col("kind") == kind).select("seq", *cols)
    gone = of("memory.forget", p["record_id"].alias("node_id")).groupBy("node_id").agg(F.max("seq").alias("gone"))
    record = p["record"]
    made = of("memory.write", record.isNotNull().alias("whole"), record["record_id"].alias("node_id"), record["memory_type"].alias("label"), record["namespace"].alias("namespace"), p["derivation"].alias("derivation"), p["member_record_ids"].alias("members"), p["session_key"].alias("reason")).where("whole")
    derived = made.where("derivation is not null").select(F.col("node_id").alias("src"), F.explode("members").alias("dst"), F.lit("derived_from").alias("rel"), F.lit(1.0).alias("weight"), "reason", "seq")
    linked = of("memory.link", p["src"].alias("src"), p["dst"].alias("dst"), F.coalesce(p["rel"], F.lit("related")).alias("rel"), F.coalesce(p["weight"], F.lit(1.0)).alias("weight"), p["reason"].alias("reason")).where("src is not null and dst is not null")
    edges = derived.unionByName(linked).groupBy("src", "dst", "rel").agg(F.max("seq").alias("seq"), F.max_by(F.struct("weight", "reason"), "seq").alias("last"))
    for end in ("src", "dst"):
        cut = gone.select(F.col("node_id").alias(end), "gone")
        edges = edges.join(cut, end, "left").where("gone is null or seq > gone").drop("gone")
    edges = edges.select("src", "dst", "rel", F.col("last.weight").alias("weight"), F.col("last.reason").alias("reason"), "seq")
    own = made.groupBy("node_id").agg(F.max("seq").alias("seq"), F.max_by(F.struct("label", "namespace"), "seq").alias("n"))
    own = own.join(gone, "node_id", "left").where("gone is null or seq > gone").select("node_id", F.col("n.label").alias("label"), F.col("n.namespace").alias("namespace"))
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    bare = ends.join(own, "node_id", "left_anti").select("node_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("namespace"))
    return own.unionByName(bare), edges


def rebuild(events: DataFrame, mode: str = "full", offset: int = 0) -> DataFrame:
    """The records of the whole log, refused where the log cannot give them all."""
    if mode == "ephemeral":
        raise ValueError("an ephemeral log keeps no events to rebuild from")
    first = events.agg(F.min("seq")).first()[0]
    if first is None and offset > 0:
        raise ValueError("the log is empty but its projections are ahead of it")
    if first is not None and first != 1:
        raise ValueError(f"the log begins at {first}: events were pruned")
    return fold_records(events)
