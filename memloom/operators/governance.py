"""Firewall, corroboration, grants, taint and proof of erasure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import grow
from ..plans.ordering import counted_before
from ..policies import Firewall

# Trust by role, outside channels, and the texts that read like instructions.
ROLE_TRUST = {"operator": 0.9, "system": 0.9, "user": 0.7, "assistant": 0.5, "tool": 0.4}
OTHER_TRUST = 0.5
EXTERNAL = ("retrieved", "web", "external", "email", "mcp", "ingest", "rest")
INSTRUCTIONS = (
    r"\bignore (all|any|the|previous|prior|above)\b.{0,40}\b(instruction|prompt|rule)",
    r"\bdisregard\b.{0,40}\b(instruction|prompt|rule|polic)",
    r"\byou (must|should|will) (always|never|now)\b",
    r"\bfrom now on\b",
    r"\bnew (system )?instructions?\b",
    r"\bdo not (tell|inform|reveal|mention)\b",
    r"\b(system|developer) prompt\b",
    r"\bwhen (the user|asked about .{1,60}),? (always|never|say|respond|reply)\b",
    r"</?(system|instructions?|admin)>",
    r"\brespond with\b.{0,60}\bexactly\b",
)


def trust_of(role: Column, channel: Column, policy: Firewall = Firewall()) -> Column:
    out = F.lit(OTHER_TRUST)
    for name, value in ROLE_TRUST.items():
        out = F.when(role == name, value).otherwise(out)
    return F.when(channel.isin(*EXTERNAL), F.least(out, F.lit(policy.external_cap))).otherwise(out)


def instruction_shaped(content: Column) -> Column:
    out = F.lit(False)
    for pattern in INSTRUCTIONS:
        out = out | content.rlike("(?is)" + pattern)
    return F.coalesce(out, F.lit(False))


def outliers(neighbours: DataFrame, policy: Firewall = Firewall()) -> DataFrame:
    """(query_id, outlier) from each write's nearest rows (query_id, score, quarantined): quarantined ones
    are left out first, and fewer than ``min_neighbours`` say nothing."""
    left = neighbours.where(~F.coalesce("quarantined", F.lit(False))).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    return left.select("query_id", ((F.col("n") >= policy.min_neighbours) & (F.col("top") < policy.outlier_below)).alias("outlier"))


def prefix_bridges(rows: DataFrame, policy: Firewall = Firewall()) -> DataFrame:
    """``rows`` (record_id, namespace, content, recorded_at, quarantined) with ``bridge``: a long text
    that begins like a different recent one of its namespace.

    Recent are the last ``recent`` before it that are not quarantined.  Rows
    are numbered along the log, range by range; rows of one prefix meet by its
    digest, and the distance in numbers decides.  Texts are not shuffled."""
    begin = F.substring("content", 1, policy.prefix_chars)
    slim = rows.select("record_id", "namespace", "recorded_at", (~F.coalesce("quarantined", F.lit(False))).cast("int").alias("__clean"), F.when(F.length("content") >= policy.prefix_chars, F.sha2(begin, 256)).alias("__p"), F.sha2("content", 256).alias("__h"))
    numbered = counted_before(slim, "__before", ["recorded_at", "record_id"], ["namespace"], F.col("__clean"))
    long = numbered.where("__p is not null")
    # the last different text of the same beginning: within one prefix, the latest row before whose text is another
    within = Window.partitionBy("namespace", "__p").orderBy("recorded_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("__clean") == 1, F.struct((F.col("__before") + 1).alias("n"), F.col("__h").alias("h")))
    last = F.last(seen, ignorenulls=True).over(within)
    long = long.withColumn("__last", last)
    # the latest of another text is either the last row or the last of the run of texts before it
    changed = F.when((F.col("__clean") == 1) & F.col("__last").isNotNull() & (F.col("__last.h") != F.col("__h")), F.col("__last.n"))
    run = F.last(changed, ignorenulls=True).over(within)
    latest = F.when(F.col("__last.h") != F.col("__h"), F.col("__last.n")).otherwise(run)
    hit = long.withColumn("__latest", latest).where(F.col("__latest").isNotNull() & (F.col("__latest") > F.col("__before") - policy.recent)).select("record_id", F.lit(True).alias("bridge"))
    return rows.join(hit, "record_id", "left").withColumn("bridge", F.coalesce("bridge", F.lit(False)))


def quarantine(trust: Column, role: Column, channel: Column, instruction: Column, anomalous: Column, policy: Firewall = Firewall()) -> Column:
    risky = channel.isin(*EXTERNAL) | role.isin("tool", "assistant")
    return F.coalesce((trust < policy.quarantine_below) | (anomalous & ~role.isin("operator", "system")) | (instruction & risky), F.lit(False))


def stamped(writes: DataFrame, policy: Firewall = Firewall()) -> DataFrame:
    """``writes`` (role, channel, content, anomalous) with trust, instruction_flag, quarantined and status."""
    role, channel = F.coalesce("role", F.lit("")), F.coalesce("channel", F.lit(""))
    out = writes.withColumns({"trust": trust_of(role, channel, policy), "instruction_flag": instruction_shaped(F.col("content"))})
    out = out.withColumn("quarantined", quarantine(F.col("trust"), role, channel, F.col("instruction_flag"), F.coalesce("anomalous", F.lit(False)), policy))
    return out.withColumn("status", F.when(F.col("quarantined"), "resolving").otherwise("activated"))


def corroborated(held: DataFrame, incoming: DataFrame, policy: Firewall = Firewall()) -> DataFrame:
    """(record_id, votes, lifted): quarantined records with the number of independent writes that
    agree.  Both: record_id, namespace, memory_type, entity, attribute, content_fingerprint, role,
    channel, trust; ``held`` has corroborations.

    Votes are counted by key, no pair of records is made: those of the same text, and those of the
    same key, less those that share both, of each less those of the record's own role and channel
    and its own write.  Only ids that stand for several unlike rows are held against each other
    by pairs, so that each votes once."""
    signature = F.concat_ws("|", "role", "channel")
    text, key = ["namespace", "content_fingerprint"], ["namespace", "memory_type", "entity", "attribute"]
    what = [*text, *key[1:], "sig"]
    h = held.withColumn("sig", signature).where("record_id is not null").select("record_id", *what)
    ok = incoming.where((F.col("trust") >= policy.corroborate_trust) & F.col("role").isin("operator", "system", "user") & F.col("record_id").isNotNull()).withColumn("sig", signature).select("record_id", *what)

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ids with one row, however often it stands there, and the rows of the others."""
        ends = rows.groupBy("record_id").agg(F.min(F.struct(*what)).alias("lo"), F.max(F.struct(*what)).alias("hi"))
        many = ends.where("lo <> hi").select("record_id")
        return ends.where("lo = hi").select("record_id", "lo.*"), rows.distinct().join(many, "record_id", "left_semi")

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        """(record_id, in_id) of rows that agree, by two equi-joins: an OR of both would compare all with all."""
        b = b.select(F.col("record_id").alias("in_id"), F.col("sig").alias("in_sig"), *[F.col(c).alias(f"in_{c}") for c in what[:-1]])
        same = lambda on: [a[c] == b[f"in_{c}"] for c in on] + [F.col("in_id") != F.col("record_id"), F.col("in_sig") != F.col("sig")]
        return a.join(b, same(text)).select("record_id", "in_id").unionByName(a.join(b, same(key)).select("record_id", "in_id")).distinct()

    (one, several), (in_one, in_several) = parted(h), parted(ok)
    counts = []
    for on, sign in ((text, 1), (key, 1), (what[:-1], -1)):
        n = in_one.groupBy(*on, "sig").agg(F.count(F.lit(1)).alias("own"))
        out = one.join(n.groupBy(*on).agg(F.sum("own").alias("all")), on).join(n, [*on, "sig"], "left")
        counts.append(out.select("record_id", (sign * (F.col("all") - F.coalesce("own", F.lit(0)))).alias("votes")))
    # a record's own write does not vote for it
    b = in_one.select("record_id", *[F.col(c).alias(f"in_{c}") for c in what])
    agree = lambda on: reduce(Column.__and__, [F.coalesce(F.col(c) == F.col(f"in_{c}"), F.lit(False)) for c in on])
    counts.append(one.join(b, "record_id").where((F.col("sig") != F.col("in_sig")) & (agree(text) | agree(key))).select("record_id", F.lit(-1).cast("long").alias("votes")))
    for some in (pairs(one, in_several), pairs(several, in_one.unionByName(in_several))):
        counts.append(some.groupBy("record_id").agg(F.count(F.lit(1)).alias("votes")))
    votes = reduce(DataFrame.unionByName, counts).groupBy("record_id").agg(F.sum("votes").alias("votes")).where("votes > 0")
    out = held.join(votes, "record_id").withColumn("votes", F.col("votes") + F.coalesce("corroborations", F.lit(0)))
    return out.select("record_id", "votes", (F.col("votes") >= policy.corroborations).alias("lifted"))


# --- grants ---------------------------------------------------------------


def grant_scopes(grants: DataFrame) -> DataFrame:
    """(grantor, grantee, every, types) of live grants (grantor, grantee, scope array or null, status, quarantined):
    the union of scopes; null means every type and wins."""
    live = grants.where((F.col("status") == "activated") & ~F.coalesce("quarantined", F.lit(False)) & (F.col("grantor") != F.col("grantee")))
    return live.groupBy("grantor", "grantee").agg(F.bool_or(F.col("scope").isNull()).alias("every"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("scope")))).alias("types"))


def readable(readers: DataFrame, grants: DataFrame, records: DataFrame) -> DataFrame:
    """(reader, record_id): what each reader (reader) sees of its own and by grants; records of type shared only its own."""
    own = readers.join(records, F.col("reader") == F.col("namespace")).select("reader", "record_id")
    scope = grant_scopes(grants).withColumnRenamed("grantee", "reader").join(readers, "reader")
    foreign = scope.join(records, F.col("grantor") == F.col("namespace")).where((F.col("memory_type") != "shared") & (F.col("every") | F.array_contains("types", F.col("memory_type")))).select("reader", "record_id")
    return own.unionByName(foreign).distinct()


# --- taint and erasure ----------------------------------------------------


def derivations(events: DataFrame) -> DataFrame:
    """(origin, derived, label, seq): how content got from one record into another."""
    p = F.col("payload")
    named = p["record"]["record_id"]
    made = events.where((F.col("kind") == "memory.write") & p["derivation"].isNotNull()).select(F.explode(p["member_record_ids"]).alias("origin"), named.alias("derived"), F.when(p["derivation"] == "reflection", "reflected").otherwise("consolidated").alias("what"), "seq")
    merge = events.where("kind = 'memory.merge'")
    merged = merge.select(p["dropped_record_id"].alias("origin"), p["kept_record_id"].alias("derived"), F.lit("merged").alias("what"), "seq")
    absorbed = merge.select(p["kept_record_id"].alias("origin"), p["dropped_record_id"].alias("derived"), F.lit("absorbed_by").alias("what"), "seq")
    summed = events.where("kind = 'memory.consolidate'").select(F.explode(p["member_record_ids"]).alias("origin"), p["summary_record_id"].alias("derived"), F.lit("consolidated").alias("what"), "seq")
    link = events.where((F.col("kind") == "memory.link") & (F.coalesce(p["weight"], F.lit(1.0)) > 0))
    linked = [link.select(p[a].alias("origin"), p[b].alias("derived"), F.lit("linked").alias("what"), "seq") for a, b in (("src", "dst"), ("dst", "src"))]
    conflict = events.where((F.col("kind") == "memory.conflict") & p["verdict"].isin("update", "invalidate")).select(p["incoming_record_id"].alias("origin"), p["existing_record_id"].alias("derived"), F.lit("conflicted").alias("what"), "seq")
    out = made
    for part in (merged, absorbed, summed, *linked, conflict):
        out = out.unionByName(part)
    return out.where("origin is not null and derived is not null and origin <> derived").select("origin", "derived", F.concat("what", F.lit("@"), F.col("seq").cast("string")).alias("label"), "seq")


def tainted(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, record_id, label, hops): all that each seed (record_id) reached, nearest first; of equal
    hops the label of the smallest seq.  One join a hop, over the newest alone."""
    start = seeds.select(F.col("record_id").alias("seed"), F.col("record_id"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("hops"))

    def step(front: DataFrame) -> DataFrame:
        more = front.join(edges, front["record_id"] == edges["origin"]).groupBy("seed", F.col("derived").alias("record_id")).agg(F.min(F.struct("seq", edges["label"].alias("l"))).alias("m"), (F.min("hops") + 1).alias("hops"))
        return more.select("seed", "record_id", F.col("m.l").alias("label"), "hops")

    return grow(start, step, ["seed", "record_id"]).where("hops > 0")


def erasure_reports(ids: DataFrame, events: DataFrame, records: DataFrame, vectors: DataFrame, lexical: DataFrame) -> DataFrame:
    """For each of ``ids`` (record_id): whether it is gone from each projection and its content from
    the log, and ``clean``.  One join a projection for all ids."""
    from ..sources.log import content_carriers

    out = ids.select("record_id").distinct()
    parts = {"row_absent": records, "log_clean": content_carriers(events), "vector_absent": vectors, "lexical_absent": lexical}
    for name, df in parts.items():
        there = df.select("record_id").distinct().withColumn("__there", F.lit(True))
        out = out.join(there, "record_id", "left").withColumn(name, F.col("__there").isNull()).drop("__there")
    return out.withColumn("clean", F.col("row_absent") & F.col("log_clean") & F.col("vector_absent") & F.col("lexical_absent"))


def erasure_report(record_id: str, events: DataFrame, records: DataFrame, vectors: DataFrame, lexical: DataFrame) -> DataFrame:
    """:func:`erasure_reports` for one record."""
    one = events.sparkSession.createDataFrame([(record_id,)], "record_id string")
    return erasure_reports(one, events, records, vectors, lexical)
