"""Sessions, summaries, decay, paging, watches, skills and ingest: each a pure
function of the records at a given ``now``, whose output rows become events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, first_sentence, strip
from ..policies import Decay, Retention, Sessions
from . import gates

DAY_US = 86_400_000_000.0


def numbered_sessions(records: DataFrame, policy: Sessions = Sessions(), key: str = "namespace", at: str = "valid_from", tie: str = "recorded_at") -> DataFrame:
    """``records`` with ``session_no`` from 1 on in each ``key``: a new one begins where the
    time since the record before is the gap or more."""
    order = Window.partitionBy(key).orderBy(at, tie, "record_id")
    gap = F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(order))
    opens = F.when(gap.isNull() | (gap >= int(policy.gap_minutes * 60e6)), 1).otherwise(0)
    return records.withColumn("__opens", opens).withColumn("session_no", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def session_key(ids: Column) -> Column:
    """A fingerprint of the members, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(ids), ","), 256)


def sessions(records: DataFrame, policy: Sessions = Sessions()) -> DataFrame:
    """(namespace, session_no, start, end, size, member_record_ids, session_key) of live episodic records."""
    live = numbered_sessions(records.where(gates.episodic_live()), policy)
    members = F.array_sort(F.collect_list(F.struct("valid_from", "recorded_at", "record_id")))
    out = live.groupBy("namespace", "session_no").agg(F.min("valid_from").alias("start"), F.max("valid_from").alias("end"), F.count(F.lit(1)).alias("size"), F.transform(members, lambda m: m["record_id"]).alias("member_record_ids"))
    return out.withColumn("session_key", session_key(F.col("member_record_ids")))


def summary_of(sentences: Column, policy: Sessions = Sessions()) -> Column:
    return F.rtrim(F.substring(F.array_join(F.filter(sentences, lambda s: s != ""), " "), 1, policy.summary_chars), F.lit(SPACE))


def consolidate(records: DataFrame, now: Column, policy: Sessions = Sessions(), seen: DataFrame | None = None) -> DataFrame:
    """A summary for each closed session of enough members that has none yet:
    namespace, session_key, summary_record_id, content, valid_from, valid_to, trust, member_record_ids."""
    own = records.where((F.col("memory_type") == "episodic") & (F.col("status") == "activated") & ~F.coalesce("quarantined", F.lit(False)) & (F.coalesce(F.col("source.channel"), F.lit("")) != "consolidation"))
    live = numbered_sessions(own, policy)
    members = F.array_sort(F.collect_list(F.struct("valid_from", "recorded_at", "record_id", first_sentence(F.col("content")).alias("s"))))
    out = live.groupBy("namespace", "session_no").agg(F.min("valid_from").alias("valid_from"), F.max("valid_from").alias("valid_to"), F.min("trust").alias("trust"), members.alias("m"))
    closed = F.unix_micros(F.col("valid_to")) < F.unix_micros(now) - int(policy.gap_minutes * 60e6)
    out = out.where(closed & (F.size("m") >= policy.min_members))
    out = out.withColumn("member_record_ids", F.transform("m", lambda m: m["record_id"])).withColumn("session_key", session_key(F.col("member_record_ids")))
    out = out.withColumn("content", summary_of(F.transform("m", lambda m: m["s"]), policy)).withColumn("summary_record_id", F.concat(F.lit("s-"), F.substring("session_key", 1, 16)))
    if seen is not None:
        out = out.join(seen.select("session_key"), "session_key", "left_anti")
    return out.select("namespace", "session_key", "summary_record_id", "content", "valid_from", "valid_to", "trust", "member_record_ids")


def superseded_summaries(fresh: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stored summaries that overlap a fresh one of their namespace: to be archived."""
    old = summaries.select("namespace", F.col("record_id").alias("old_id"), F.col("valid_from").alias("f"), F.col("valid_to").alias("t"))
    return fresh.join(old, "namespace").where("f <= valid_to and t >= valid_from and old_id <> summary_record_id").select("old_id", "summary_record_id")


def idle_days(now: Column) -> Column:
    """Since the last access or the making, whichever is later."""
    anchor = F.greatest(F.coalesce(F.col("scoring.last_accessed_at"), F.col("recorded_at")), F.col("recorded_at"))
    return (F.unix_micros(now) - F.unix_micros(anchor)) / DAY_US


def tier_of(days: Column, policy: Decay = Decay()) -> Column:
    return F.when(days < policy.warm_days, "hot").when(days < policy.cold_days, "warm").when(days < policy.dormant_days, "cold").otherwise("dormant")


def decay_sweep(records: DataFrame, now: Column, policy: Decay = Decay()) -> DataFrame:
    """(record_id, namespace, tier, new_tier) of records whose tier changes."""
    own = records.where(F.col("memory_type").isin(*policy.types) & gates.episodic_live()).withColumn("new_tier", tier_of(idle_days(now), policy))
    return own.where(F.col("new_tier") != F.coalesce("tier", F.lit("hot"))).select("record_id", "namespace", "tier", "new_tier")


def compressible(records: DataFrame, retention: Retention = Retention()) -> DataFrame:
    """Dormant records whose content may be packed away."""
    return records.where((F.col("tier") == "dormant") & F.col("content_zstd").isNull() & (F.length("content") > 0) & ~gates.held(retention.holds) & ~gates.compression_protected())


def packed(content: Column) -> Column:
    """zstd of a text, level 3; the JVM has no such function."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        return texts.map(lambda t: None if t is None else c.compress(t.encode()))

    return run(content)


def unpacked(data: Column) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        import zstandard

        d = zstandard.ZstdDecompressor()
        return rows.map(lambda b: None if b is None else d.decompress(bytes(b)).decode())

    return run(data)


def overflow(records: DataFrame, page_size: int = 16) -> DataFrame:
    """Working records beyond the newest ``page_size`` of their namespace; personas are pinned.
    Deleted and quarantined ones take up room too."""
    own = records.where((F.col("memory_type") == "working") & (F.coalesce(F.col("source.channel"), F.lit("")) != "persona"))
    order = Window.partitionBy("namespace").orderBy(F.desc("recorded_at"), F.desc("record_id"))
    return own.withColumn("slot", F.row_number().over(order)).where(F.col("slot") > page_size)


def timeline(records: DataFrame, start: Column, end: Column) -> DataFrame:
    return records.where(gates.episodic_live() & gates.in_window(start, end)).orderBy("valid_from", "recorded_at", "record_id")


def _watches(records: DataFrame) -> DataFrame:
    return records.where((F.col("memory_type") == "prospective") & gates.retrievable())


def due(records: DataFrame, now: Column) -> DataFrame:
    """Time watches that have come due."""
    return _watches(records).where(F.col("entity").isNull() & (F.col("valid_from") <= now))


def invalidated(records: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Target watches whose fact was replaced since they were set.  ``conflicts``: namespace, entity, attribute, ts, action."""
    w = _watches(records).where(F.col("entity").isNotNull())
    c = conflicts.where(F.col("action").isin("updated", "invalidated")).select(F.col("namespace").alias("c_ns"), F.col("entity").alias("c_entity"), F.col("attribute").alias("c_attribute"), F.col("ts").alias("c_ts"))
    on = (w["namespace"] == c["c_ns"]) & (w["entity"] == c["c_entity"]) & (w["attribute"].isNull() | (w["attribute"] == c["c_attribute"])) & (c["c_ts"] >= w["recorded_at"])
    return w.join(c, on, "left_semi")


def firing(records: DataFrame, conflicts: DataFrame, now: Column) -> DataFrame:
    return due(records, now).unionByName(invalidated(records, conflicts)).dropDuplicates(["record_id"])


#: Steps of the skill ladder; from any but the last a skill may be deprecated.
LADDER = ("draft", "staged", "verified", "active")


def next_stage(stage: Column, quarantined: Column, dry_run_ok: Column) -> Column:
    """The stage after a promotion; itself where it may not move."""
    out = stage
    for a, b in zip(LADDER, LADDER[1:]):
        ok = ~F.coalesce(quarantined, F.lit(False)) & (F.coalesce(dry_run_ok, F.lit(False)) if b == "active" else F.lit(True))
        out = F.when((stage == a) & ok, b).otherwise(out)
    return out


def skill_status(stage: Column) -> Column:
    return F.when(stage == "active", "activated").when(stage == "deprecated", "archived").otherwise("resolving")


def recall_plan(tasks: DataFrame, plans: DataFrame, min_similarity: float = 0.6) -> DataFrame:
    """Each task's nearest usable plan, if it is near enough.  tasks: query_id, namespace, vector;
    plans: record_id, namespace, vector."""
    from .vector import topk

    return topk(tasks, plans, 1).where(F.col("score") >= min_similarity).drop("rank")


def chunks(docs: DataFrame, max_chars: int = 1200, text: str = "text") -> DataFrame:
    """``docs`` with ``chunk_no`` and ``chunk``: paragraphs between blank lines, trimmed and
    packed up to ``max_chars``; a longer one is cut.

    Cutting is a function of one text, so the pass is narrow: a fold over its
    paragraphs carries the open chunk and those that are done."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), strip), lambda p: p != "")
    # each piece tells whether it must stand alone (a full cut), so that the fold only packs
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def cut(p: Column) -> Column:
        n = F.greatest(F.ceil(F.length(p) / max_chars), F.lit(1)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(strip(F.substring(p, k * max_chars + 1, F.lit(max_chars))).alias("t"), (k < n - 1).alias("full")))
        return F.filter(pieces, lambda x: x["t"] != "")

    def step(now: Column, x: Column) -> Column:
        opened = now["open"]
        closed = F.when(opened != "", F.concat(now["done"], F.array(opened))).otherwise(now["done"])
        joined = F.when(opened != "", F.concat(opened, F.lit("\n\n"), x["t"])).otherwise(x["t"])
        fits = F.length(joined) <= max_chars
        return F.when(x["full"], F.struct(F.concat(closed, F.array(x["t"])).alias("done"), F.lit("").alias("open"))).when(fits, F.struct(now["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(closed.alias("done"), x["t"].alias("open")))

    end = lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    return docs.select("*", F.posexplode(F.aggregate(F.flatten(F.transform(paragraphs, cut)), start, step, end)).alias("chunk_no", "chunk"))


def fresh_chunks(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose (doc_path, content_fingerprint) is not stored yet."""
    return found.join(stored.select("doc_path", "content_fingerprint").distinct(), ["doc_path", "content_fingerprint"], "left_anti")


def fresh_prompts(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Prompt versions (entity, version) that are not recorded yet."""
    return declared.join(stored.select("entity", "version").distinct(), ["entity", "version"], "left_anti")


def reflections(proposals: DataFrame, records: DataFrame, max_depth: int = 2) -> DataFrame:
    """Proposals (reflection_id, namespace, content, trust, member_record_ids) that may be written,
    with ``reflection_depth`` and the least trust of their own and their parents'.  One is refused
    if a parent is missing, foreign, deleted or quarantined, or if it would be too deep."""
    parents = proposals.select("reflection_id", "namespace", F.explode("member_record_ids").alias("record_id"))
    known = records.select("record_id", F.col("namespace").alias("p_ns"), "status", "quarantined", F.col("trust").alias("p_trust"), "reflection_depth")
    good = (F.col("p_ns") == F.col("namespace")) & (F.col("status") != "deleted") & ~F.coalesce("quarantined", F.lit(False))
    judged = parents.join(known, "record_id", "left").groupBy("reflection_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("ok"), F.min("p_trust").alias("least"), (F.max(F.coalesce("reflection_depth", F.lit(0))) + 1).alias("reflection_depth"))
    out = proposals.join(judged, "reflection_id").where(F.col("ok") & (F.col("reflection_depth") <= max_depth))
    return out.withColumn("trust", F.least("trust", "least")).drop("ok", "least")
