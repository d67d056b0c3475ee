"""The semantic write path over a batch: sketch, merge, key, ladder, events.

A batch is one set: its records count in the order of their ids, as if they
had come in one after another.  Quarantined ones are stored as they come and
take no part, so they neither merge nor replace anything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gates, semantic
from ..policies import Conflict, Dedup
from ..schema import RECORD
from .iterate import checkpointed

COLUMNS = [f.name for f in RECORD]


def duplicates(new: DataFrame, live: DataFrame, embed: Callable[[Column], Column], policy: Dedup = Dedup()) -> DataFrame:
    """(new_id, old_id): each new record that says what one before it says, with the record that it goes into.

    Both have record_id, namespace and content.  A record before is a live one,
    or a new one of a smaller id; who goes into a record that goes into another
    goes into that one too."""
    both = checkpointed(live.select("record_id", "namespace", "content", F.lit(0).alias("fresh")).unionByName(new.select("record_id", "namespace", "content", F.lit(1).alias("fresh"))))
    pairs = semantic.candidates(semantic.minhash(both, keep=("namespace",)), policy).select("new_id", "old_id")
    pairs = pairs.unionByName(pairs.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("old_id")))
    flag = lambda c: both.select(F.col("record_id").alias(c), F.col("fresh").alias(f"{c}_fresh"))
    order = (F.col("new_id_fresh") == 1) & ((F.col("old_id_fresh") == 0) | (F.col("old_id") < F.col("new_id")))
    pairs = pairs.join(flag("new_id"), "new_id").join(flag("old_id"), "old_id").where(order).select("new_id", "old_id")
    now = checkpointed(semantic.confirmed(pairs, both.select("record_id", embed(F.col("content")).alias("vector")), policy).select("new_id", "old_id"))
    while True:
        # every look halves the way that is left
        ahead = now.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("further"))
        moved = checkpointed(now.join(ahead, "old_id", "left"))
        if moved.where("further is not null").isEmpty():
            return now
        now = moved.select("new_id", F.coalesce("further", "old_id").alias("old_id"))


def after_merges(kept: DataFrame, dropped: DataFrame, policy: Dedup = Dedup()) -> DataFrame:
    """Whole records that took others in (``dropped``: kept_id, consent_tags, pii_tier), with what changed in them."""
    slim = kept.select("record_id", "consent_tags", "pii_tier", F.col("scoring.importance").alias("importance"), F.col("scoring.utility").alias("utility"))
    change = semantic.merged(slim, dropped, policy).select(F.col("record_id").alias("__id"), F.struct("consent_tags", "pii_tier", "importance", "utility").alias("__m"))
    scoring = F.col("scoring").withField("importance", F.col("__m.importance")).withField("utility", F.col("__m.utility"))
    return kept.join(change, F.col("record_id") == F.col("__id")).withColumns({"consent_tags": F.col("__m.consent_tags"), "pii_tier": F.col("__m.pii_tier"), "scoring": scoring}).select(*COLUMNS)


def verdicts(facts: DataFrame, active: DataFrame, policy: Conflict = Conflict()) -> DataFrame:
    """What the ladder makes of keyed facts after their key's active one: its columns, ``existing``
    (the active fact that each met) and ``fresh``."""
    key = ["namespace", "entity", "attribute"]
    cols = [*key, "record_id", "content", "trust", "valid_from"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("record_id")).cast("long")
    all_facts = facts.select(*cols, place.alias("seq")).unionByName(active.join(facts.select(*key).distinct(), key, "left_semi").select(*cols, F.lit(0).cast("long").alias("seq")))
    out = semantic.fact_ladder(all_facts, policy)
    wins = (F.col("verdict") == "update") | ((F.col("verdict") == "add") & (F.col("valid_to").isNull() | F.col("evolve_to").isNotNull()))
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("existing", F.last(F.when(wins, F.col("record_id")), ignorenulls=True).over(before)).withColumn("fresh", F.col("seq") > 0)


def semantic_writes(rows: DataFrame, records: DataFrame, now: Column, embed: Callable[[Column], Column], dedup: Dedup = Dedup(), conflict: Conflict = Conflict()) -> dict[str, DataFrame]:
    """What a batch of semantic records (whole ones) does to those that are stored.

    ``kept``: stored records rewritten by merges.  ``merges``: (kept_record_id, record) of each that went into
    another.  ``closed``: record_id, namespace, valid_to, evolve_to of facts that were replaced.  ``stored``:
    records to be written.  ``conflicts``: namespace, entity, attribute, verdict, action, incoming_record_id,
    existing_record_id of each fact that met an active one."""
    rows = checkpointed(rows)
    clean, held = rows.where(~F.col("quarantined")), rows.where("quarantined")
    near = records.join(rows.select("namespace").distinct(), "namespace", "left_semi").where(F.col("memory_type") == "semantic")
    live = checkpointed(near.where(gates.retrievable()).select(*COLUMNS))
    into = checkpointed(duplicates(clean, live, embed, dedup))
    merges = clean.join(into.withColumnRenamed("new_id", "record_id"), "record_id")
    merges = merges.select(F.col("old_id").alias("kept_record_id"), F.struct(*COLUMNS).alias("record"))
    dropped = merges.select(F.col("kept_record_id").alias("kept_id"), "record.consent_tags", "record.pii_tier")
    kept = after_merges(live, dropped, dedup)
    fresh = clean.join(into.select(F.col("new_id").alias("record_id")), "record_id", "left_anti")
    grown = after_merges(fresh, dropped, dedup)
    fresh = checkpointed(fresh.join(grown.select("record_id"), "record_id", "left_anti").unionByName(grown))
    keyed = F.col("entity").isNotNull() & F.col("attribute").isNotNull()
    judged = checkpointed(verdicts(fresh.where(keyed), semantic.active_facts(near), conflict))
    mine = judged.where("fresh").select(F.col("record_id").alias("__id"), F.col("verdict").alias("__verdict"), F.col("valid_to").alias("__to"), F.col("evolve_to").alias("__next"), F.col("status").alias("__status"))
    placed = fresh.where(keyed).join(mine, F.col("record_id") == F.col("__id")).where("__verdict <> 'noop'")
    gone = F.col("__status") == "archived"
    placed = placed.withColumns({"valid_to": F.col("__to"), "evolve_to": F.col("__next"), "status": F.col("__status"), "superseded_at": F.when(gone, now)}).select(*COLUMNS)
    closed = judged.where("not fresh and evolve_to is not null").select("record_id", "namespace", "valid_to", "evolve_to")
    action = F.when(F.col("verdict") == "update", "updated").when(F.col("verdict") == "noop", "rejected").otherwise("added")
    conflicts = judged.where("fresh and existing is not null").select("namespace", "entity", "attribute", "verdict", action.alias("action"), F.col("record_id").alias("incoming_record_id"), F.col("existing").alias("existing_record_id"))
    return {"kept": kept, "merges": merges, "closed": closed, "stored": fresh.where(~keyed).unionByName(placed).unionByName(held), "conflicts": conflicts}
