"""Predicates that decide which records a verb may see, as named columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.namespaces import is_within

_clean = lambda: ~F.coalesce(F.col("quarantined"), F.lit(False))


def retrievable() -> Column:
    return (F.col("status") == "activated") & _clean()


def visible() -> Column:
    """The operator's view: only deleted records are hidden."""
    return F.col("status") != "deleted"


def episodic_live() -> Column:
    return (F.col("status") != "deleted") & _clean()


def in_window(start: Column, end: Column, at: str = "valid_from") -> Column:
    """Half open: the start belongs to it, the end does not."""
    return (F.col(at) >= start) & (F.col(at) < end)


def in_group(group: str | None) -> Column:
    return F.lit(True) if group is None else F.col("group_id") == group


def has_tags(wanted: Sequence[str]) -> Column:
    """Carries all of them."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("tags", F.array().cast("array<string>")))) == 0 if wanted else F.lit(True)


def skill_usable() -> Column:
    return (F.col("skill_stage") == "active") & retrievable()


def live_link() -> Column:
    return (F.col("weight") > 0) & ~F.col("rel").isin("derived_from", "community")


def edge_weight(raw: Column) -> Column:
    """The weight, 1 where it is missing or no number."""
    return F.coalesce(raw.try_cast("double"), F.lit(1.0))


def compression_protected() -> Column:
    return (F.col("source.channel") == "persona") | F.coalesce("instruction_flag", F.lit(False)) | (F.col("status") == "resolving")


def held(holds: Sequence[str]) -> Column:
    """At or under a held namespace."""
    out = F.lit(False)
    for h in holds:
        out = out | is_within(F.col("namespace"), F.lit(h))
    return out


def listed(records: DataFrame, namespace: str, memory_type: str | None = None, group: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Records of a namespace, by exact match."""
    out = records.where((F.col("namespace") == namespace) & visible() & in_group(group) & has_tags(tags))
    return out if memory_type is None else out.where(F.col("memory_type") == memory_type)


def exists_in(records: DataFrame, record_id: str, namespace: str) -> DataFrame:
    """The record, if it is in the namespace; one error for a missing and a foreign one."""
    found = records.where((F.col("record_id") == record_id) & (F.col("namespace") == namespace))
    if found.limit(1).isEmpty():
        raise KeyError(f"no record {record_id!r} in {namespace!r}")
    return found
