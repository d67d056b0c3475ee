"""The data model: an append-only event log and the records folded from it."""

from __future__ import annotations

from pyspark.sql import types as T

MEMORY_TYPES = ("working", "episodic", "semantic", "procedural", "resource", "associative", "reflective", "prospective", "shared")
EVENT_KINDS = ("memory.write", "memory.retrieve", "memory.decay_transition", "memory.conflict", "memory.merge", "memory.consolidate", "memory.link", "memory.forget", "memory.rebuild")
STATUSES = ("activated", "resolving", "merged", "archived", "deleted")
PII_RANK = {"none": 0, "low": 1, "high": 2, "regulated": 3}

_NAMED = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def struct(**fields: T.DataType | str) -> T.StructType:
    """A struct of nullable fields; simple types by name.  Needs no session, unlike parsing DDL."""
    return T.StructType([T.StructField(k, _NAMED[v] if isinstance(v, str) else v) for k, v in fields.items()])


_STRINGS = T.ArrayType(T.StringType())
SOURCE = struct(role="string", channel="string", doc_path="string", message_id="string", prompt_version="string")
SCORING = struct(recency="double", relevance="double", importance="double", utility="double", access_count="bigint", last_accessed_at="timestamp")
VERSION = struct(version="int", content="string", valid_from="timestamp", valid_to="timestamp")
RECORD = struct(
    record_id="string", namespace="string", memory_type="string", content="string", content_fingerprint="string", entity="string", attribute="string", valid_from="timestamp", valid_to="timestamp", recorded_at="timestamp", superseded_at="timestamp",
    source=SOURCE, status="string", version="int", history=T.ArrayType(VERSION), evolve_to="string", pii_tier="string", consent_tags=_STRINGS, scoring=SCORING, trust="double", quarantined="boolean", instruction_flag="boolean",
    corroborations="int", simhash="bigint", minhash_sig=T.ArrayType(T.LongType()), tier="string", content_zstd="binary", skill_stage="string", reflection_depth="int", group_id="string", tags=_STRINGS,
)

#: What a transition may change; all else in its ``set`` is dropped.
MUTABLE = {"status": "string", "superseded_at": "timestamp", "evolve_to": "string", "tier": "string", "content": "string", "content_zstd": "binary", "valid_to": "timestamp", "quarantined": "boolean", "corroborations": "int", "skill_stage": "string", "memory_type": "string", "version": "int"}

PAYLOAD = struct(
    record=RECORD, record_id="string", record_ids=_STRINGS, set=T.MapType(T.StringType(), T.StringType()), transition="string", reason="string", hard="boolean",
    verdict="string", incoming_record_id="string", existing_record_id="string", action="string", entity="string", attribute="string", kept_record_id="string", dropped_record_id="string",
    derivation="string", member_record_ids=_STRINGS, session_key="string", summary_record_id="string", src="string", dst="string", rel="string", weight="double",
)
EVENT = struct(seq="bigint", kind="string", namespace="string", actor="string", ts="timestamp", payload=PAYLOAD)
EDGE = struct(src="string", dst="string", rel="string", weight="double", reason="string", seq="bigint")
