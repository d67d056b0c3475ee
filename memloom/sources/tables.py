"""Records, events, vectors and edges from plain tables.

Times are read as UTC; the inputs are the driver tables of the benchmark, and
each mapping is a projection, so filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAYLOAD, RECORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def record(**values: Column) -> list[Column]:
    """The record columns: given ones, then defaults of an active, trusted record."""
    defaults = {
        "status": F.lit("activated"), "version": F.lit(1), "pii_tier": F.lit("none"), "trust": F.lit(0.5), "quarantined": F.lit(False), "instruction_flag": F.lit(False), "corroborations": F.lit(0), "tier": F.lit("hot"), "reflection_depth": F.lit(0),
        "scoring": F.struct(F.lit(1.0).alias("recency"), F.lit(0.0).alias("relevance"), values.pop("importance", F.lit(0.0)).alias("importance"), values.pop("utility", F.lit(0.0)).alias("utility"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed_at")),
    }
    chosen = defaults | values
    if "content_fingerprint" not in chosen and "content" in chosen:
        chosen["content_fingerprint"] = F.sha2(F.coalesce(chosen["content"], F.lit("")), 256)
    return [chosen.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD]


def source(role: Column | None = None, channel: Column | None = None, doc_path: Column | None = None, message_id: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((role if role is not None else null).alias("role"), (channel if channel is not None else F.lit("internal")).alias("channel"), (doc_path if doc_path is not None else null).alias("doc_path"), (message_id if message_id is not None else null).alias("message_id"), null.alias("prompt_version"))


def payload(**values: Column) -> Column:
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD])


def episodic(events: DataFrame) -> DataFrame:
    """``events`` as episodic records of namespace user/{user_id}."""
    return events.select(*record(record_id=F.concat(F.lit("e"), "event_id"), namespace=F.concat(F.lit("user/"), "user_id"), memory_type=F.lit("episodic"), content=F.col("event_type"), valid_from=utc("ts"), recorded_at=utc("ts"), importance=F.least(F.coalesce("value", F.lit(0.0)) / 1000, F.lit(1.0)), source=source(F.lit("user"))))


def transcript(conversations: DataFrame, session_base: str = "2024-01-01", minutes: int = 5) -> DataFrame:
    """One episodic record a turn, ``minutes`` apart; namespace conv/{conv_id}."""
    at = F.lit(session_base).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("turn") * minutes).cast("int"))
    return conversations.select(*record(record_id=F.concat_ws("-", F.lit("t"), "conv_id", "turn"), namespace=F.concat(F.lit("conv/"), "conv_id"), memory_type=F.lit("episodic"), content=F.coalesce("text", F.lit("")), valid_from=at, recorded_at=at, source=source(F.col("role"), F.lit("messages"), message_id=F.col("turn").cast("string"))))


def episodes(conversations: DataFrame) -> DataFrame:
    """A whole transcript as one episode whose group is a fingerprint of its content."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("content"))
    return whole.select("conv_id", F.sha2("content", 256).alias("group_id"), "content")


def documents(docs: DataFrame) -> DataFrame:
    """``documents`` as resource records of namespace docs/{lang}, tagged with their source."""
    base = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    return docs.select(*record(record_id=F.concat(F.lit("d"), "doc_id"), namespace=F.concat(F.lit("docs/"), F.coalesce("lang", F.lit("none"))), memory_type=F.lit("resource"), content=F.coalesce("text", F.lit("")), valid_from=base, recorded_at=base, tags=F.array("source"), source=source(F.lit("tool"), F.lit("ingest"), F.concat(F.lit("doc/"), "doc_id")), importance=F.pmod(F.col("doc_id"), F.lit(10)) / 10))


def vectors(embeddings: DataFrame, prefix: str = "d", namespace: Column | None = None) -> DataFrame:
    return embeddings.select(F.concat(F.lit(prefix), "vec_id").alias("record_id"), (namespace if namespace is not None else F.lit("all")).alias("namespace"), F.col("embedding").alias("vector"))


def facts(orders: DataFrame) -> DataFrame:
    """``orders`` as facts on customers' priorities, in the order of their keys."""
    return orders.select(F.lit("facts").alias("namespace"), F.concat(F.lit("cust/"), "o_custkey").alias("entity"), F.lit("priority").alias("attribute"), F.concat(F.lit("o"), "o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("content"), F.lit(0.7).alias("trust"), utc("o_orderdate").alias("valid_from"), F.col("o_orderkey").cast("long").alias("seq"))


def event_log(events: DataFrame) -> DataFrame:
    """``events`` as a log on one record a user: signups and first views write, clicks read,
    purchases change the tier, errors forget (softly on even numbers)."""
    rid = F.concat(F.lit("u"), "user_id")
    ns = F.concat(F.lit("user/"), "user_id")
    kind = F.when(F.col("event_type").isin("signup"), "memory.write").when(F.col("event_type").isin("view", "click"), "memory.retrieve").when(F.col("event_type") == "purchase", "memory.decay_transition").otherwise("memory.forget")
    row = F.struct(*record(record_id=rid, namespace=ns, memory_type=F.lit("semantic"), content=F.concat_ws("-", "event_type", "event_id"), valid_from=utc("ts"), recorded_at=utc("ts")))
    return events.select(
        (F.col("event_id") + 1).cast("long").alias("seq"), kind.alias("kind"), ns.alias("namespace"), F.lit("loader").alias("actor"), utc("ts").alias("ts"),
        payload(record=F.when(kind == "memory.write", row), record_id=F.when(kind.isin("memory.decay_transition", "memory.forget"), rid), record_ids=F.when(kind == "memory.retrieve", F.array(rid)), set=F.when(kind == "memory.decay_transition", F.create_map(F.lit("tier"), F.when(F.col("event_id") % 3 == 0, "cold").otherwise("warm"), F.lit("trust"), F.lit("1.0"))), hard=F.when(kind == "memory.forget", F.col("event_id") % 2 == 1)).alias("payload"),
    )


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 texts (doc_path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, convert) -> DataFrame:
    """Rich formats through ``convert``, a column function from bytes to text."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_path"), convert(F.col("content")).alias("text"))
