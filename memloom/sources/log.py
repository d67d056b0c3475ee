"""The event log on shared storage: append, read, prune, offsets and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import counted_before
from ..schema import EVENT

MODES = ("full", "rolling", "ephemeral")


def number(events: DataFrame, after: int = 0) -> DataFrame:
    """``seq`` from ``after`` + 1 on, in the order of ts and batch_pos, without gaps.

    Rows are range-partitioned by time; each partition numbers its own rows and
    adds the counts of those before it, so no task sees the whole batch."""
    cols = [c for c in events.columns if c not in ("seq", "batch_pos")]
    order = ["ts", *["batch_pos"] * ("batch_pos" in events.columns)]
    out = counted_before(events, "__before", order)
    return out.select((F.lit(after + 1) + F.col("__before")).cast("long").alias("seq"), *cols)


def append(spark: SparkSession, path: str, events: DataFrame, mode: str = "full") -> int:
    """Appends a batch (without ``seq``) and returns the last number.  One writer at a time;
    a batch that has numbers is refused.  An ephemeral log keeps only the count."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if "seq" in events.columns:
        raise ValueError("the log numbers its events itself")
    if mode == "ephemeral":
        return events.count()
    after = last_seq(spark, path)
    number(events, after).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("namespace", "day").parquet(path)
    return last_seq(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def last_seq(spark: SparkSession, path: str) -> int:
    if not _exists(spark, path):
        return 0
    return read(spark, path).agg(F.max("seq")).first()[0] or 0


def read(spark: SparkSession, path: str, after: int = 0, limit: int | None = None) -> DataFrame:
    """Events after a number, in order if limited; the number is pushed down to the files' statistics."""
    out = spark.read.schema(EVENT).parquet(path).where(F.col("seq") > after)
    return out.orderBy("seq").limit(limit) if limit is not None else out


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def advance(offsets: DataFrame, moves: DataFrame) -> DataFrame:
    """Projector offsets that only go forward."""
    return offsets.unionByName(moves).groupBy("projector").agg(F.max("offset").alias("offset"))


def reset(offsets: DataFrame, projectors: Sequence[str], to: int = 0) -> DataFrame:
    """Projector offsets with those of ``projectors`` set back."""
    return offsets.withColumn("offset", F.when(F.col("projector").isin(*projectors), F.lit(to).cast("long")).otherwise(F.col("offset")))


def pruned(events: DataFrame, offsets: DataFrame, now: Column, retention_days: float, mode: str = "rolling") -> DataFrame:
    """What is left of a rolling log: an event goes once every projector has passed it and it is older than the retention."""
    if mode != "rolling":
        return events
    low = offsets.agg(F.min("offset")).first()[0] or 0
    old = F.col("ts") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(retention_days * 86400.0))
    return events.where(~((F.col("seq") <= low) & old))


def namespaces(records: DataFrame) -> DataFrame:
    return records.select("namespace").distinct()


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a relational store, read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def redacted(events: DataFrame, record_ids: Sequence[str] | DataFrame) -> DataFrame:
    """The log with the contents of records scrubbed wherever they are carried:
    snapshots, their histories, changes, and what was merged into them."""
    spark = events.sparkSession
    ids = record_ids if isinstance(record_ids, DataFrame) else spark.createDataFrame([(r,) for r in record_ids], "record_id string")
    ids = ids.select(F.col("record_id").alias("__gone")).distinct()
    p = F.col("payload")
    hit = _touching(events, ids)
    out = events.join(hit.withColumn("__hit", F.lit(True)), "seq", "left")
    record = p["record"].withField("content", F.lit("")).withField("content_zstd", F.lit(None).cast("binary")).withField("history", F.transform(p["record"]["history"], lambda v: v.withField("content", F.lit(""))))
    clean = p.withField("record", F.when(p["record"].isNotNull(), record)).withField("set", F.map_filter(p["set"], lambda k, _: ~k.isin("content", "content_zstd"))).withField("reason", F.concat_ws(" ", p["reason"], F.lit("[redacted]")))
    return out.withColumn("payload", F.when(F.col("__hit"), clean).otherwise(p)).select(*events.columns)


def _touching(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The numbers of events that carry a record's content: one equi-join over all carriers."""
    p = F.col("payload")
    carriers = F.array_distinct(F.array_compact(F.array(p["record"]["record_id"], p["record_id"], p["dropped_record_id"], p["kept_record_id"])))
    return events.select("seq", F.explode(carriers).alias("__id")).join(ids, F.col("__id") == F.col("__gone"), "left_semi").select("seq").distinct()


def _carried(p: Column) -> tuple[Column, Column]:
    """Whether a payload's snapshot, and whether its change, has content left."""
    versions = F.coalesce(p["record"]["history"], F.array().cast(EVENT["payload"].dataType["record"].dataType["history"].dataType))
    snapshot = (F.coalesce(p["record"]["content"], F.lit("")) != "") | p["record"]["content_zstd"].isNotNull() | F.exists(versions, lambda v: F.coalesce(v["content"], F.lit("")) != "")
    delta = F.map_contains_key(p["set"], "content") | F.map_contains_key(p["set"], "content_zstd")
    return F.coalesce(snapshot, F.lit(False)), F.coalesce(delta, F.lit(False))


def content_carriers(events: DataFrame) -> DataFrame:
    """(record_id, seq): the events in which content of a record is left: the mirror of :func:`redacted`."""
    p = F.col("payload")
    snapshot, delta = _carried(p)
    whose = F.array_distinct(F.array_compact(F.array(F.when(snapshot, p["record"]["record_id"]), F.when(delta, p["record_id"]))))
    return events.select(F.explode(whose).alias("record_id"), "seq")


def carries_content(events: DataFrame, record_id: str) -> DataFrame:
    """Events in which content of one record is left."""
    p = F.col("payload")
    snapshot, delta = _carried(p)
    return events.where(((p["record"]["record_id"] == record_id) & snapshot) | ((p["record_id"] == record_id) & delta))
