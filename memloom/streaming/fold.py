"""The log as a stream: a snapshot of records that follows it batch by batch,
sessions that close behind a watermark, and standing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.fold import fold_records
from ..schema import RECORD
from ..sources import log


def _touched(events: DataFrame) -> DataFrame:
    p = F.col("payload")
    ids = F.array_compact(F.concat(F.array(p["record"]["record_id"], p["record_id"]), F.coalesce(p["record_ids"], F.array().cast("array<string>"))))
    return events.select(F.explode(ids).alias("record_id")).distinct()


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Snapshots that were written in full, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            done.append(int(name.split("=")[1]))
    return sorted(done)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last full snapshot; no rows before the first."""
    done = _epochs(spark, path)
    return spark.read.schema(RECORD).parquet(f"{path}/epoch={done[-1]}") if done else spark.createDataFrame([], RECORD)


def follow(spark: SparkSession, log_path: str, path: str, checkpoint: str, files_per_trigger: int = 1000) -> None:
    """Brings the snapshot up to all that the log holds, and returns.

    A micro-batch folds only the records that it touches, from their whole
    history up to its last number; a batch that runs again writes the same
    epoch again, so a record is never counted twice."""

    def put(batch: DataFrame, epoch: int) -> None:
        ids = _touched(batch)
        last = batch.agg(F.max("seq")).first()[0]
        if last is None:
            return
        history = log.read(spark, log_path).where(F.col("seq") <= last)
        mine = history.join(_touched_pairs(history).join(ids, "record_id", "left_semi").select("seq").distinct(), "seq", "left_semi")
        new = fold_records(mine).join(ids, "record_id", "left_semi")
        before = [e for e in _epochs(spark, path) if e < epoch]
        old = spark.read.schema(RECORD).parquet(f"{path}/epoch={before[-1]}") if before else spark.createDataFrame([], RECORD)
        old.join(ids, "record_id", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    log.stream(spark, log_path, files_per_trigger).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _touched_pairs(events: DataFrame) -> DataFrame:
    p = F.col("payload")
    ids = F.array_compact(F.concat(F.array(p["record"]["record_id"], p["record_id"]), F.coalesce(p["record_ids"], F.array().cast("array<string>"))))
    return events.select("seq", F.explode(ids).alias("record_id"))


def session_stream(records: DataFrame, gap_minutes: int = 30, lateness: str = "1 hour") -> DataFrame:
    """Closed sessions of a stream of records.  A gap of exactly ``gap_minutes`` opens a new session,
    so the window's own gap is a microsecond shorter."""
    gap = f"{gap_minutes * 60_000_000 - 1} microseconds"
    return records.withWatermark("valid_from", lateness).groupBy("namespace", F.session_window("valid_from", gap)).agg(F.count(F.lit(1)).alias("size"), F.max("valid_from").alias("end"), F.min("valid_from").alias("start"))


def standing_queries(writes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """New writes that share a term with a standing query (query_id, text) of a reader: a stream-static join on terms."""
    q = subscriptions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    w = writes.select("record_id", "namespace", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    return w.join(q, "term").select("query_id", "record_id", "namespace", "term")


def once(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A stream of events without repeats that arrive within ``lateness``."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["seq"])
