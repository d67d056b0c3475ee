"""Exact deduplication as a stream with keyed state that never expires.

Every text's digest is a key of a streaming aggregation whose state lies on
disk (RocksDB, snapshots in the shared folder).  A key retains the digest, the
smallest identifier seen and the locator of its content (the feed file and the
row in it), and counts its texts.  Spark sums within a task before the
exchange, so a text that makes up a third of the input arrives as one row a
task.  Hits - texts whose key has more than one - are then held byte for byte
against the content that the locator names.

The feed, the state and its checkpoint lie in one folder.  A later call with
the same folder feeds its own rows only and goes on from the state, however
many rows came before.
"""

from __future__ import annotations

import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, durable, fresh, new_folder, remove

#: State on disk; each commit uploads its changes only, and files are not allocated ahead, which many small stores would pay for.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # one bound for all stores of an executor, and small write buffers: memory does not grow with the number of stores
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
}


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STATE_STORE}
    for k, v in _STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _first(*more: str) -> Column:
    """Ordered by id, null last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", *more)


def keyed_state(stream: DataFrame) -> DataFrame:
    """The state of a stream of (digest, id, locator): its keep, locator and count by digest."""
    return stream.groupBy("digest").agg(F.min(_first("locator")).alias("first"), F.count(F.lit(1)).alias("n"))


def run_stream(stream: DataFrame, checkpoint: str, state_path: str) -> None:
    """Feeds all that is there to the state; each micro-batch appends the keys
    it changed to ``state_path``.  Called again with the same checkpoint, it
    goes on with what arrived since."""

    def put(batch: DataFrame, epoch: int) -> None:
        # named by the epoch and overwritten: a batch that runs again after a failure leaves no second copy
        batch.select("digest", "first", "n").write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")

    with _rocks(stream.sparkSession):
        query = keyed_state(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()


_LOCATOR = "struct<file: string, row: bigint>"
_STATE = "digest string, first struct<none: boolean, id: {id}, locator: " + _LOCATOR + ">, n long, epoch int"


def read_state(spark: SparkSession, state_path: str, id_type: str) -> DataFrame:
    """The last state of each key: counts only grow, so the largest is the last."""
    return spark.read.schema(_STATE.format(id=id_type)).parquet(state_path).groupBy("digest").agg(F.max(F.struct("n", "first")).alias("s")).select("digest", F.col("s.first.id").alias("keep"), F.col("s.first.locator").alias("locator"), F.col("s.n").alias("n"))


def _located(feed: DataFrame) -> DataFrame:
    return feed.withColumn("locator", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_files_per_trigger: int = 4096, digest=digest_of, state_dir: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256`` (of the normalised text).

    Null texts equal the empty text.  A null id stays only if no row of its
    group has an id.  Rows that repeat the smallest id of their group are all
    marked ``kept``; :func:`dedup` lets one of them stay.  Other columns are
    not read; an empty table gives no rows.  Texts that share a digest but not
    their bytes are grouped by their bytes instead.

    A micro-batch reads at most ``max_files_per_trigger`` files.  With
    ``state_dir``, a folder that all calls share, the texts of earlier calls
    count: groups, their sizes and the smallest id are those of all rows fed so
    far, and the rows returned are those of this call.  A call that failed may
    be made again with another folder only, as its rows may have been fed."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    home, call = state_dir or new_folder(spark, "dedup"), uuid.uuid4().hex[:12]
    mine, state_path = f"{home}/feed/{call}", f"{home}/state"
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body"))).select("digest", "id", "body")
    later = _exists(spark, state_path)
    old = durable(read_state(spark, state_path, id_type), "dedup-before") if later else None
    rows.write.parquet(mine)
    stream = _located(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{home}/feed/*"))
    run_stream(stream.select("digest", "id", "locator"), f"{home}/checkpoint", state_path)
    state = durable(read_state(spark, state_path, id_type), "dedup-keys")
    feed = spark.read.schema(rows.schema).parquet(mine)

    # full bytes on hits; a hot key's rows stay apart, as each step writes its join and nothing above needs them together
    shared = state.where("n > 1").select("digest", "keep", F.col("locator").alias("at"), "n")
    hits = durable(_located(feed).join(shared, "digest"), "dedup-hits")
    bodies = hits.where("locator = at").select("digest", F.col("body").alias("keep_body"))
    if old is not None:
        # what earlier calls kept, read by its locator, stands for all their texts
        wanted = old.join(hits.select("digest").distinct(), "digest").select("digest", "locator")
        all_fed = _located(spark.read.schema(rows.schema).parquet(f"{home}/feed/*"))
        before = durable(all_fed.select("locator", "body").join(wanted, "locator").select("digest", F.col("body").alias("old_body")), "dedup-old")
        bodies = bodies.join(before, "digest", "full").select("digest", F.coalesce("keep_body", "old_body").alias("keep_body"), "old_body")
    else:
        bodies = bodies.withColumn("old_body", F.lit(None).cast("string"))
    named = durable(bodies, "dedup-named")
    unlike = (F.col("body") != F.col("keep_body")) | F.coalesce(F.col("keep_body") != F.col("old_body"), F.lit(False))
    checked = durable(hits.join(named, "digest").select("digest", "id", "keep", "n", unlike.alias("unlike")), "dedup-checked")
    discard(named)
    # only a key's single text can be there with a count of one
    once = state.where("n = 1").where(F.contains(F.col("locator.file"), F.lit(f"/{call}/"))).select("digest", F.col("keep").alias("id"), "keep", "n")
    clashes = f"{home}/clashes"
    found = checked.where("unlike").select("digest").distinct()
    if not found.isEmpty():
        found.write.mode("append").parquet(clashes)
    told = checked.select("digest", "id", "keep", "n")
    if _exists(spark, clashes):
        bad = durable(spark.read.schema("digest string").parquet(clashes).distinct(), "dedup-clashes")
        fed = spark.read.schema(rows.schema).parquet(f"{home}/feed/*").join(bad, "digest")
        own = durable(fed.groupBy("digest", "body").agg(F.min(_first()).alias("m"), F.count(F.lit(1)).alias("n")).select("digest", "body", F.col("m.id").alias("keep"), "n"), "dedup-own")
        apart = hits.select("digest", "id", "body").join(own, ["digest", "body"]).select("digest", "id", "keep", "n")
        told = told.join(bad, "digest", "left_anti").unionByName(apart)
    elif state_dir is None:
        discard(hits)
    if state_dir is None:
        remove(spark, home)
    return once.unionByName(told).select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of, state_dir: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts
    the one with the smallest id.  Edge cases as in :func:`exact_groups`.  With
    ``state_dir`` a row goes also where an earlier call has its text under an
    id that is not larger."""
    groups = durable(exact_groups(docs, id_col, text_col, digest=digest, state_dir=state_dir), "dedup-groups")
    key, gone_id, gone_digest = (fresh(n, docs.columns) for n in ("__digest", "__gone_id", "__gone_digest"))
    gone = groups.where("not kept").select(F.col(id_col).alias(gone_id), F.col("text_sha256").alias(gone_digest))
    out = docs.withColumn(key, digest(normalised(F.col(text_col))))
    out = out.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_digest)), "left_anti")
    # rows that repeat the id that stays are rare; only then are whole rows brought together
    if not groups.where("kept and group_size > 1").groupBy(id_col, "text_sha256").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, key])
    return out.drop(key)
