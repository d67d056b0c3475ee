"""A key-value cache as a table of puts: the last put of a key counts until it expires.

Entries go by first in, first out once there are more than the cap; a put of a
key that is there keeps the key's place.  The table is appended to and read as
a whole, so any number of writers may share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordering import counted_before

#: Live keys that are held; fixed value.
CAP = 65_536
PUT = "seq long, key string, value string, at timestamp, ttl_seconds double, deleted boolean"


def state(puts: DataFrame, now: Column, cap: int = CAP) -> DataFrame:
    """(key, value, since) of the live entries at ``now``: ``puts`` has the columns of ``PUT``.

    A null ttl never expires; a put or a deletion replaces what the key had;
    a key that was deleted or had expired by its next put comes in anew."""
    own = Window.partitionBy("key").orderBy("seq")
    ends = F.when(F.col("ttl_seconds").isNotNull(), F.unix_micros("at") + (F.col("ttl_seconds") * 1e6).cast("long"))
    p = puts.withColumns({"__ends": ends, "__gone": F.coalesce("deleted", F.lit(False))})
    anew = F.lag("seq").over(own).isNull() | F.lag("__gone").over(own) | F.coalesce(F.lag("__ends").over(own) <= F.unix_micros("at"), F.lit(False))
    p = p.withColumn("__in", F.when(anew & ~F.col("__gone"), F.col("seq")))
    last = p.groupBy("key").agg(F.max_by(F.struct("value", "__gone", "__ends"), "seq").alias("l"), F.max("__in").alias("since"))
    live = last.where(~F.col("l.__gone") & (F.col("l.__ends").isNull() | (F.col("l.__ends") > F.unix_micros(now)))).select("key", F.col("l.value").alias("value"), "since")
    # the newest of the cap: counted from the youngest, range by range
    return counted_before(live.withColumn("__age", -F.col("since")), "__younger", ["__age"]).where(F.col("__younger") < cap).select("key", "value", "since")


class Cache:
    """The same on a folder.  One writer at a time numbers its puts."""

    def __init__(self, spark: SparkSession, path: str, cap: int = CAP):
        self.spark, self.path, self.cap = spark, path, cap

    def _puts(self) -> DataFrame:
        from .log import _exists

        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], PUT)
        return self.spark.read.schema(PUT).parquet(self.path)

    def put(self, rows: DataFrame, now: Column, ttl_seconds: float | None = None, deleted: bool = False) -> None:
        """``rows``: key, value; of equal keys in one call the largest value counts."""
        start = self._puts().agg(F.max("seq")).first()[0] or 0
        rows = rows.groupBy("key").agg(F.max("value").alias("value"))
        numbered = counted_before(rows, "__n", ["key"])
        numbered.select((F.col("__n") + start + 1).cast("long").alias("seq"), "key", "value", now.alias("at"), F.lit(ttl_seconds).cast("double").alias("ttl_seconds"), F.lit(deleted).alias("deleted")).write.mode("append").parquet(self.path)

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """``keys`` (key) with their value, null where there is none."""
        return keys.join(state(self._puts(), now, self.cap).select("key", "value"), "key", "left")

    def delete(self, keys: DataFrame, now: Column) -> None:
        self.put(keys.select("key", F.lit(None).cast("string").alias("value")), now, deleted=True)

    def compact(self, now: Column, out: str) -> Cache:
        """The live entries alone, as a cache at ``out``; expiry times stay."""
        live = state(self._puts(), now, self.cap).select("key")
        last = Window.partitionBy("key").orderBy(F.desc("seq"))
        self._puts().join(live, "key", "left_semi").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n").write.parquet(out)
        return Cache(self.spark, out, self.cap)
