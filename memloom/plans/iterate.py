"""Fixpoints over tables: each round is cut off from the last by a reliable
checkpoint in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session of one machine that names no shared folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints/memloom"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; a session of more than one machine has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_FALLBACK


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to shared storage; executors may be lost without loss of the round."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def grow(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], rounds: int | None = None) -> DataFrame:
    """All rows reached from ``start``: ``step`` maps the newest rows to more, those with a known
    ``key`` are left out, until none is new or ``rounds`` are done.

    Each round writes its new rows only; what is known is the union of the
    rounds before, so the work of all rounds is bounded by what is reached."""
    fronts = [checkpointed(start)]
    n = 0
    while rounds is None or n < rounds:
        n += 1
        seen = reduce(DataFrame.unionByName, [f.select(*key) for f in fronts])
        front = checkpointed(step(fronts[-1]).dropDuplicates(key).join(seen, key, "left_anti"))
        if front.isEmpty():
            break
        fronts.append(front)
    return reduce(DataFrame.unionByName, fronts)
