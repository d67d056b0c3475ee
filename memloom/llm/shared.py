"""Storage that every executor can read, and limits on Arrow batches.

A long job cuts its lineage by writing a table in the folder which the cluster
names in ``spark.checkpoint.dir`` and reading it back: the table survives lost
executors, keeps column pruning and costs one sequential write.

Tables that a result still reads cannot be deleted by the function that made
them.  All tables of an application lie in one folder of its own; once its
results are written, :func:`sweep` deletes it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.iterate import shared_root
from ..plans.ship import ship_package


def _home(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/memloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_home(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once in the shared folder; the result reads that table."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`durable` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_memloom_path", None)
        if path:
            remove(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; for when its results have been written."""
    remove(spark, _home(spark))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(name: str, columns: Sequence[str]) -> str:
    """``name``, lengthened until no column (in any case) is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Before any Python on executors: sends the package, and caps the rows and
    bytes of an Arrow batch, so that a worker's memory does not depend on how
    long neighbouring texts are.  Spark reads both when a plan runs, so they
    stay set for the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception:  # older releases lack the setting
        pass


def by_group(df: DataFrame, keys: Sequence[str], schema: str, run: Callable[[pa.Table], pa.Table | None]) -> DataFrame:
    """``run`` on the rows of each group of equal ``keys`` (numbers or bytes, never null).

    Rows are dealt and sorted by the keys and pass through a worker in batches,
    which holds one group at a time; many small groups cost one call of Python."""
    keys = list(keys)
    place = [df.columns.index(k) for k in keys]

    def cuts(t: pa.Table) -> list[int]:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in place:
            c = t.column(k).combine_chunks()
            c = c.dictionary_encode().indices if not pa.types.is_integer(c.type) else c
            v = c.to_numpy(zero_copy_only=False)
            new |= v[1:] != v[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            at = cuts(t)
            done = [run(t.slice(a, b - a).combine_chunks()) for a, b in zip(at[:-1], at[1:])]
            done = [d for d in done if d is not None and d.num_rows]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
            rest = t.slice(at[-1])
        if rest is not None:
            out = run(rest.combine_chunks())
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(passed, schema)
