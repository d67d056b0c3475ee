"""Running sums along an order without one task for all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import checkpointed


def sums_before(rows: DataFrame, sums: Mapping[str, Column], order: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of its value over the rows before, in the same ``key``.

    Rows are dealt by ranges of key and order, each range sums its own rows,
    and the sums of the ranges before are added from a small table.  The dealt
    rows are written first: ranges come from a sample, and both uses must see
    the same ones."""
    by = [*key, *order]
    dealt = checkpointed(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).withColumns({"__range": F.spark_partition_id()} | {f"__value_{n}": v for n, v in sums.items()}))
    inside = Window.partitionBy("__range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = dealt.groupBy("__range", *key).agg(*[F.sum(f"__value_{n}").alias(f"__sum_{n}") for n in sums])
    earlier = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__k_{c}") for c in key], *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), zero).alias(f"__start_{n}") for n in sums])
    on = F.col("__range") == F.col("__r")
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    own = {f"__own_{n}": F.coalesce(F.sum(f"__value_{n}").over(inside), zero) for n in sums}
    return dealt.withColumns(own).join(starts, on).withColumns({n: F.col(f"__start_{n}") + F.col(f"__own_{n}") for n in sums}).select(*rows.columns, *sums)


def counted_before(rows: DataFrame, name: str, order: Sequence[str], key: Sequence[str] = (), value: Column | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (1 if none) over the rows before, in the same ``key``."""
    return sums_before(rows, {name: value if value is not None else F.lit(1)}, order, key)
