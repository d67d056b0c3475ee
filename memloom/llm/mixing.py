"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash and queued, up to three times
over.  A copy's virtual finish time is the tokens of its source up to and with
it, divided by the source's target; copies are taken in the order of finish
times over all sources until the total budget is spent.

Running sums are split: a source's rows fall into hash buckets of bounded
size, the buckets' sums are added up in a small table, and rows only within
their bucket, so a source with a third of all rows is many tasks.  The cut in
the global order is found the same way, by two rounds of sums over ranges of
finish times and one look into the range that it falls into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import sums_before
from .shared import durable, fresh

#: Rows of a source that share a hash bucket, on average.
BUCKET_ROWS = 10_000
#: Ranges of finish times in a round, for each unit of time.
RANGES = 1024
#: A range of so many copies is looked into row by row.
RANGE_ROWS = 100_000
#: A document is taken so many times at most.
MOST_COPIES = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _source_key(source: Column) -> Column:
    """The source as a key that is never null; null comes last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = MOST_COPIES) -> DataFrame:
    """(key, source_size, rows) by source, with ``weight`` and ``target``.

    The sources, by key, weigh ``weights`` in turn and share the total size;
    no target is above ``most`` times its source's size, and what is left over
    is shared again by weight until none is above.  The end of that is found in
    one go: in the order of cap over weight, sources reach their caps up to
    the first whose cap is not below its share of what the ones before leave.
    The table has a row for each source and is summed up range by range, so
    sources may be as many as hosts; three numbers reach the driver."""
    t = sums_before(sizes, {"place": F.lit(1)}, ["key"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    t = t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    t = sums_before(t, {"before": F.col("cap"), "shut": F.col("weight"), "at": F.lit(1)}, ["ratio", "key"])
    level = (F.lit(total["size"]) - F.col("before")).cast("double") / (F.lit(total["weight"]) - F.col("shut"))
    first_open = t.withColumn("level", level).where(F.col("cap") >= F.col("level") * F.col("weight")).orderBy("at").select("level").first()
    share = F.lit(first_open["level"] if first_open else 0.0) * F.col("weight")
    return t.withColumn("target", F.least(F.col("cap").cast("double"), share)).select("key", "source_size", "rows", "weight", "target")


def _finish(epoch: Column) -> Column:
    """The virtual finish time of a row's copy; 0 where a source has no tokens."""
    return F.coalesce(F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")), F.lit(0.0))


def queue(docs: DataFrame, weights: Sequence[float], seed: int, id_col: str, source_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, key, source, size, h (its place in the
    shuffle), source_size, target and upto (its source's tokens up to and with
    it); and ``row``, a name for the row."""
    h = F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"), F.xxhash64(F.col(text_col)).alias("t"), (F.lit(0) if row is None else row).cast("long").alias("row"))
    rows = durable(rows.withColumn("key", _source_key(F.col("source"))), "mix-rows")
    plan = durable(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights), "mix-targets")
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    split = rows.join(plan, "key").withColumn("bucket", F.floor(place * F.ceil(F.col("rows") / BUCKET_ROWS)))
    sums = split.groupBy("key", "bucket").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key", "bucket", before.alias("before"))
    # rows that agree in all of these are alike
    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("h", "id", "size", "t").rowsBetween(Window.unboundedPreceding, 0))
    out = split.withColumn("inside", inside).join(sums, ["key", "bucket"])
    return durable(out.select("id", "key", "source", "size", "h", "source_size", "target", (F.col("before") + F.col("inside")).alias("upto"), "row"), "mix-queue")


def _cut(rows: DataFrame, most: int) -> tuple | None:
    """(finish, key, epoch, h) of the last copy that the budget takes; None if it takes none."""
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch")).withColumn("finish", _finish(F.col("epoch")))
    budget = rows.agg(F.sum("size")).first()[0] or 0
    low, width, spent = 0.0, 1.0, 0
    part = copies
    while width > 1e-12:
        # targets share what there is, so the cut is near 1; ranges past the last number are one, so the table of sums stays small
        number = F.least(F.floor((F.col("finish") - low) / width * RANGES), F.lit(64 * RANGES))
        sums = part.groupBy(number.alias("r")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        running = F.sum("s").over(Window.orderBy("r"))
        hit = sums.select("r", "s", "n", running.alias("run")).where(F.col("run") + spent > budget).orderBy("r").first()
        if hit is None:
            break
        spent += hit["run"] - hit["s"]
        part = part.where(number == hit["r"])
        if hit["r"] == 64 * RANGES:
            break
        low, width = low + hit["r"] * width / RANGES, width / RANGES
        if hit["n"] <= RANGE_ROWS:
            break
    order = ["finish", "key", "epoch", "h"]
    running = F.sum("size").over(Window.orderBy(*order, "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = part.select(*order, running.alias("run")).where(F.col("run") + spent <= budget).orderBy(*[F.desc(c) for c in order]).first()
    if last is not None:
        return tuple(last[c] for c in order)
    below = copies.where(F.col("finish") < low).orderBy(*[F.desc(c) for c in order]).select(*order).first()
    return tuple(below) if below is not None else None


def _taken(rows: DataFrame) -> Column:
    """How often each row of a queue is taken."""
    cut = _cut(rows, MOST_COPIES)
    copies: Column = F.lit(0)
    if cut is not None:
        last = F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).alias("k"), F.lit(cut[2]).alias("e"), F.lit(cut[3]).alias("h"))
        for e in range(MOST_COPIES):
            mine = F.struct(_finish(F.lit(e)).alias("f"), F.col("key").alias("k"), F.lit(e).alias("e"), F.col("h"))
            copies = copies + (mine <= last).cast("int")
    return copies


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, ``source_col``, ``size`` in words,
    ``source_size``, ``target``, ``copies`` (0 to 3) and ``finish`` of the first copy.

    Null texts have no words; empty ones are taken with their source's first
    rows at no cost.  A null source is a source of its own, the last; null ids
    share one place in the shuffle.  Rows that share an id stand together in
    it and count each for itself.  Other columns are not read; an empty table
    gives no rows.  The result depends on the rows and ``seed`` alone."""
    rows = queue(docs, weights, seed, id_col, source_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _taken(rows).alias("copies"), _finish(F.lit(0)).alias("finish"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it does, with all their columns.
    Edge cases as in :func:`mix`.  Rows get a number when they are written, by
    which they are found again, so no id has to be there or be unlike others."""
    row, other, copies = (fresh(n, docs.columns) for n in ("__row", "__other", "__copies"))
    base = durable(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    rows = queue(base, weights, seed, id_col, source_col, text_col, F.col(row))
    taken = rows.select(F.col("row").alias(other), _taken(rows).alias(copies)).where(F.col(copies) > 0)
    out = base.join(taken, F.col(row) == F.col(other))
    return out.withColumn(other, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[base[c] for c in docs.columns])
