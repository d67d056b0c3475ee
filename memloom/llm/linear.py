"""What the linear text classifiers share: a bounded labelled sample, hashed
features of whole texts, and a scoring pass without a shuffle.

Features are 64-bit hashes and a model is a sorted array of those it knows, so
two features do not share a weight.  The sample is bounded in rows and in
bytes of text, both documented parameters, and so are the model, what reaches
the driver and what is broadcast: a text of b bytes has some 4 b features at
most, of eight bytes each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import blocks

#: From the bytes and offsets of a block: for each feature found its text's number and its hash, without repeats in a text, by text.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by text and then key."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])] if len(text) else np.zeros(0, bool)
    return text[new], key[new]


#: Bytes of text of each class that a sample holds at most.
SAMPLE_BYTES = 16 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, rows_per_class: int, id_col: str, text_col: str, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, text, y) of at most ``rows_per_class`` documents of each class, those
    whose id hashes lowest, up to ``sample_bytes`` of whole texts: the same
    sample on every run, spread over the table.

    ``may_learn`` is a predicate on the id.  Of repeated labels of an id the
    largest counts; null labels and ids do not.  Only the sample's ids, two
    times ``rows_per_class`` at most, are broadcast."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & may_learn).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    by = [F.xxhash64("id"), F.col("id")]
    some = known.where("y = 0").orderBy(*by).limit(rows_per_class).unionByName(known.where("y = 1").orderBy(*by).limit(rows_per_class))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    # an id's repeated rows count each
    order = Window.partitionBy("y").orderBy(*by, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__rows": F.count(F.lit(1)).over(order), "__bytes": F.sum(F.octet_length("text")).over(order)})
    return rows.where((F.col("__rows") <= rows_per_class) & (F.col("__bytes") <= sample_bytes)).select("id", "text", "y")


@dataclass
class Changes:
    """Changes that swapped sentences make to features: entry k adds ``sign[k]`` to feature ``key[k]`` in change ``row[k]``,
    and change i is there ``times[i]`` times."""

    row: np.ndarray
    key: np.ndarray
    sign: np.ndarray
    times: np.ndarray


@dataclass
class Sample:
    """Sparse rows: the features of text i are ``key[at[i]:at[i + 1]]``."""

    y: np.ndarray
    at: np.ndarray
    key: np.ndarray
    changes: Changes | None = None


#: From a column of texts, the changes that swapped sentences in it make: number of the text, of the change, feature and sign.
Swaps = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def merged(row: np.ndarray, key: np.ndarray, sign: np.ndarray) -> Changes:
    """Equal changes as one that counts for all."""
    order = np.lexsort((key, row))
    row, key, sign = row[order], key[order], sign[order]
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    seen: dict[bytes, int] = {}
    times, first = [], []
    for a, b in zip(at.tolist(), np.r_[at[1:], len(row)].astype(np.int64).tolist()):
        name = key[a:b].tobytes() + sign[a:b].tobytes()
        if name not in seen:
            seen[name] = len(times)
            times.append(0)
            first.append((a, b))
        times[seen[name]] += 1
    pick = np.concatenate([np.arange(a, b) for a, b in first]) if first else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(first)), [b - a for a, b in first]) if first else np.zeros(0, np.int64)
    return Changes(rows, key[pick], sign[pick].astype(float), np.array(times, float))


def collect_features(sample: DataFrame, features: Features, swaps: Swaps | None = None) -> Sample:
    """Features, and with ``swaps`` the changes of swapped sentences, are made on the executors; the bounded sample's hashes reach the driver, by id."""
    bounded_batches(sample.sparkSession)
    kind = sample.schema["id"].dataType.simpleString()

    def lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, data, offs in blocks(batch.column(1)):
                text, key = features(data, offs)
                sizes.append(np.bincount(text, minlength=b - a))
                keys.append(key.view(np.int64))
            text, change, key, sign = swaps(batch.column(1)) if swaps else [np.zeros(0, np.int64)] * 4
            size = np.bincount(text.astype(np.int64), minlength=n)
            cols = [lists(np.concatenate(sizes), np.concatenate(keys)), lists(size, change.astype(np.int64)), lists(size, key.view(np.int64)), lists(size, sign.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["id", "y", "found", "change", "key", "sign"])

    shape = ", ".join(f"{c} array<long>" for c in ("found", "change", "key", "sign"))
    table = sample.select("id", "text", "y").mapInArrow(run, f"id {kind}, y int, {shape}").toArrow().sort_by("id")

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = table.column(name).combine_chunks()
        return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    size, key = flat("found")
    out = Sample(table.column("y").to_numpy().astype(np.int64), np.r_[0, np.cumsum(size)], key.view(np.uint64))
    if swaps:
        (size, change), (_, keys), (_, sign) = flat("change"), flat("key"), flat("sign")
        # a change's number is its own within its text
        out.changes = merged(np.repeat(np.arange(len(size)), size) * (int(change.max(initial=0)) + 1) + change, keys.view(np.uint64), sign)
    return out


def indexed(sample: Sample, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted features found in ``least`` texts or more, and the rows (at, column) over them."""
    names, back, count = np.unique(sample.key, return_inverse=True, return_counts=True)
    kept = count >= least
    column = np.where(kept, np.cumsum(kept) - 1, -1)[back]
    inside = column >= 0
    at = np.r_[0, np.cumsum(inside)][sample.at]
    return names[kept], at, column[inside]


def lookup(names: np.ndarray, text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and columns of the features that the model knows."""
    if not len(names):
        return text[:0], text[:0]
    column = np.minimum(np.searchsorted(names, key), len(names) - 1)
    hit = names[column] == key
    return text[hit], column[hit]


def scored(docs: DataFrame, features: Features, score: Callable[[np.ndarray, np.ndarray, int], np.ndarray], names: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of every row: ``score`` gets texts, columns and the number of texts."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((names, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, score = shipped.value
        for batch in batches:
            out = [np.zeros(0)]
            for a, b, data, offs in blocks(batch.column(1)):
                out.append(score(*lookup(names, *features(data, offs)), b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def kept_rows(docs: DataFrame, features: Features, score: Callable[[np.ndarray, np.ndarray, int], np.ndarray], names: np.ndarray, below: float, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``below``."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((names, score))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, score = shipped.value
        for batch in batches:
            out = [np.zeros(0)]
            for a, b, data, offs in blocks(batch.column(place)):
                out.append(score(*lookup(names, *features(data, offs)), b - a))
            yield batch.filter(pa.array(np.concatenate(out) < below))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def platt(margin: np.ndarray, y: np.ndarray, balance: float = 1.0) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities: logistic regression
    with softened targets, by Newton's method.  ``balance``: 1 gives the classes equal weight, 0
    leaves them as they are."""
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, n1**-balance, n0**-balance)
    weight /= max(weight.sum(), 1e-300)
    t = np.array([1.0, 0.0])
    x = np.c_[margin, np.ones(len(margin))]
    for _ in range(50):
        p = sigmoid(x @ t)
        grad = x.T @ (weight * (p - target)) + 1e-4 * t * [1, 0]
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t = t - step * min(1, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(t[0], 1e-3)), float(t[1])
