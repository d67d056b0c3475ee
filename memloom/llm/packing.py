"""Packing token streams into fixed windows by best-fit decreasing.

A task tokenises the documents of its input partition and packs them as they
come, in rounds of ``round_pieces`` pieces: one narrow pass, and memory bounded
by the round.  Documents longer than a window are first cut into full windows;
what is left of each goes, longest first, to the tightest open window, found in
a segment tree indexed by remaining capacity.  The windows that a round leaves
poorly filled are opened again: their pieces, by now rows of a few numbers, are
packed once more together with those of other partitions, so the fill does not
depend on how the input is dealt.  A round is recomputed alike after a lost
executor, as it depends on its partition only, and what is packed again is read
from a table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import bounded_batches, durable

Encode = Callable[[str], np.ndarray]


class CapacityTree:
    """A segment tree over remaining capacities 0 to ``size``: how many open
    windows have each, and which is the smallest that is large enough."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the tightest window with room for ``need``."""
        node, count = need + self.leaves, self.count
        if need >= len(self.open):
            return None
        if not count[node]:
            while node > 1 and not (not node & 1 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (1 to ``size`` tokens), and the number of windows.
    Equal lengths keep their order, so equal input packs alike."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, used = CapacityTree(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        room, w = found if found else (size, used)
        used += not found
        window[i], offset[i] = w, size - room
        if room > n:
            tree.add(room - n, w)
    return window, offset, used


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


#: A word, a number or other signs, each with a space before it, or white space: the usual cut of byte-level vocabularies.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ("", "a", " The cat's 12 hats,\n\n  they'll\tgo…", "Zoë's naïve café: 東京 🙂!", "x<|endoftext|>y", "###$$$ A" * 3)


def encoder(vocabulary: bytes) -> Encode:
    """Ids of a text by the vocabulary file's content, without special tokens added.

    ``tokenizers`` defines the ids.  For a plain byte-level vocabulary in rank
    order the same merges run four times faster in ``tiktoken``; it is used
    only if both agree on the probes, and for no text on which it fails."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))

    def plain(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    try:
        import tiktoken

        spec = json.loads(vocabulary)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            return plain
        fast = tiktoken.Encoding("file", pat_str=_CUT, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)

        def quick(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special=allowed)
            except Exception:
                return plain(text)

        return quick if all(np.array_equal(quick(x), plain(x)) for x in _PROBES) else plain
    except (ImportError, KeyError, TypeError, ValueError):
        return plain


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A window with more room than this share of it is opened again.
SLACK = 1 / 128
#: Ids that a round holds at most where they are to be returned.
ROUND_IDS = 1 << 24
#: The numbers of windows that were packed again begin here; those of a partition's own at its number times 2^40.
AGAIN = 1 << 62


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, round_pieces: int = 100_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document, with its place in a sequence.

    Columns: ``id_col``, ``start`` (its document's ids before the piece),
    ``length``, ``ids_crc32`` of its little-endian 32-bit ids, ``doc_tokens``
    (with ``end_id``, which closes each document), ``sequence_id`` (unique, not
    gapless), ``offset`` in the sequence, and ``ids`` if ``with_ids``.

    ``vocabulary`` is a file that the driver can read; its content goes to the executors.
    A null or empty text is the single id ``end_id``.  Repeated rows and null
    ids are packed row by row; other columns are not read; an empty table
    gives no rows.  A sequence holds at most ``window`` ids; some ``round_pieces``
    pieces are packed together, which costs a few poorly filled windows a round."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = f"`{id_col}` {id_type}, {SCHEMA}" + ", ids array<long>" * with_ids
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value)
        base = TaskContext.get().partitionId() << 40
        ids: list[pa.Array] = []
        owner, rows, kept = [], [], []
        seen = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, seen, held
            table = np.array(rows, np.int64).reshape(-1, 4)
            w, off, used = best_fit_decreasing(table[:, 1], window)
            room = window - np.bincount(w, table[:, 1], used)
            cols = [pa.concat_arrays(ids).take(pa.array(owner, pa.int64())), *(pa.array(table[:, k]) for k in range(4)), pa.array(w + base), pa.array(off)]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int64())))
            base += used
            ids.clear(), owner.clear(), rows.clear(), kept.clear()
            seen = held = 0
            return pa.RecordBatch.from_arrays([*cols, pa.array((room > window * SLACK)[w])], names=[*names, "loose"])

        for batch in batches:
            ids.append(batch.column(0))
            for k, text in enumerate(pc.fill_null(batch.column(1), "").to_pylist()):
                got = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(got), window):
                    piece = got[a : a + window]
                    owner.append(seen + k)
                    rows.append((a, len(piece), zlib.crc32(piece), len(got)))
                    if with_ids:
                        kept.append(piece.astype(np.int64))
                        held += len(piece)
            seen += batch.num_rows
            if len(rows) >= round_pieces or held >= ROUND_IDS:
                yield flush()
        if rows:
            yield flush()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        # in an order of their own: rows may arrive otherwise when a task runs again
        t = pa.Table.from_batches(found).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        w, off, _ = best_fit_decreasing(t.column("length").to_numpy(), window)
        t = t.set_column(5, "sequence_id", pa.array(w + (AGAIN + (TaskContext.get().partitionId() << 40)))).set_column(6, "offset", pa.array(off))
        yield from t.to_batches(max_chunksize=10_000)

    first = durable(docs.select(id_col, text_col).mapInArrow(run, schema + ", loose boolean"), "packed")
    loose = first.where("loose").drop("loose")
    tasks = -(-loose.count() // (round_pieces if not with_ids else max(1, ROUND_IDS // window)))
    if not tasks:
        return first.drop("loose")
    return first.where("not loose").drop("loose").unionByName(loose.repartition(tasks, "sequence_id", "offset").mapInArrow(again, schema))


def fill(packed: DataFrame, window: int = 2048) -> float:
    """The share of its sequences that a packing fills; 1 where there are none."""
    from pyspark.sql import functions as F

    t = packed.agg(F.sum("length").alias("ids"), F.count_distinct("sequence_id").alias("sequences")).first()
    return t["ids"] / (window * t["sequences"]) if t["sequences"] else 1.0
