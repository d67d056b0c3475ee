"""Near-duplicate groups: banded MinHash candidates, odd sketches, full sets.

One narrow pass turns each text into the digest of its shingle set, 128
MinHash samples folded into 32 band keys, and an odd sketch: a bitmap in which
each sample flips one bit.  Two sketches' exclusive-or has a set bit for
samples that differ, so its population count estimates a high similarity
sharply; pairs that it puts far below the threshold are not looked at further.
Texts with the same set are one node from then on, named by the set's digest.

In each bucket of a band every node's sketch is first held against that of the
bucket's smallest node, by joins alone.  In a bucket of copies that leaves
nothing; what it leaves is held against the bucket's nodes of about its own
size, in blocks, by sketches only.  Nodes whose sketches agree in a bucket,
directly or through others, are a family; texts are read for family members
only.  A family that fits one task is compared there.  A larger one is
compared with its smallest member first, block by block, and then the members
that this did not link with all.  Comparisons count shared shingles by their
words' bytes, skip pairs that are in one component already, and only a
spanning forest of the links leaves a task, never pairs.

At a similarity of 0.8 a pair shares none of 32 bands of 4 samples with a
probability of (1 - 0.8^4)^32, or 5 in 100 million."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, by_group, discard, durable, fresh
from .words import blocks, codes, mix, run_hashes, runs, sets, strong, word_bounds

SAMPLES, BANDS, ROWS, SKETCH_BITS = 128, 32, 4, 1024
#: Nodes of a family, and the shingles of all their sets, that are compared at once with as many others.
BLOCK_NODES, BLOCK_SHINGLES = 512, 200_000
#: Sketches of a bucket that are compared at once with as many others.
BLOCK_SKETCHES = 2048
#: A pair at the threshold of 0.8 differs in 25.6 of 128 samples on average, with a deviation of 4.5.
#: Each that differs flips two bits at most, so up to 50 of them, five deviations more, stay below this.
SKETCH_LIMIT = 100

_U = np.uint64
_MULTIPLY = mix(np.arange(1, SAMPLES + 1, dtype=_U)) | _U(1)
_ADD = mix(np.arange(1001, SAMPLES + 1001, dtype=_U))
_SAMPLE_NO = mix(np.arange(5001, SAMPLES + 5001, dtype=_U))


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of hashes."""
    low = np.full(SAMPLES, ~_U(0), _U)
    for a in range(0, len(found), 1024):
        np.minimum(low, (found[a : a + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return low >> _U(20)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """For each row of samples the bitmap in which sample k flips the bit that it and k choose, as 64-bit words."""
    bit = (mix(mins + _SAMPLE_NO) % _U(SKETCH_BITS)).astype(np.int64)
    flat = np.bincount((bit + SKETCH_BITS * np.arange(len(mins))[:, None]).ravel(), minlength=SKETCH_BITS * len(mins))
    return np.packbits((flat & 1).astype(np.uint8).reshape(len(mins), SKETCH_BITS), axis=1, bitorder="little").view("<i8")


def band_keys(mins: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U)), (len(mins), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key ^ mins[:, r * BANDS : (r + 1) * BANDS])
    return key.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, whole (SHA-256 of the text), n shingles, set digest, band keys and odd sketch
    (the digest and what follows mean nothing where n is 0).

    Shingles are counted by their words' bytes; the digest is made from two hashes of each."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, mins = [], [], []
            for _, _, data, offs in blocks(batch.column(2)):
                starts, ends, first = word_bounds(data, offs)
                code, words = codes(data, starts, ends)
                one, two = (run_hashes(strong(words, k)[code], first, width) for k in (0, 1))
                for at in sets(code, first, width):
                    found = one[at]
                    order = np.argsort(found)
                    n.append(len(at))
                    digest.append(hashlib.blake2b(found[order].tobytes() + two[at][order].tobytes(), digest_size=16).digest() if len(at) else None)
                    mins.append(samples(found))
            mins = np.array(mins, _U).reshape(-1, SAMPLES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(band_keys(mins)), _lists(odd_sketches(mins))], names=["id", "whole", "n", "digest", "bands", "odd"])

    rows = docs.select(F.col(id_col).alias("id"), _whole(F.col(text_col)).alias("whole"), F.col(text_col))
    return rows.mapInArrow(run, f"id {kind}, whole binary, n long, digest binary, bands array<long>, odd array<long>")


def _whole(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def exact_sets(column: pa.ChunkedArray | pa.Array, width: int) -> list[np.ndarray]:
    """The set of each text as numbers, the same in all texts of the column for the same shingle only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    starts, ends, first = word_bounds(data, offs - offs[0])
    code, _ = codes(data, starts, ends)
    run = runs(code, width)
    out, short = [], {}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:  # a sequence of its own: numbered below zero
            out.append(np.array([-1 - short.setdefault(tuple(code[a:b].tolist()), len(short))]))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def forest(same: np.ndarray, n: np.ndarray, odd: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, bodies: pa.ChunkedArray | None, width: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs (row of ``left``, row of ``right``) that join all rows which links between the two join, and
    each row's component.  ``same`` numbers the nodes; without ``bodies`` sketches alone make a link."""
    part = same.copy()
    pairs: list[tuple[int, int]] = []
    index = found = None
    for i in left.tolist():
        near = right[part[right] != part[i]]
        size = 100 * np.minimum(n[i], n[near]) >= percent * np.maximum(n[i], n[near])
        near = near[size]
        if len(near):
            near = near[np.bitwise_count(odd[i] ^ odd[near]).sum(axis=1) <= SKETCH_LIMIT]
        if not len(near):
            continue
        if bodies is not None:
            if index is None:  # only now are the texts needed
                found = exact_sets(bodies, width)
                key = np.concatenate([found[j] for j in right.tolist()])
                owner = np.repeat(right, [len(found[j]) for j in right.tolist()])
                order = np.argsort(key, kind="stable")
                index = key[order], owner[order]
            key, owner = index
            a, b = np.searchsorted(key, found[i]), np.searchsorted(key, found[i], "right")
            hits = b > a
            a, b = a[hits], b[hits]
            at = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange(int((b - a).sum()))
            both = np.bincount(owner[at], minlength=len(n))[near]
            near = near[100 * both >= percent * (n[i] + n[near] - both)]
        if len(near):
            joined, one = np.unique(part[near], return_index=True)
            pairs += [(i, int(near[k])) for k in one.tolist()]
            part[np.isin(part, joined) | (part == part[i])] = min(int(joined[0]), int(part[i]))
    return pairs, part


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the nodes in the order of their digests, sizes and sketches."""
    node = table.column("digest").combine_chunks()
    names = node.unique().sort()
    same = pc.index_in(node, names).to_numpy(zero_copy_only=False).astype(np.int64)
    odd = table.column("odd").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_BITS // 64)
    return same, table.column("n").to_numpy(), odd


def _links(width: int, percent: int):
    """Links (a, b) between the rows of a group that are on the left and those on the right."""

    def run(table: pa.Table) -> pa.Table:
        right = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
        same, n, odd = _arrays(table)
        bodies = table.column("body") if "body" in table.column_names else None
        pairs, _ = forest(same, n, odd, np.flatnonzero(~right), np.flatnonzero(right), percent, bodies, width)
        at, node = np.array(pairs, np.int64).reshape(-1, 2), table.column("digest")
        return pa.table({"a": node.take(pa.array(at[:, 0])), "b": node.take(pa.array(at[:, 1]))})

    return run


def _parts(width: int, percent: int):
    """Every node of a family with the smallest of its component, where they differ."""

    def run(table: pa.Table) -> pa.Table:
        same, n, odd = _arrays(table)
        rows = np.arange(table.num_rows)
        _, part = forest(same, n, odd, rows, rows, percent, table.column("body"), width)
        at = {int(s): k for k, s in enumerate(same.tolist())}
        moved = [(k, at[int(p)]) for k, (s, p) in enumerate(zip(same.tolist(), part.tolist())) if s != p]
        at, node = np.array(moved, np.int64).reshape(-1, 2), table.column("digest")
        return pa.table({"a": node.take(pa.array(at[:, 0])), "b": node.take(pa.array(at[:, 1]))})

    return run


def _close(n1: Column, n2: Column, odd1: Column, odd2: Column, percent: int) -> Column:
    differ = F.aggregate(F.zip_with(odd1, odd2, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (differ <= SKETCH_LIMIT)


def _deal(left: DataFrame, right: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows by ``group`` and a pair of blocks: ``left`` is dealt into ``lefts`` blocks and ``right`` into ``rights``,
    and every block of the one meets every block of the other."""
    place = F.xxhash64("digest")
    i = left.withColumn("i", F.pmod(place, "lefts").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights").cast("int") - 1)))
    j = right.withColumn("j", F.pmod(place, "rights").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts").cast("int") - 1)))
    pick = lambda d, r: d.select(*group, "i", "j", *columns, F.lit(r).alias("right"))
    return pick(i, 0).unionByName(pick(j, 1))


def sketch_links(nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes which share a bucket and have sketches within the limit."""
    rows = nodes.select("digest", F.explode("bands").alias("bucket"))
    # a bucket's members are told by their number and two sums of their hashes: bands with the same members are looked at once
    members = [F.bit_xor(F.xxhash64("digest")).alias("x1"), F.bit_xor(F.xxhash64("digest", F.lit(7))).alias("x2")]
    shared = rows.groupBy("bucket").agg(F.min("digest").alias("centre"), F.count(F.lit(1)).alias("c"), *members).where("c > 1")
    shared = durable(shared.groupBy("centre", "c", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "centre", "c"), "buckets")
    placed = durable(rows.join(shared, "bucket").where("digest <> centre"), "placed")
    sketch = nodes.select("digest", "n", "odd")
    ties = placed.select("centre", "digest").distinct().join(sketch, "digest").join(sketch.select(F.col("digest").alias("centre"), F.col("n").alias("cn"), F.col("odd").alias("codd")), "centre")
    first = durable(ties.where(_close(F.col("n"), F.col("cn"), F.col("odd"), F.col("codd"), percent)).select(F.col("centre").alias("a"), F.col("digest").alias("b")), "stars")

    # what the star left over, against the bucket's nodes of its own size or the next
    many = placed.where("c > 2").select("bucket", "centre", "digest")
    rest = durable(many.join(first.select(F.col("a").alias("centre"), F.col("b").alias("digest")), ["centre", "digest"], "left_anti").select("bucket", "digest"), "rest")
    counts = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SKETCHES).alias("lefts")).join(shared.select("bucket", F.ceil(F.col("c") / BLOCK_SKETCHES).alias("rights")), "bucket")
    # sizes of a pair differ by a quarter at most, so by one step of a scale of 1.3 at most
    scale = F.floor(F.log("n") / float(np.log(1.3))).cast("int")
    left = rest.join(counts, "bucket").join(sketch, "digest").withColumn("scale", scale)
    right = many.select("bucket", "digest").join(counts, "bucket").join(sketch, "digest").withColumn("scale", F.explode(F.array(scale - 1, scale, scale + 1)))
    columns = ["digest", "n", "odd"]
    kinds = "a binary, b binary"
    second = by_group(_deal(left, right, ["bucket", "scale"], columns), ["bucket", "scale", "i", "j"], kinds, _links(0, percent))
    out = durable(first.unionByName(second), "sketch-links")
    discard(shared, placed, first, rest)
    return out


def text_links(members: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join all members of each family which links join; ``members`` has family, digest, n, odd, least and whole."""
    needs = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("family").agg(needs.alias("blocks"))
    wanted = members.join(sizes, "family")
    # always one shuffle of the texts: a small input must not plan otherwise than a large one; rows that repeat are one
    rows = docs.select(F.col(id_col).alias("least"), _whole(F.col(text_col)).alias("whole"), F.col(text_col).alias("body"))
    rows = rows.join(wanted.hint("merge"), ["least", "whole"]).groupBy("least", "whole").agg(*[F.first(c).alias(c) for c in ("family", "blocks", "digest", "n", "odd", "body")])
    texts = durable(rows.select("family", "blocks", "digest", "n", "odd", "body"), "family-texts")
    kinds = "a binary, b binary"
    links = by_group(texts.where("blocks = 1").drop("blocks"), ["family"], kinds, _parts(width, percent))
    large = texts.where("blocks > 1")
    if not sizes.where("blocks > 1").isEmpty():
        columns = ["digest", "n", "odd", "body"]
        one = F.lit(1)
        hub = large.where("digest = family").withColumns({"lefts": one, "rights": F.col("blocks")})
        spokes = large.where("digest <> family").withColumns({"lefts": one, "rights": F.col("blocks")})
        star = durable(by_group(_deal(hub, spokes, ["family"], columns), ["family", "i", "j"], kinds, _links(width, percent)), "text-stars")
        rest = durable(large.where("digest <> family").join(star.select(F.col("b").alias("digest")), "digest", "left_anti").select("family", "digest", "n"), "text-rest")
        left = rest.groupBy("family").agg(needs.alias("lefts"))
        counted = large.withColumn("rights", F.col("blocks")).join(left, "family")
        others = by_group(_deal(counted.join(rest.select("digest"), "digest", "left_semi"), counted.where("digest <> family"), ["family"], columns), ["family", "i", "j"], kinds, _links(width, percent))
        links = links.unionByName(star).unionByName(others)
    out = durable(links, "links")
    discard(texts)
    return out


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked whose sets of distinct ``width``-word shingles (A-Z
    lower-cased) have 100 * intersection >= ``percent`` * union; a component's
    id is its smallest document id.  ``percent`` may be 80 or more: the bands
    and the sketch limit are set for 0.8.  A text with fewer words is one
    shingle; null, empty and blank texts have none and stay alone.  Rows that
    share an id count as one document, whatever their texts; a null id links no texts, takes the
    component of its equal texts (null if none has an id) and is kept where
    that is null.  Other columns are not read; an empty table gives no rows."""
    if not 80 <= percent <= 100:
        raise ValueError("the bands are set for similarities of 80 to 100 percent")
    drawn = durable(sketches(docs, width, id_col, text_col), "sketches")
    full = drawn.where("n > 0 and id is not null")
    of = F.min(F.struct("id", "whole")).alias("of")
    nodes = full.groupBy("digest").agg(of, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    nodes = durable(nodes.select("digest", F.col("of.id").alias("least"), F.col("of.whole").alias("whole"), "n", "bands", "odd"), "nodes")

    near = sketch_links(nodes, percent)
    families = components(near)
    discard(near)
    members = durable(families.select(F.col("node").alias("digest"), F.col("component").alias("family")).join(nodes.drop("bands"), "digest"), "families")
    links = text_links(members, docs, width, percent, id_col, text_col)
    discard(members)
    # texts under one id are one document
    repeated = full.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("top")).where("a <> top").select("id", "a")
    links = links.unionByName(full.join(repeated, "id").where("digest <> a").select("a", F.col("digest").alias("b")))
    parts = components(links).withColumnRenamed("node", "digest")
    homes = nodes.select("digest", "least").join(parts, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    homes = durable(homes, "homes")
    ids = homes.groupBy("component").agg(F.min("least").alias("component_id"))
    home = homes.join(ids, "component").select("digest", "component_id")
    out = drawn.select("id", "n", "digest").join(home, "digest", "left")
    alone = F.when(F.col("n") == 0, F.col("id"))
    out = out.withColumn("component_id", F.coalesce("component_id", alone))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group.
    Edge cases as in :func:`near_groups`; rows that repeat an id stay or go together."""
    key = fresh("__gone", docs.columns)
    gone = durable(near_groups(docs, width, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias(key)).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col(key), "left_anti")
