"""Quality rules from a suffix array: how much of a text repeats itself.

Each block of texts gets one suffix array over words, by prefix doubling that
only carries the suffixes which are not yet told apart.  Words are told apart
by their bytes, and suffixes of different texts by the text.  The longest
common prefix of neighbouring suffixes comes from one descent through the
ranks of the doubling steps or, for a text of very many words, from one walk
along the text that keeps no ranks, so memory stays a small multiple of the
text.  A suffix's longest repeat is the larger prefix shared with its two
neighbours; the union of those spans of at least ``min_span`` words is what
all maximal repeated substrings cover.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bounded_batches
from .words import _SPACE, blocks, codes, paired, runs, word_bounds

#: Blocks of more words keep no ranks of doubling steps.
KEEP_RANKS = 1 << 19


@dataclass(frozen=True)
class RepetitionRules:
    """A text is rejected if its repeats of ``min_span`` words or more cover
    more than ``max_covered`` of its words, or if one repeat is longer than
    ``max_repeat`` words.  What such repeats cover also lies in repeated
    three-word windows, so a share at or above the limit that those have (a half
    in the base rules) would never act."""

    min_span: int = 8
    max_covered: float = 0.2
    max_repeat: int = 64


def _ranks(keys: np.ndarray, stop: np.ndarray, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of each suffix among all, and the ranks by the first 1, 2, 4... words if they are to be kept."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order[1:]] != keys[order[:-1]]]
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = at[np.cumsum(new) - 1]
    sizes = np.diff(np.r_[at, n])
    single = np.zeros(n + 1, bool)
    single[at[sizes == 1]] = True
    levels, k = [rank.copy()] if keep else [], 1
    active = np.flatnonzero(~single[rank])
    while len(active):
        ahead = active + k
        second = np.where(ahead < stop[active], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        i, r1, r2 = active[by], rank[active][by], second[by]
        g = np.r_[True, r1[1:] != r1[:-1]]
        sub = np.r_[True, g[1:] | (r2[1:] != r2[:-1])]
        pos = np.arange(len(i))
        group_at = pos[g][np.cumsum(g) - 1]
        sub_at = pos[sub][np.cumsum(sub) - 1]
        rank[i] = r1 + (sub_at - group_at)
        count = np.diff(np.r_[pos[sub], len(i)])
        alone = count[np.cumsum(sub) - 1] == 1
        active = np.sort(i[~alone])
        if keep:
            levels.append(rank.copy())
        k *= 2
    return rank, levels


def _by_descent(suffix: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The prefix that each suffix shares with the one before it in order, from the kept ranks."""
    n = len(suffix)
    x, y = suffix[:-1].copy(), suffix[1:].copy()
    where = np.flatnonzero(levels[0][x] == levels[0][y])
    x, y, lcp = x[where], y[where], np.zeros(len(where), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        level = levels[t]
        inside = (x < n) & (y < n)
        equal = np.zeros(len(x), bool)
        equal[inside] = level[x[inside]] == level[y[inside]]
        step = np.where(equal, 1 << t, 0)
        lcp += step
        x += step
        y += step
    shared = np.zeros(n + 1, np.int64)
    shared[where + 1] = lcp
    return shared


def _by_walk(suffix: np.ndarray, keys: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The same, by walking along the text: the shared prefix of the next word's suffix is at most one word shorter."""
    n = len(suffix)
    before = np.full(n, -1, np.int64)
    before[suffix[1:]] = suffix[:-1]
    key, end, prev, out = (array("q", a.astype(np.int64).tobytes()) for a in (keys, stop, before, np.zeros(n, np.int64)))
    h = 0
    for i in range(n):
        j = prev[i]
        if j < 0:
            h = 0
            continue
        most = min(end[i] - i, end[j] - j)
        while h < most and key[i + h] == key[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    shared = np.zeros(n + 1, np.int64)
    shared[:-1] = np.frombuffer(out, np.int64)[suffix]
    return shared


def longest_repeats(keys: np.ndarray, stop: np.ndarray, keep_ranks: int = KEEP_RANKS) -> np.ndarray:
    """For each word the length of the longest run from there that also starts
    elsewhere in its text.  ``keys`` tells texts apart; ``stop`` is the word after the text."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    rank, levels = _ranks(keys, stop, n <= keep_ranks)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    shared = _by_descent(suffix, levels) if levels else _by_walk(suffix, keys, stop)
    out = np.empty(n, np.int64)
    out[suffix] = np.maximum(shared[:-1], shared[1:])
    return out


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[first[1:]] - total[first[:-1]]


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key is there twice or more, and whether an equal one came before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]] if len(keys) else np.zeros(0, bool)
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    later[order[1:]] = same
    return many, later


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray, rules: RepetitionRules, keep_ranks: int = KEEP_RANKS) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    starts, ends, first = word_bounds(data, offs)
    code, _ = codes(data, starts, ends, lower=False)
    n, n_words = len(code), np.diff(first)
    text = np.repeat(np.arange(len(offs) - 1), n_words)
    point = (data & 0xC0) != 0x80
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    # lines: runs between line feeds
    feed = np.flatnonzero(data == 10)
    line_at = np.unique(np.r_[offs[:-1], feed + 1])
    line_at = line_at[line_at < len(data)]
    line_end = np.r_[line_at[1:], len(data)].astype(np.int64)
    line_end -= (line_end > line_at) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else 0
    owner = np.searchsorted(offs, line_at, "right") - 1
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_at)
    line_at, line_end, owner = line_at[wordy], line_end[wordy], owner[wordy]
    _, again = _twice(paired(owner, codes(data, line_at, line_end, lower=False)[0]))
    dup_lines = np.bincount(owner[again], minlength=len(offs) - 1)
    # three-word windows
    own = paired(text, code)  # equal words of one text
    stop = np.repeat(first[1:], n_words)
    at = np.flatnonzero(np.arange(n) + 3 <= stop)
    many, _ = _twice(runs(own, 3)[at])
    repeat = _covered(n, at[many], np.full(int(many.sum()), 3))
    longest = longest_repeats(own, stop, keep_ranks)
    far = np.flatnonzero(longest >= rules.min_span)
    covered = _covered(n, far, longest[far])
    most = np.zeros(len(offs) - 1, np.int64)
    np.maximum.at(most, text, longest)
    return {
        "n_words": n_words,
        "word_chars": _per_text(point & ~_SPACE[data], offs),
        "n_symbols": _per_text(symbol, offs),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _per_text(repeat, first),
        "covered_words": _per_text(covered, first),
        "longest_repeat": most,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition_counts(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts of each text and the verdict ``repetitive``.

    One narrow pass without a shuffle: texts are independent.  A null or empty
    text has no words and is not repetitive.  Repeated rows and null ids give
    a row each; other columns are not read.  The base rules' counts come along:
    code points in words, symbols, repeated lines and words in three-word
    windows that the text has twice or more."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(data, offs, rules) for _, _, data, offs in blocks(batch.column(1))]
            got = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS}
            bad = (got["covered_words"] > rules.max_covered * got["n_words"]) | (got["longest_repeat"] > rules.max_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k].astype(np.int64)) for k in COUNTS), pa.array(bad)], names=[id_col, *COUNTS, "repetitive"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{k} long" for k in COUNTS) + ", repetitive boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
