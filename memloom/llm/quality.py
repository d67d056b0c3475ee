"""Quality scores by naive Bayes support vectors.

The features are indicators of n-grams in two views of a text: its words
(one and two) and the words' shapes (one to three).  A shape is the kind of a
word's first two and last two characters, whether the word repeats the one
before, and whether the text has its three-word window more than once.
Indicators are scaled by the log ratio of their smoothed counts in the two
classes, rows brought to unit length, and a linear model with hinge loss is
fitted by dual coordinate descent, then moved towards its mean weight."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import collect_features, distinct, indexed, labelled_sample, platt, scored, sigmoid
from .words import codes, mix, paired, runs, strong, word_bounds

_U = np.uint64
_KIND = np.full(256, 12, np.uint64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"#", b"*", b"$", b"%", b"&", b"|", b".,;:?", bytes(range(128, 256)))):
    _KIND[list(_chars)] = _k


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, offs)
    n = len(starts)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    if not n:
        return text, np.zeros(0, _U)
    code, words = codes(data, starts, ends)
    word = strong(words)[code]
    own = paired(text, code)  # equal words of one text
    same = np.zeros(n, bool)
    same[1:] = own[1:] == own[:-1]
    window = np.full(n, -1, np.int64)
    window[2:] = runs(own, 3)
    order = np.argsort(window, kind="stable")
    equal = window[order[1:]] == window[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    again[:2] = False
    k = _KIND[data[starts]]
    for shift, at in ((4, np.minimum(starts + 1, ends - 1)), (8, ends - 1), (12, np.maximum(ends - 2, starts))):
        k = k | _KIND[data[at]] << _U(shift)
    shape = mix(k | same.astype(_U) << _U(16) | again.astype(_U) << _U(17) | _U(1 << 20))
    texts, keys = [text, text], [word, shape]
    two = text[1:] == text[:-1]
    word2, shape2 = mix(word[1:] * _U(5) + word[:-1]), mix(shape[1:] * _U(5) + shape[:-1])
    texts += [text[1:][two], text[1:][two]]
    keys += [word2[two], shape2[two]]
    three = text[2:] == text[:-2]
    texts.append(text[2:][three])
    keys.append(mix(shape[2:] * _U(7) + shape2[:-1])[three])
    return distinct(np.concatenate(texts), np.concatenate(keys))


def dual_coordinate_descent(at: np.ndarray, column: np.ndarray, value: np.ndarray, sign: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of min ||w||^2 / 2 + sum cost * max(0, 1 - sign * w.x), a dual variable at a time in shuffled order."""
    w, alpha = np.zeros(size), np.zeros(len(sign))
    square = np.add.reduceat(np.r_[value**2, 0.0], at[:-1]) * (at[1:] > at[:-1])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(sign)).tolist():
            if not square[i]:
                continue
            c, v = column[at[i] : at[i + 1]], value[at[i] : at[i + 1]]
            slope = sign[i] * (w[c] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[c] += (new - alpha[i]) * sign[i] * v
                worst = max(worst, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


class Model:
    """Weights over scaled indicators and the slope and offset of the probability."""

    def __init__(self, names: np.ndarray, ratio: np.ndarray, weight: np.ndarray, slope: float, offset: float):
        self.names, self.ratio, self.weight, self.slope, self.offset = names, ratio, weight, slope, offset

    def margin(self, text: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[column]
        norm = np.sqrt(np.bincount(text, r * r, n))
        return np.bincount(text, self.weight[column] * r, n) / np.maximum(norm, 1e-12)

    def __call__(self, text: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.slope * self.margin(text, column, n) + self.offset)


def constant(y: np.ndarray) -> Model:
    """For a sample of one class (or none): its label's score, or one half."""
    offset = 0.0 if not len(y) else 500.0 if y.all() else -500.0
    return Model(np.zeros(0, _U), np.zeros(0), np.zeros(0), 1.0, offset)


def fit(sample, least: int = 3, cost: float = 1.0, towards_mean: float = 0.75) -> Model:
    y = sample.y
    if len(set(y.tolist())) < 2:
        return constant(y)
    names, at, column = indexed(sample, least)
    row = np.repeat(np.arange(len(y)), np.diff(at))
    size = len(names)
    if not size:
        return constant(np.zeros(0))
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    costs = cost * 0.5 / share

    def learnt(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios and weights from these rows alone."""
        of = mine[row]
        p = 1.0 + np.bincount(column[of & (y[row] == 1)], minlength=size)
        q = 1.0 + np.bincount(column[of & (y[row] == 0)], minlength=size)
        # each class's counts as shares of its texts, so that long texts of one class do not tilt all ratios
        ratio = np.log(p / ((mine & (y == 1)).sum() + 2)) - np.log(q / ((mine & (y == 0)).sum() + 2))
        value = ratio[column] / np.maximum(np.sqrt(np.bincount(row, ratio[column] ** 2, len(y))), 1e-12)[row]
        rows = np.flatnonzero(mine)
        at2 = np.r_[0, np.cumsum(np.diff(at)[rows])]
        w = dual_coordinate_descent(at2, column[of], value[of], sign[rows], costs[rows], size)
        return ratio, (1 - towards_mean) * np.abs(w).mean() + towards_mean * w

    # margins of rows that neither ratios nor weights have seen set the probability's slope
    held = np.arange(len(y)) % 5 == 0
    ratio, part = learnt(~held)
    margin = Model(names, ratio, part, 1.0, 0.0).margin(row, column, len(y))
    slope, offset = platt(margin[held], y[held]) if 0 < y[held].mean() < 1 else (4.0, 0.0)
    return Model(names, *learnt(np.ones(len(y), bool)), slope, offset)


def quality_scores(docs: DataFrame, labels: DataFrame, may_learn: Column, rows_per_class: int = 2500, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1, higher: class 1 likelier) and ``predicted`` for every row.

    The model learns from at most ``rows_per_class`` whole labelled texts of
    each class for which ``may_learn`` holds.  Null and empty texts have no
    features and get the score of a margin of 0.  Without labels every score
    is 0.5, with one class 1 or 0.  Repeated rows are scored alike, null ids
    too; other columns are not read; an empty table gives no rows."""
    model = fit(collect_features(labelled_sample(docs, labels, label, may_learn, rows_per_class, id_col, text_col), features))
    out = scored(docs, features, model, model.names, id_col, text_col)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
