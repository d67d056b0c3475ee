"""Toxicity scores by a counterfactually regularised linear classifier.

Features are the distinct words of a text, without case and punctuation, and
the beginnings of longer words, which carry over to forms that the sample
lacks.  Every sentence of a labelled text that names a group is written once
more with the term swapped for others of its set, features are made of both,
and the squared change of the score is part of the loss beside the logistic
loss of the texts and an L1 penalty: a model cannot lower the first by holding
a group's name against a text.  A few neutral sentences take part for every
term, so that terms which the sample lacks are tied as well."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Changes, Sample, collect_features, distinct, indexed, kept_rows, labelled_sample, lookup, merged, platt, scored, sigmoid
from .words import blocks, codes, mix, strong, word_bounds

_U = np.uint64

#: Terms of one line stand for each other in swapped sentences.
IDENTITY_SETS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("american", "german", "french", "spanish", "chinese", "indian", "mexican", "russian", "arab", "turkish"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "inländer"),
    ("schwule", "lesben", "heteros"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
#: Sentences that say nothing about those they name.
NEUTRAL = ("{}", "many {} live in this town", "i spoke to some {} today")
#: Features that join the stepped ones at a time.
JOIN = 300
#: Others of its set that a term is swapped for in one sentence.
OTHERS = 2

_SET_OF = {t: k for k, terms in enumerate(IDENTITY_SETS) for t in terms}
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SENTENCE = re.compile(r"[^.!?\n]+")

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Beginnings of so many bytes count as features of a word that is longer.
BEGINNINGS = (4, 5, 7)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, offs, _APART)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    # a text's distinct words, and what each distinct word of the block has for features
    code, words = codes(data, starts, ends)
    text, code = distinct(text, code)
    size = np.diff(np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]) if len(words) else np.zeros(0, np.int64)
    body = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.zeros(0, np.uint8)
    at = np.cumsum(size) - size
    texts, keys = [text], [strong(words)[code]]
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        part, names = codes(body, at[long], at[long] + n, lower=False)
        key = np.zeros(len(size), _U)
        key[long] = mix(strong(names)[part] + _U(n))
        here = size[code] > n
        texts.append(text[here])
        keys.append(key[code[here]])
    return distinct(np.concatenate(texts), np.concatenate(keys))


def of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of a list of texts, by text."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for a, _, data, offs in blocks(pa.array(texts, pa.large_string())):
        row, key = features(data, offs)
        rows.append(row + a)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def word_keys(word: str) -> list[int]:
    return of_texts([word])[1].tolist()


def swapped(text: str) -> list[tuple[str, str]]:
    """(sentence, the same with a term swapped), A-Z lower-cased, for every sentence of a text that names
    a group, every term in it and ``OTHERS`` others of the term's set, the next ones after it."""
    out: list[tuple[str, str]] = []
    low = text.translate(_LOWER)
    if _SET_OF.keys().isdisjoint(_WORD.findall(low)):
        return out
    for m in _SENTENCE.finditer(low):
        s = m.group()
        for term in sorted(_SET_OF.keys() & set(_WORD.findall(s))):
            terms = IDENTITY_SETS[_SET_OF[term]]
            k = terms.index(term)
            for d in range(1, min(OTHERS, len(terms) - 1) + 1):
                other = terms[(k + d) % len(terms)]
                out.append((s, _WORD.sub(lambda f: other if f.group() == term else f.group(), s)))
    return out


def changes_of(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, feature and sign of what the second text of each pair has more (1) or less (-1) than the first."""
    row, key = of_texts([s for p in pairs for s in p])
    pair, sign = row // 2, np.where(row % 2, 1, -1)
    order = np.lexsort((key, pair))
    pair, key, sign = pair[order], key[order], sign[order]
    # a feature of both is there twice in a row
    same = (pair[1:] == pair[:-1]) & (key[1:] == key[:-1]) if len(pair) else np.zeros(0, bool)
    alone = np.ones(len(pair), bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return pair[alone], key[alone], sign[alone]


def swaps(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, change, feature and sign for the swapped sentences of a column of texts."""
    pairs, owner, number = [], [], []
    for k, text in enumerate(column.to_pylist()):
        found = swapped(text or "")
        pairs += found
        owner += [k] * len(found)
        number += range(len(found))
    pair, key, sign = changes_of(pairs)
    return np.array(owner, np.int64)[pair], np.array(number, np.int64)[pair], key, sign


def neutral() -> list[tuple[str, str]]:
    """Each neutral sentence with every two terms of a set."""
    return [(s.format(a), s.format(b)) for terms in IDENTITY_SETS for k, a in enumerate(terms) for b in terms[k + 1 :] for s in NEUTRAL]


class Model:
    def __init__(self, names: np.ndarray, weight: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        kept = weight != 0
        self.names, self.weight, self.bias, self.slope, self.offset = names[kept], weight[kept], bias, slope, offset

    def margin(self, text: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(text, self.weight[column], n) + self.bias

    def __call__(self, text: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.slope * self.margin(text, column, n) + self.offset)


@dataclass
class Problem:
    """The smooth part of the loss over ``size`` features: weighted logistic loss of the texts, and ``force`` times
    the squared score change of each swap."""

    size: int
    row: np.ndarray
    column: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    swap: np.ndarray
    part: np.ndarray
    sign: np.ndarray
    force: np.ndarray

    def only(self, used: np.ndarray) -> Problem:
        """The problem over the features ``used``; the others' weights are 0."""
        place = np.cumsum(used) - 1
        a, b = used[self.column], used[self.part]
        return Problem(int(used.sum()), self.row[a], place[self.column[a]], self.y, self.weight, self.swap[b], place[self.part[b]], self.sign[b], self.force)

    def loss(self, w: np.ndarray, b: float) -> float:
        margin = np.bincount(self.row, w[self.column], len(self.y)) + b
        change = np.bincount(self.swap, self.sign * w[self.part], len(self.force))
        return float((self.weight * (np.logaddexp(0, margin) - self.y * margin)).sum() + (self.force * change**2).sum())

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = self.weight * (sigmoid(np.bincount(self.row, w[self.column], len(self.y)) + b) - self.y)
        change = 2 * self.force * np.bincount(self.swap, self.sign * w[self.part], len(self.force))
        return np.bincount(self.column, p[self.row], self.size) + np.bincount(self.part, self.sign * change[self.swap], self.size), float(p.sum())

    def curvature(self) -> tuple[np.ndarray, float]:
        """A bound for each weight alone that holds for all moved at once, and the bias's."""
        load = np.bincount(self.row, minlength=len(self.y)) + 1.0
        entries = np.bincount(self.swap, minlength=len(self.force))
        own = np.bincount(self.column, 0.25 * (self.weight * load)[self.row], self.size) + np.bincount(self.part, 2 * (self.force * entries)[self.swap], self.size)
        return np.maximum(own, 1e-12), 0.25 * float((self.weight * load).sum())

    def solved(self, l1: float, rounds: int, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient steps from (w, b), started anew where the loss's slope turns against them."""
        curve, bias_curve = self.curvature()
        w0, b0, t = w, b, 1.0
        for _ in range(rounds):
            t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            u, c = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
            g, gb = self.gradient(u, c)
            step = u - g / curve
            w0, b0 = w, b
            w = np.sign(step) * np.maximum(np.abs(step) - l1 / curve, 0)
            b = c - gb / bias_curve
            t = 1.0 if ((u - w) * curve) @ (w - w0) + (c - b) * bias_curve * (b - b0) > 0 else t1
            # a step's length in slopes: when it is far below the penalty, all have settled
            if max(np.abs((u - w) * curve).max(initial=0.0), abs(c - b) * bias_curve) < 1e-2 * l1:
                break
        return w, b


def problem(sample: Sample, names: np.ndarray, row: np.ndarray, column: np.ndarray, mine: np.ndarray, counterfactual: float) -> Problem:
    """Over the texts ``mine``, the classes weighing alike, and all swapped sentences."""
    y = sample.y
    weight = np.where(y == 1, 0.5 / max(1, (mine & (y == 1)).sum()), 0.5 / max(1, (mine & (y == 0)).sum())) * mine
    pair, key, sign = changes_of(neutral())
    apart, own = merged(pair, key, sign), sample.changes or Changes(*[np.zeros(0, np.int64)] * 2, np.zeros(0), np.zeros(0))
    swap = np.r_[apart.row, own.row + len(apart.times)]
    key, sign = np.r_[apart.key.astype(_U), own.key.astype(_U)], np.r_[apart.sign, own.sign]
    entry, part = lookup(names, np.arange(len(key)), key)
    force = counterfactual * np.r_[apart.times, own.times] / max(1, len(y))
    return Problem(len(names), row, column, y, weight, swap[entry].astype(np.int64), part, sign[entry], force)


def fit(sample: Sample, least: int = 4, l1: float = 4e-4, counterfactual: float = 1.0, rounds: int = 400) -> Model:
    """Weights over all features of ``least`` texts or more.

    L1 leaves most at 0, so only those that cannot stay there are stepped: the
    steepest join, until none of all the others has to, which makes the result
    that of all.  A fifth of the texts is left out once to
    set the probability's slope."""
    y = sample.y
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, _U), np.zeros(0), 0.0 if not len(y) else 500.0 if y.all() else -500.0)
    names, at, column = indexed(sample, least)
    row = np.repeat(np.arange(len(y)), np.diff(at))

    def learnt(mine: np.ndarray) -> tuple[np.ndarray, float]:
        whole = problem(sample, names, row, column, mine, counterfactual)
        w, b = np.zeros(len(names)), 0.0
        used = np.zeros(len(names), bool)
        while True:
            slope = np.abs(whole.gradient(w, b)[0]) * ~used
            join = np.argsort(-slope, kind="stable")[:JOIN]
            join = join[slope[join] > 1.01 * l1]
            if not len(join):
                return w, b
            used[join] = True
            w[used], b = whole.only(used).solved(l1, rounds, w[used], b)

    held = np.arange(len(y)) % 5 == 0
    slope, offset = 1.0, 0.0
    if 0 < y[held].mean() < 1 and 0 < y[~held].mean() < 1:
        w, b = learnt(~held)
        slope, offset = platt((np.bincount(row, w[column], len(y)) + b)[held], y[held], balance=0.5)
    return Model(names, *learnt(np.ones(len(y), bool)), slope, offset)


def learn(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, rows_per_class: int, id_col: str, text_col: str) -> Model:
    return fit(collect_features(labelled_sample(docs, labels, label, may_learn, rows_per_class, id_col, text_col), features, swaps))


def toxicity_scores(docs: DataFrame, labels: DataFrame, may_learn: Column, rows_per_class: int = 2500, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` for every row.

    The model learns from at most ``rows_per_class`` whole labelled texts of
    each class (and ``SAMPLE_BYTES`` of them) for which ``may_learn`` holds.  Null and empty texts have no
    words and get the model's bias, which calls them clean.  Without labels
    every score is 0.5, with one class 1 or 0.  Repeated rows are scored
    alike, null ids too; other columns are not read; an empty table gives no rows."""
    model = learn(docs, labels, label, may_learn, rows_per_class, id_col, text_col)
    out = scored(docs, features, model, model.names, id_col, text_col)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2500, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with all their columns.
    Edge cases as in :func:`toxicity_scores`; without labels all rows stay."""
    model = learn(docs, labels, label, F.lit(True), rows_per_class, id_col, text_col)
    return kept_rows(docs, features, model, model.names, 0.5 if len(model.names) or model.bias else 2.0, text_col)
