"""Personal data: fixed patterns, and a character tagger that adds to them.

The tagger is a bidirectional LSTM over characters with CRF transitions,
trained in numpy on sentences whose spans are known because they were put
there: addresses, network numbers, cards, phones and secrets, in the forms
that the patterns know and in others (spelt-out addresses, grouped digits,
keys and tokens), among words, versions, dates and prices that are none.

Every character of every text is tagged.  The network runs over windows of
``LONG`` characters that overlap by twice ``MARGIN``; within them windows of the
length it was trained on are decoded, every character takes the tag of the window
in which it is most central, and spans are put together over the whole text.
Characters whose tag is "outside" for certain, by a bound on what any span over them
could gain, are not decoded further, nor are stretches in which whatever the tags are
no span could be accepted.  ``onnxruntime`` runs the network where it is installed,
and numpy elsewhere."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import recurrent
from .shared import bounded_batches

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind
WINDOW, STEP = 128, 64
LONG, MARGIN = 512, 32
HIDDEN = 20
BEFORE = 130  # stands before the first character and leaves the states at 0

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match never starts inside a run of digits, so a long run is not tried again from each digit
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
BEGINNINGS = ("AKIA", "ASIA", "ghp_", "sk-")
_SAYS = (b"pass", b"pwd", b"token", b"secret", b"key", b"bearer")
_AT = re.compile(r"(?i)(?:(?<=[^\w\s])|(?<=[^\w\s] ))at ?[^\w\s]|at [\w-]+(?: ?[^\w\s]? ?dot|\.[\w-])")
_KEYWORD = re.compile(r"(?i)(pass(word|wd|phrase)?|pwd|token|secret|key|bearer)[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each at sign back over the local part, then the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- the tagger -----------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """1 to 128 for ASCII, 129 for all else; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 128).astype(np.uint8) + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def with_before(table: np.ndarray) -> np.ndarray:
    """What each character adds to the gates, and in a last row for ``BEFORE`` nothing."""
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


class Tagger:
    """Weights of both directions, the output layer and the CRF."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        init = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.w = {}
        for side in "fb":
            self.w |= {f"x{side}": init(130, 4 * h), f"u{side}": init(h, 4 * h), f"c{side}": np.zeros(4 * h, np.float32)}
            self.w[f"c{side}"][h : 2 * h] = 1.0
        self.w |= {"o": init(2 * h, TAGS), "oc": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}

    def _direction(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states of windows x (windows, characters), from left to right."""
        table, u, h = self.w[f"x{side}"] + self.w[f"c{side}"], self.w[f"u{side}"], HIDDEN
        n, t = x.shape
        out = np.zeros((t, n, h), np.float32)
        now, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for k in range(t):
            z = table[x[:, k]] + now @ u
            gate = _sigmoid(z[:, : 3 * h])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            bent = np.tanh(cell)
            if keep is not None:
                keep.append((now, before, i, f, o, g, bent))
            now = o * bent
            out[k] = now
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(characters, windows, tags)"""
        f = self._direction(x, "f", keep.setdefault("f", []) if keep is not None else None)
        b = self._direction(x[:, ::-1], "b", keep.setdefault("b", []) if keep is not None else None)[::-1]
        both = np.concatenate([f, b], axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.w["o"] + self.w["oc"]

    def _states(self, x: np.ndarray, side: str) -> np.ndarray:
        """As :meth:`_direction` with nothing kept: all gates bend in one go."""
        h = HIDDEN
        n, t = x.shape
        # a tanh is a sigmoid of twice its argument, twice and less one; numpy's exp is several times faster than its tanh
        scale = -np.repeat(np.array([1.0, 2.0], np.float32), [3 * h, h])
        table, u = with_before(self.w[f"x{side}"] + self.w[f"c{side}"]) * scale, self.w[f"u{side}"] * scale
        out = np.empty((t, n, h), np.float32)
        now, cell, bent = (np.zeros((n, h), np.float32) for _ in range(3))
        z, moved = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        steps = np.ascontiguousarray(x.T).astype(np.intp)
        for k in range(t):
            np.take(table, steps[k], axis=0, out=z, mode="clip")
            np.matmul(now, u, out=moved)
            z += moved
            np.minimum(z, 80, out=z)
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            cell *= z[:, h : 2 * h]
            np.multiply(z[:, :h], 2 * z[:, 3 * h :] - 1, out=bent)
            cell += bent
            np.multiply(cell, -2, out=bent)
            np.minimum(bent, 80, out=bent)
            np.exp(bent, out=bent)
            bent += 1
            np.divide(2, bent, out=bent)
            bent -= 1
            now = out[k]
            np.multiply(z[:, 2 * h : 3 * h], bent, out=now)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """What :meth:`emissions` gives, (characters, windows, tags)."""
        o, h = self.w["o"], HIDDEN
        return self._states(x, "f") @ o[:h] + self._states(x[:, ::-1], "b")[::-1] @ o[h:] + self.w["oc"]

    def may_hold(self, e: np.ndarray) -> np.ndarray:
        """Windows in which some span might beat no span at all."""
        return self._hot(np.ascontiguousarray(e.transpose(0, 2, 1))).any(axis=0)

    def _hot(self, e: np.ndarray) -> np.ndarray:
        """Where some span might beat no span at all, (characters, windows), by scores (characters, tags, windows): the best
        run over a character by what its characters would gain at most, with the most that its ends can gain.  A run
        ends before a character that is outside whatever the tags beside it are."""
        trans = self.w["trans"]
        gain = trans - trans[0, 0]
        # the most that a tag in place of "outside" can gain by the ways to it and from it
        ways = np.maximum(gain[:, 1:] - gain[:, :1], 0).max(axis=0) + np.maximum(gain[1:] - gain[:1], 0).max(axis=1)
        each = e[:, 1:].max(axis=1)
        most = e[:, 1] + ways[0]
        for k in range(2, TAGS):
            np.maximum(most, e[:, k] + ways[k - 1], out=most)
        each -= e[:, 0]
        each[most - e[:, 0] < -1e-3] = -1e4
        inside = float(gain[1:, 1:].max())
        ends = max(0.0, float(gain[0, 1:].max())) + max(0.0, float(gain[1:, 0].max())) - inside
        each = each + inside
        upto, since = each.copy(), each.copy()
        least = np.empty(each.shape[1], each.dtype)
        for k in range(1, len(each)):
            upto[k] += np.maximum(upto[k - 1], 0, out=least)
            since[-1 - k] += np.maximum(since[-k], 0, out=least)
        upto += since
        upto -= each
        return upto > -1e-3 - ends

    def long_scores(self, pieces: list[np.ndarray]) -> np.ndarray:
        """(characters, tags, windows) of pieces of text of unlike length.  Nothing that is scored with a piece
        changes its scores: what follows its last character is read after it, or leaves the states at 0."""
        h, n = HIDDEN, len(pieces)
        size = np.array([len(p) for p in pieces])
        t = WINDOW + STEP * max(0, -(-(int(size.max()) - WINDOW) // STEP))
        x = np.full((n, t), BEFORE, np.uint8)
        for row, p in enumerate(pieces):
            x[row, : len(p)] = p
        out = self._fused(x) if type(self)._states is Tagger._states else None
        if out is None:
            sides = (self._states(x, "f"), self._states(x[:, ::-1], "b")[::-1])
            out = np.stack([sides[0][k] @ self.w["o"][:h] + sides[1][k] @ self.w["o"][h:] for k in range(t)]).transpose(0, 2, 1) + self.w["oc"][:, None]
        k, row = np.nonzero(x.T == BEFORE)
        out[k, :, row] = np.array([0] + [-1e4] * (TAGS - 1), out.dtype)  # there is nothing but outside
        return out

    def _fused(self, x: np.ndarray) -> np.ndarray | None:
        """The scores by one graph of :mod:`recurrent`, where there is a runtime for it."""
        w, h = self.w, HIDDEN
        weights = {"oc": w["oc"][:, None]}
        for k, side in enumerate("fb"):
            weights |= {f"table_{side}": with_before(w[f"x{side}"] + w[f"c{side}"]), f"u_{side}": w[f"u{side}"], f"o_{side}": np.ascontiguousarray(w["o"][h * k : h * (k + 1)].T)}
        return recurrent.scores(x, weights)

    def tag(self, pieces: list[np.ndarray], tells: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The tags of each piece, by windows of the length trained on.  The best tags of a window are "outside" but in
        stretches that do not touch, so it is enough to decode these; one that lies inside two windows is decoded once.
        With ``tells``, of :func:`telling`, those in which no span can be plausible stay "outside"."""
        e = self.long_scores(pieces)
        if tells is not None:  # all pieces are scored, and those looked at in which there may be such a span
            some = [k for k, p in enumerate(tells) if may_tell(p.sum(dtype=np.int64), len(p))]
            out = [np.zeros(len(p), np.int8) for p in pieces]
            if some:
                for k, tags in zip(some, self._decoded(np.ascontiguousarray(e[:, :, some]), [len(pieces[k]) for k in some], [tells[k] for k in some])):
                    out[k] = tags
            return out
        return self._decoded(e, [len(p) for p in pieces])

    def _decoded(self, e: np.ndarray, sizes: list[int], tells: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The tags of pieces of these sizes by their scores."""
        t, _, n = e.shape
        size, tags = np.array(sizes), np.zeros((n, t), np.int8)
        hot = np.zeros((n, t + 2), bool)
        hot[:, 1:-1] = self._hot(e).T
        row, edge = np.divmod(np.flatnonzero(hot[:, 1:] != hot[:, :-1]), t + 1)
        row, a, b = row[::2], edge[::2], edge[1::2]
        if tells is not None:
            upto = np.zeros((n, t + 1), np.int32)
            for k, p in enumerate(tells):
                np.cumsum(p, out=upto[k, 1 : len(p) + 1])
                upto[k, len(p) + 1 :] = upto[k, len(p)]
            some = may_tell(upto[row, b] - upto[row, a], b - a)
            row, a, b = row[some], a[some], b[some]
        # by each window that gives a character of a stretch its tag: what the window sees of it
        last = np.maximum(-(-(size - STEP) // STEP), 1) - 1
        if not len(row):
            return [tags[k, :m] for k, m in enumerate(sizes)]
        first = np.clip((a - STEP // 2) // STEP, 0, last[row])
        times = np.clip((b - 1 - STEP // 2) // STEP, 0, last[row]) - first + 1
        row, a, b = np.repeat(row, times), np.repeat(a, times), np.repeat(b, times)
        k = np.repeat(first - np.cumsum(times) + times, times) + np.arange(len(row))
        at = k * STEP
        lo = np.maximum(a, np.where(k > 0, at + STEP // 2, 0))
        hi = np.minimum(b, np.where(k < last[row], at + STEP + STEP // 2, size[row]))
        a, b = np.maximum(a, at), np.minimum(b, at + WINDOW)
        # within a window an outside character stands on either side
        begin, end = a - (a > at), b + (b < at + WINDOW)
        key, one, same = np.unique(((row * (t + 2) + begin) * (t + 2) + end) * 4 + (a > at) * 2 + (b < at + WINDOW), return_index=True, return_inverse=True)
        found, where = self._stretches(e, row[one], begin[one], end[one], (key & 2) > 0, (key & 1) > 0)
        long = hi - lo
        step = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        tags.ravel()[np.repeat(row * t + lo, long) + step] = found[np.repeat(where[same] + lo - begin, long) + step]
        return [tags[k, :m] for k, m in enumerate(sizes)]

    def _stretches(self, e: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, led: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of stretches of ``e``, one after another, and where each begins there.  The first
        character of those that are ``led`` and the last of those that are ``closed`` is outside."""
        size, flat, (t, _, n) = end - begin, e.ravel(), e.shape
        where = np.cumsum(size) - size
        found = np.zeros(int(size.sum()), np.int8)
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(order), 512):
            some = order[k : k + 512]
            steps = np.arange(size[some[0]])[:, None]
            spots = np.minimum(begin[some] + steps, t - 1) * (TAGS * n) + row[some]
            part = np.take(flat, spots[:, None] + np.arange(0, TAGS * n, n)[:, None])
            for lanes, place in ((np.flatnonzero(led[some]), 0), (c := np.flatnonzero(closed[some]), size[some][c] - 1)):
                part[place, 0, lanes], part[place, 1:, lanes] = 0, -1e4
            inside = steps < size[some]
            found[(where[some] + steps)[inside]] = self._best_path(part, size[some])[inside]
        return found, where

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window (Viterbi)."""
        e, trans = self.scores(x), self.w["trans"]
        out = np.zeros((e.shape[1], e.shape[0]), np.int8)
        some = np.flatnonzero(self.may_hold(e))
        if len(some):
            out[some] = self.best_path(np.ascontiguousarray(e[:, some]))
        return out

    def best_path(self, e: np.ndarray) -> np.ndarray:
        t, n, _ = e.shape
        tags = np.zeros((n, t), np.int8)
        for lo in range(0, n, 256):
            part = np.ascontiguousarray(e[:, lo : lo + 256].transpose(0, 2, 1))
            tags[lo : lo + 256] = self._best_path(part, np.full(part.shape[2], t)).T
        return tags

    def _best_path(self, part: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best tags, (characters, windows), of windows of unlike size, the longest first; ``part`` is (characters, tags, windows)."""
        trans = self.w["trans"]
        t, _, m = part.shape
        tags = np.empty((t, m), np.int8)
        best, ways = np.empty((t, TAGS, m), part.dtype), np.empty((TAGS, TAGS, m), part.dtype)
        best[0] = part[0]
        for k in range(1, t):
            np.add(best[k - 1][:, None], trans[:, :, None], out=ways)
            np.maximum.reduce(ways, axis=0, out=best[k])
            best[k] += part[k]
        ends = np.searchsorted(-size, -np.arange(t + 1), side="right")  # how many windows have so many characters at least
        now = np.zeros(m, np.intp)
        for k in range(t - 1, -1, -1):  # the way there is looked up for the tag taken alone
            on, there = ends[k + 2] if k + 2 <= t else 0, ends[k + 1]
            if on:
                now[:on] = (best[k][:, :on] + trans[:, now[:on]]).argmax(axis=0)
            if there > on:
                now[on:there] = best[k][:, on:there].argmax(axis=0)
            tags[k] = now
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y, and its gradients."""
        keep: dict = {}
        e, trans, h = self.emissions(x, keep), self.w["trans"], HIDDEN
        t, n, _ = e.shape
        # forward and backward sums as probabilities, scaled at each character
        top = e.max(axis=2, keepdims=True)
        near, step = np.exp(e - top), np.exp(trans)
        alpha, beta, scale = np.empty_like(near), np.ones_like(near), np.empty((t, n, 1), near.dtype)
        for k in range(t):
            a = near[0] if k == 0 else (alpha[k - 1] @ step) * near[k]
            scale[k] = a.sum(axis=1, keepdims=True)
            alpha[k] = a / scale[k]
        for k in range(t - 2, -1, -1):
            beta[k] = (near[k + 1] * beta[k + 1] / scale[k + 1]) @ step.T
        z = (np.log(scale) + top).sum(axis=(0, 2))
        rows = np.arange(n)
        gold = e[np.arange(t)[:, None], rows, y.T].sum(axis=0) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        de = alpha * beta
        ahead = near[1:] * beta[1:] / scale[1:]
        dtrans = step * np.einsum("tni,tnj->ij", alpha[:-1], ahead)
        np.add.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        for k in range(t):
            de[k, rows, y[:, k]] -= 1
        de = (de / n).astype(np.float32)
        grads = {"trans": dtrans / n, "o": np.einsum("tnh,tnk->hk", keep["both"], de), "oc": de.sum(axis=(0, 1))}
        dboth = de @ self.w["o"].T
        for side, xs, dout in (("f", x, dboth[:, :, :h]), ("b", x[:, ::-1], dboth[::-1, :, h:])):
            u = self.w[f"u{side}"]
            dx, du, dc = np.zeros_like(self.w[f"x{side}"]), np.zeros_like(u), np.zeros(4 * h, u.dtype)
            moved = np.empty((t, n, 4 * h), u.dtype)
            dnow, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for k in range(t - 1, -1, -1):
                prev, before, i, f, o, g, bent = keep[side][k]
                dh = dout[k] + dnow
                dcell = dcell + dh * o * (1 - bent * bent)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), dh * bent * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                moved[k] = dz
                du += prev.T @ dz
                dc += dz.sum(axis=0)
                dnow, dcell = dz @ u.T, dcell * f
            order = np.argsort(xs.T.ravel(), kind="stable")
            seen, first = np.unique(xs.T.ravel()[order], return_index=True)
            dx[seen] = np.add.reduceat(moved.reshape(t * n, 4 * h)[order], first)
            grads |= {f"x{side}": dx, f"u{side}": du, f"c{side}": dc}
        return float((z - gold).mean()), grads


# --- labelled sentences ---------------------------------------------------


def _word(r: random.Random) -> str:
    parts = ("the", "an", "er", "on", "ou", "st", "en", "eur", "sch", "ción", "lo", "ve", "ra", "ment", "ü", "é", "ing", "to", "a", "be")
    w = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    if r.random() < 0.1:
        w = w.capitalize()
    return w + r.choice(("", "", "", "", "", ".", ",", "!!", "###", ":", "\n"))


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _mixed(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


_HEX, _UPPER, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _positive(r: random.Random) -> tuple[str, str, str, str]:
    """(kind, text before, span, text after)"""
    kind = r.choice(KINDS)
    name = lambda: re.sub(r"[^a-z]", "", _word(r).lower()) or "joe"
    if kind == "email":
        local = name() + r.choice((".", "_", "", "-")) + r.choice((name(), _number(r, r.randint(1, 3))))
        host = [*(["mail" + _number(r, 1)] if r.random() < 0.4 else []), r.choice(("example", name())), r.choice(("com", "org", "net", "de", "co.uk"))]
        if r.random() < 0.6:
            return kind, "", local + "@" + ".".join(host), ""
        a, d = r.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" [at] ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" at ", " dot ")))
        return kind, "", local + a + d.join(host), ""
    if kind == "ip":
        return kind, "", ".".join(str(r.randint(0, 255)) for _ in range(4)), r.choice(("", "", ":8080", "/24"))
    if kind == "card":
        n, sep = r.choice((13, 15, 16, 16, 16, 19)), r.choice(("", "", " ", "-", "."))
        d = _number(r, n - 1)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return kind, "", sep.join(d[k : k + 4] for k in range(0, n, 4)), ""
    if kind == "phone":
        a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
        cc = str(r.randint(1, 99))
        return kind, "", r.choice((f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{cc} {a} {b}{c}", f"+{cc}{a}{b}{c}", f"tel:{a}.{b}.{c}"[4:])), ""
    which = r.randrange(4)
    if which == 0:
        return kind, "", "AKIA" + _mixed(r, _UPPER, 16), ""
    if which == 1:
        return kind, r.choice(("password=", "passwd: ", "pwd=")), _mixed(r, _HEX, r.randint(12, 20)), ""
    if which == 2:
        q = r.choice(('"', "'"))
        return kind, r.choice(("token = ", "api_key=", "secret: ")) + q, _mixed(r, _HEX, r.choice((32, 40))), q
    return kind, "", r.choice(("sk-", "ghp_")) + _mixed(r, _ALNUM, 36), ""


def _negative(r: random.Random) -> str:
    return r.choice(
        (
            f"{r.randint(1, 9)}.{r.randint(0, 9)}.", f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"v{r.randint(1, 30)}.{r.randint(0, 9)}", str(r.randint(1, 2100)), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            f"{r.randint(0, 23)}:{r.randint(0, 59):02}", f"${r.randint(1, 999)}.{r.randint(0, 99):02}", f"{r.randint(1, 99)}%", f"§ {r.randint(1, 400)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", f"{r.randint(1, 999)},{_number(r, 3)},{_number(r, 3)}", f"@{_word(r).strip('.,!#:')}",
            f"{r.randint(1, 99)}th", f"ISBN 978-{_number(r, 1)}-{_number(r, 3)}", f"#{r.randint(1, 9999)}", f"{r.randint(1, 12)} x {r.randint(1, 12)} = {r.randint(1, 144)}", f"CC BY-NC {r.randint(1, 4)}.0.", f"{_number(r, 5)}", f"{_number(r, 8)}", f"({r.randint(1, 20)})", f"a{_number(r, 2)}b", f"2^{_number(r, 2)}",
        )
    )


def labelled_windows(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``count`` windows of characters and their tags."""
    r = random.Random(seed)
    x, y = np.zeros((count, WINDOW), np.int64), np.zeros((count, WINDOW), np.int64)
    for k in range(count):
        text, tags = "", []
        while len(text) < WINDOW:
            chance = r.random()
            if chance < 0.16:
                kind, before, span, after = _positive(r)
                b = 1 + 2 * KINDS.index(kind)
                text += before + span + after
                tags += [0] * len(before) + [b] + [b + 1] * (len(span) - 1) + [0] * len(after)
            else:
                piece = _negative(r) if chance < 0.3 else _word(r)
                text += piece
                tags += [0] * len(piece)
            gap = r.choice((" ", " ", " ", ", ", "\n", ". "))
            text += gap
            tags += [0] * len(gap)
        cut = r.randint(0, 20) if r.random() < 0.5 else 0  # some windows begin inside a span
        part, tag = text[cut : cut + WINDOW], tags[cut : cut + WINDOW]
        x[k, : len(part)], y[k, : len(tag)] = codes(part), tag
    return x, y


@lru_cache(maxsize=2)
def trained(windows: int = 1920, rounds: int = 7, batch: int = 64, rate: float = 0.018) -> Tagger:
    """A tagger fitted with Adam; the same on every call."""
    model = Tagger()
    x, y = labelled_windows(windows)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(w) for k, w in model.w.items()}
    rng, step, total = np.random.default_rng(3), 0, rounds * (windows // batch)
    for _ in range(rounds):
        order = rng.permutation(windows)
        for a in range(0, windows - batch + 1, batch):
            _, grads = model.gradients(x[order[a : a + batch]], y[order[a : a + batch]])
            step += 1
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            now = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# --- whole texts ----------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches that are tagged: the whole text."""
    return [(0, len(text))] if text else []


def long_windows(length: int) -> list[int]:
    """Starts of the overlapping windows of a text."""
    return list(range(0, max(1, length - 2 * MARGIN), LONG - 2 * MARGIN))


def tag_regions(model: Tagger, parts: list[np.ndarray], tells: list[np.ndarray] | None = None, at_once: int = 512) -> list[np.ndarray]:
    """The tags of each part: every character is tagged, by the window in which it is farthest from an edge.  With
    ``tells``, of :func:`telling`, all plausible spans are as without; others may be left out."""
    where = [(k, a) for k, part in enumerate(parts) for a in long_windows(len(part))]
    where.sort(key=lambda w: min(LONG, len(parts[w[0]]) - w[1]))  # those of like length together: little padding
    sizes = [min(LONG, len(parts[k]) - a) for k, a in where]
    ends = [(int(z[0]), int(z[-1])) if len(z := np.flatnonzero(t)) else (len(t), -1) for t in tells or ()]
    out = [np.zeros(len(p), np.int8) for p in parts]
    hi = 0
    while hi < len(where):
        lo, hi = hi, min(hi + at_once, max(hi + at_once // 4, bisect_right(sizes, sizes[hi] * 5 // 4 + STEP // 4)))
        some = where[lo:hi]
        here = None if tells is None else [tells[k][a : a + LONG].copy() for k, a in some]
        for t, (k, a) in zip(here or (), some):  # a span may go on in the window before or after, and what tells lie there
            if a and ends[k][0] < a + MARGIN:
                t[MARGIN] = _ALONE
            if a + LONG < len(parts[k]) and ends[k][1] >= a + LONG - MARGIN:
                t[LONG - MARGIN - 1] = _ALONE
        for tags, (k, a) in zip(model.tag([parts[k][a : a + LONG] for k, a in some], here), some):
            # the ends of a text are not edges of a window
            x, y = MARGIN if a else 0, len(tags) - (MARGIN if a + LONG < len(parts[k]) else 0)
            out[k][a + x : a + y] = tags[x:y]
    return out


def spans_of(tags: np.ndarray, at: int) -> list[Span]:
    """Spans of a part that starts at ``at``: a begin, or a change of kind, opens one."""
    hot = np.flatnonzero(tags)
    tag = tags[hot]
    kind = (tag - 1) // 2
    opens = np.ones(len(hot), bool)
    opens[1:] = (hot[1:] != hot[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)
    first = np.flatnonzero(opens)
    ends = hot[np.append(first[1:], len(hot)) - 1] + 1 if len(hot) else hot
    return [(KINDS[k], x, y) for k, x, y in zip(kind[first].tolist(), (hot[first] + at).tolist(), (ends + at).tolist())]


def plausible(kind: str, text: str, a: int, b: int) -> bool:
    """What a tagged span must hold at least to be one of its kind, in whatever form it is written."""
    s = text[a:b]
    if kind == "email" and not ("@" in s or "at" in s.lower()):
        return False  # neither form holds
    n = len(_digits(s)) if kind != "email" else 0
    if s != s.strip() or "\n" in s or (a and text[a - 1].isalnum() and s[0].isalnum()) or (b < len(text) and text[b].isalnum() and s[-1].isalnum()):
        return False  # white space at an end, or part of a longer word
    if kind == "email" and not re.search(r"(?i)@|[^\w\s] ?at ?[^\w\s]", s):  # a bare "at" is a word as well: what follows must be one host
        return len(s) >= 8 and bool(re.fullmatch(r"(?i)[\w.%+-]+ at [\w-]+(( ?[^\w\s]? ?dot ?[^\w\s]? ?|\.)[\w-]+)+", s))
    if kind == "email":
        return len(s) >= 8 and bool(re.search(r"(?i)\w ?(@|[^\w\s]at[^\w\s]|\bat\b) ?\w.*(\.|\bdot\b[^\w\s]?) ?\w", s))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= n <= 19 and luhn(_digits(s))
    if kind == "phone":
        return 9 <= n <= 15 and n < len(s)
    if _KEYWORD.search(text[max(0, a - 24) : a]):
        return len(s) >= 8 and not s.isalpha()  # after a word that says so, anything but a word
    return len(s) >= 16 and (n >= 2 or s.startswith(BEGINNINGS))  # digits, or a beginning that says so


_LOWER = np.array([ord(chr(k - 1).lower()) if 0 < k < 129 else 0 for k in range(256)], np.uint8)  # by code
_WORDLY = np.array([chr(k).isalnum() or k == 95 for k in range(128)] + [False] * 128)
_DIGITS, _ALONE = 1, 16


def telling(text: str, points: np.ndarray) -> np.ndarray:
    """What each character contributes to a span's being :func:`plausible`: ``_DIGITS`` a digit, ``_ALONE`` an at sign or
    word, the beginning of a secret, or what follows a word that says there is one; 0 all others.  See :func:`may_tell`."""
    low = _LOWER[points]
    out = ((low - np.uint8(48)) < 10).astype(np.uint8)
    out[low == 64] = _ALONE
    at = np.flatnonzero((low[:-1] == 97) & (low[1:] == 116))
    before, after = low[np.maximum(at - 1, 0)], low[np.minimum(at + 2, len(low) - 1)]
    for k in at[~((_WORDLY[before] & (at > 0)) | (_WORDLY[after] & (at + 2 < len(low))))].tolist():
        if _AT.match(text, k):
            out[k] = _ALONE
    for beginning in BEGINNINGS:
        k = text.find(beginning)
        while k >= 0:
            out[k] = _ALONE
            k = text.find(beginning, k + 1)
    folded = low.tobytes()
    for word in _SAYS:
        k = folded.find(word)
        while k >= 0:
            out[k : k + 18] = _ALONE  # the longest word, and what may stand between it and a secret
            k = folded.find(word, k + 1)
    if "\u017f" in text or "\u212a" in text:
        out[:] = _ALONE  # a long s and a kelvin, which match s and k
    return out


def may_tell(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a stretch of that length whose characters contribute that much in all may hold a plausible span: numbers have
    four digits at least, a secret two and sixteen characters or what stands alone, an address what stands alone."""
    return (total >= 4) | ((total >= 2) & (length >= 16))


def text_spans(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans and those that the tagger adds, apart from each other and from the base."""
    base = [base_spans(t) for t in texts]
    where, parts, tells = [], [], []
    for k, t in enumerate(texts):
        for a, b in regions(t):
            where.append((k, a))
            parts.append(codes(t[a:b]))
            tells.append(telling(t[a:b], parts[-1]))
    added: list[list[Span]] = [[] for _ in texts]
    for (k, a), tags in zip(where, tag_regions(model, parts, tells)):
        t = texts[k]
        for kind, x, y in spans_of(tags, a):
            if plausible(kind, t, x, y):
                added[k].append((kind, x, y))
    out = []
    for b, more in zip(base, added):
        taken = sorted((x, y) for _, x, y in b)
        reach = np.maximum.accumulate([y for _, y in taken]).tolist() if taken else []
        keep: list[Span] = []
        i = 0
        for kind, x, y in more:  # both by start: one walk along both
            while i < len(taken) and taken[i][0] < y:
                i += 1
            if not i or reach[i - 1] <= x:
                keep.append((kind, x, y))
        out.append((b, keep))
    return out


def _together(batches: Iterator[pa.RecordBatch], size: int = 3 << 20) -> Iterator[pa.Table]:
    """Batches put together until they have so many bytes: windows of like length are more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``spans``: arrays of (kind, start, end) in code
    points, end exclusive, by kind as in ``KINDS`` and then by start; ``spans``
    holds the base spans and those that the tagger adds.

    One narrow pass over whole texts.  Null and empty texts have no spans.
    Repeated rows and null ids are searched row by row; other columns are not
    read; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(trained())
    entry = lambda s: {"kind": s[0], "start": s[1], "end": s[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in _together(batches):
            found = text_spans(pc.fill_null(batch.column(1), "").to_pylist(), model)
            base = pa.array([[entry(s) for s in b] for b, _ in found], pa.list_(_SPAN))
            spans = pa.array([[entry(s) for s in in_order(b + more)] for b, more in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0).combine_chunks(), base, spans], names=[id_col, "base", "spans"])

    shape = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, base {shape}, spans {shape}")
