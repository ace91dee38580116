"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; a line's features and those of its neighbours weigh the two states, and a transition matrix
couples neighbouring lines. The field is fitted on all lines of a bounded sample of labelled documents (each takes its
document's label). For a text of any length the forward-backward pass gives each line's marginal; marginals add up, weighted by
length, to the share of good text, and a logistic fit on the other half of the sample turns that into a probability.

Features are counted on whole batches of bytes in numpy, for WINDOW lines at a time, and chains of a batch advance together.
The sample stays in tasks: each of STEPS passes sends the weights out and sums of gradients back. A text costs its task some
50 bytes of memory a byte while its words are hashed, and 40 a line.

Defined results: a null or empty text is one empty line; repeated rows score alike; without labels, or with labels of one
kind, all documents get the smoothed share of that kind; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, Logistic, classified, sample, scored
from .shared import Substrings, buffers, slices, tidy, word_bounds

MOD, HELD_OUT, THRESHOLD = 4, 2, 0.7
BATCH_BYTES = 1 << 20
#: Passes over the sample; shares of a Newton step, and penalties of weights and transitions.
STEPS, DAMP, RIDGE, STIFF = 14, 0.6, 1e-3, 0.05
#: Lines whose features are held at once.
WINDOW = 1 << 15


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, LOWER, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
STOP, MARK, OTHER, SPACE = _class(".,;:?"), _class("#*$%&|<>"), _class("!\"'()[]{}/\\@_+=~^`-"), _class(" \t\n\x0b\x0c\r")
#: Lengths of words that a language's short function words have.
SHORT = 3


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lines, and how many each text has; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    counts = 1 + np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1])
    return starts, ends, counts


class Lines:
    """The lines of all texts of a buffer. Of a line, a few numbers are kept; features are made for a window of lines at a time."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.starts, self.ends, self.counts = lines_of(data, off)
        self.n = n = len(self.starts)
        self.size = self.ends - self.starts
        self.docs = np.concatenate([np.cumsum(self.counts) - self.counts, [n]])
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.text = text
        self.first, self.last = word_bounds(data, off)
        self.at = np.searchsorted(self.starts, self.first, "right") - 1
        hashes = Substrings(data)
        salt = np.uint64(0x9E3779B97F4A7C15)
        self.repeated = _repeats(hashes.of(self.first, self.last) + text[self.at].astype(np.uint64) * salt)
        self.again = _repeats(hashes.of(self.starts, self.ends) + text.astype(np.uint64) * salt) & (self.size > 0)
        words = np.bincount(self.at, minlength=n)
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[self.docs]).astype(float)
        total, twice = sums(words), sums(self.again * words)
        #: Of each text, what all its lines see: how long it is, whether that is short, and how much of it stands in repeated lines.
        self.whole = np.column_stack([np.log1p(total), total < 50, twice / np.maximum(total, 1)])

    def _own(self, i: int, j: int) -> np.ndarray:
        """Features of lines i to j - 1 by themselves."""
        base, until = self.starts[i], self.ends[j - 1]
        data, starts, ends, size = self.data[base:until], self.starts[i:j] - base, self.ends[i:j] - base, self.size[i:j]
        some = np.maximum(size, 1).astype(float)

        def count(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return (sums[ends] - sums[starts]).astype(float)

        share = lambda table: count(table[data]) / some
        p, q = np.searchsorted(self.at, [i, j])
        at, first, last = self.at[p:q] - i, self.first[p:q], self.last[p:q]
        words = np.bincount(at, minlength=j - i).astype(float)
        many = np.maximum(words, 1)
        length = (last - first).astype(float)
        tail = self.data[last - 1] if len(last) else np.zeros(0, np.uint8)
        capital = UPPER[self.data[first]] if len(first) else np.zeros(0, bool)
        per_word = lambda v: np.bincount(at, weights=v.astype(float), minlength=j - i) / many
        return np.column_stack([
            np.log1p(words), size < 20, words < 5, np.minimum(per_word(length) / 10, 3), per_word(length <= SHORT), per_word(MARK[tail]), per_word(OTHER[tail]), per_word(STOP[tail]), per_word(capital), per_word(self.repeated[p:q]),
            share(UPPER), share(LOWER), share(DIGIT), share(STOP), share(MARK), share(OTHER), share(SPACE), count(data == 124) > 0, count(MARK[data]) > 0, self.again[i:j], size == 0,
        ]).astype(float)

    def features(self, i: int, j: int) -> np.ndarray:
        """A row for each of the lines i to j - 1: its own features, its neighbours' mean (at an edge of a text its own), and its text's."""
        begin, end = max(0, i - 1), min(self.n, j + 1)
        around = self._own(begin, end)
        rows = np.arange(i, j)
        before = np.where(np.isin(rows, self.docs[:-1]), rows, rows - 1) - begin
        after = np.where(np.isin(rows + 1, self.docs[1:]), rows, rows + 1) - begin
        return np.column_stack([around[rows - begin], (around[before] + around[after]) / 2, self.whole[self.text[rows]]])

    def windows(self) -> Iterator[tuple[int, int]]:
        for i in range(0, self.n, WINDOW):
            yield i, min(i + WINDOW, self.n)


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines at once: features, bytes, and lines per text."""
    lines = Lines(data, off)
    return lines.features(0, lines.n), lines.size + 1.0, lines.counts


def _repeats(h: np.ndarray) -> np.ndarray:
    """Which values stand in the array more than once."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(h), bool)
    same[1:] |= s[1:] == s[:-1]
    same[:-1] |= s[1:] == s[:-1]
    out = np.empty(len(h), bool)
    out[order] = same
    return out


class Field:
    """Weights of a two-state chain, in standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.w = np.zeros(len(mean) + 1)  # for state 1 against state 0
        self.t = np.zeros((2, 2))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))])

    def marginals(self, z: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.chains(z @ self.w, counts)

    def chains(self, weight: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(line is 1), and the expected transitions summed over all chains; weight: of each line, for 1 against 0."""
        unary = np.column_stack([np.zeros(len(weight)), weight])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        start, length = starts[order], counts[order]
        longest = int(length[0]) if len(length) else 0
        # chains that reach step k come first, so that each step works on a slice
        active = np.searchsorted(-length, -np.arange(longest), "left")
        forward, backward = unary.copy(), np.zeros_like(unary)
        for k in range(1, longest):
            at = start[: active[k]] + k
            forward[at] += np.logaddexp(forward[at - 1][:, :1] + self.t[0], forward[at - 1][:, 1:] + self.t[1])
        moved = np.zeros((2, 2))
        for k in range(longest - 1, 0, -1):
            at = start[: active[k]] + k
            ahead = unary[at] + backward[at]
            backward[at - 1] = np.logaddexp(self.t[:, 0] + ahead[:, :1], self.t[:, 1] + ahead[:, 1:])
            pair = forward[at - 1][:, :, None] + self.t + ahead[:, None, :]
            pair = np.exp(pair - pair.max((1, 2), keepdims=True))
            moved += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        return 1 / (1 + np.exp(np.clip((forward + backward) @ [1, -1], -40, 40))), moved

    def gradients(self, lines: Lines, y: np.ndarray) -> np.ndarray:
        """Sums over the chains of a buffer, flat: documents of each label, w's gradient and curvature, seen and expected transitions. Each document weighs one."""
        label, weight = np.repeat(y, lines.counts), np.repeat(1 / lines.counts, lines.counts)
        kept = [(a, b, self.inputs(lines.features(a, b)) if lines.n <= WINDOW else None) for a, b in lines.windows()]
        inputs = lambda a, b, z: self.inputs(lines.features(a, b)) if z is None else z
        p, moved = self.chains(np.concatenate([inputs(*k) @ self.w for k in kept]), lines.counts)
        g, h = np.zeros(len(self.w)), np.zeros((len(self.w), len(self.w)))
        for a, b, z in kept:
            z, own = inputs(a, b, z), weight[a:b]
            g += z.T @ ((label[a:b] - p[a:b]) * own)
            h += (z * (p[a:b] * (1 - p[a:b]) * own)[:, None]).T @ z
        seen = [((lines.counts - 1) * (y == s)).sum() for s in (0, 1)]
        return np.concatenate([[(y == 0).sum(), (y == 1).sum()], seen, moved.ravel(), g, h.ravel()])

    def move(self, sums: np.ndarray) -> None:
        """A damped Newton step in w, and a gradient step in the transitions, of the penalised log-likelihood."""
        k = len(self.w)
        docs, seen, moved, g, h = sums[:2].sum(), np.diag(sums[2:4]), sums[4:8].reshape(2, 2), sums[8 : 8 + k], sums[8 + k :].reshape(k, k)
        self.w += np.clip(np.linalg.solve(h + np.eye(k) * RIDGE * docs, g - RIDGE * docs * self.w) * DAMP, -1, 1)
        self.t += np.clip(((seen - moved) / max(1.0, seen.sum()) - STIFF * self.t) * 4, -1, 1)


class Model:
    def __init__(self, field: Field):
        self.field = field
        self.calibration: Logistic | None = None

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text, the length-weighted marginals as a share and as log-odds, the share of its worst quarter, and its length."""
        data, off = buffers(texts)
        out = [np.zeros((0, 4))]
        for i, j in slices(off, BATCH_BYTES):
            lines = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])
            size, docs = lines.size + 1.0, lines.docs[:-1]
            weight = np.concatenate([self.field.inputs(lines.features(a, b)) @ self.field.w for a, b in lines.windows()])
            p, _ = self.field.chains(weight, lines.counts)
            total = np.add.reduceat(size, docs)
            share = np.add.reduceat(p * size, docs) / total
            bad = np.add.reduceat((p < 0.5) * size, docs) / total
            odds = np.add.reduceat(np.log((p + 1e-4) / (1 - p + 1e-4)) * size, docs) / total
            out.append(np.column_stack([share, odds, bad, np.log(total)]))
        return np.concatenate(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.calibration(self.features(texts))


def _summed(rows: DataFrame, sums: Callable[[Lines, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all slices of rows (text, y); a task sends one row of a few thousand numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            data, off = buffers(b.column("text"))
            y = b.column("y").to_numpy()
            for i, j in slices(off, BATCH_BYTES):
                total = total + sums(Lines(data[off[i] : off[j]], off[i : j + 1] - off[i]), y[i:j])
        if isinstance(total, np.ndarray):
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = [np.frombuffer(r.sums, float) for r in rows.mapInArrow(tidy(run), "sums binary").collect()]
    return np.sum(found, axis=0) if found else np.zeros(0)


def _moments(lines: Lines, y: np.ndarray) -> np.ndarray:
    parts = [lines.features(a, b) for a, b in lines.windows()]
    return np.concatenate([[lines.n], sum(x.sum(0) for x in parts), sum((x * x).sum(0) for x in parts)])


def _fitted(rows: DataFrame) -> Field:
    """The field of labelled rows (text, y), on all their lines."""
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    sums = _summed(rows, _moments)
    if not len(sums):
        return Field(np.zeros(width), np.ones(width))
    mean, square = sums[1 : 1 + width] / sums[0], sums[1 + width :] / sums[0]
    field = Field(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6)
    for _ in range(STEPS):
        sums = _summed(rows, field.gradients)
        if not sums[0] or not sums[1]:
            break
        field.move(sums)
    return field


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """The field is fitted on all lines of its part of the sample: each step sends the weights, and tasks send sums of gradients back."""
    rows = sample(docs, labels, "quality", MOD, HELD_OUT, size)
    first, second = (rows.filter(F.col("half") == h).select("text", "y") for h in (0, 1))
    field = _fitted(first)
    model = Model(field)
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def aggregated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = bound.value.features(b.column("text"))
            yield pa.record_batch([b.column("y"), *[pa.array(f[:, i]) for i in range(4)]], names=["y", "f0", "f1", "f2", "f3"])

    # at most `size` rows of five numbers
    table = second.mapInArrow(tidy(aggregated), "y int, f0 double, f1 double, f2 double, f3 double").toPandas()
    model.calibration = Logistic(table[["f0", "f1", "f2", "f3"]].to_numpy(float), table["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """row (a struct of those columns of docs) and score."""
    bound = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, list(columns), lambda texts: bound.value.scores(texts))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return classified(score(docs, fit(docs, labels), "doc_id"), MOD, HELD_OUT, THRESHOLD)
