"""Toxicity by maximum-scoring segments.

Words and their beginnings (of 4 to 7 letters) in a bounded sample of labelled documents get log-odds of standing in a toxic
one, with a Dirichlet prior whose mean is their share of the sample; those that are significantly toxic form the lexicon. A
word weighs what it or its heaviest beginning does, less each time it is said again; any other word costs a little. One linear scan over a
whole text finds all maximal segments (none can be extended or split to score more). A segment's score is turned into an
expectation by the extreme-value law of such scores, K n exp(-lambda S), so that long texts need more; significant
segments add up, and a logistic fit on the other half of the sample turns the sums into a probability.

Defined results: a null, empty or unscored text gets the score of a text without toxic words; repeated rows score alike;
without labels, or with labels of one kind, all documents get the smoothed share of that kind; other columns may have any
name; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, Logistic, classified, sample, scored
from .shared import tidy, unboxed

MOD, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Strength of the prior in documents, and what each entry gets beside its share.
PRIOR, EVEN = 10.0, 0.5
MIN_Z, MIN_COUNT, MIN_ODDS = 3.1, 4, 2.0
#: Lengths of beginnings; they are written with a star.
STEMS = (4, 5, 6, 7)
K = 0.1
#: Letters with their marks, and digits: the same when a lexicon is fitted and when texts are scored.
PATTERN = r"[\p{L}\p{M}\p{N}]+"
WORDS = regex.compile(PATTERN)


def segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words cost `cost` each but for the hits.

    Of a candidate's predecessors only the nearest with a smaller sum before it matters, and candidates link to theirs: a
    search follows links, passes a candidate at most once before another one's link hides it, and so all are linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, at = 0.0, -1
    for i, weight in hits:
        total -= cost * (i - at - 1)
        first, low, high = i, total, total + weight
        total, at = high, i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            first, _, low, _, link = found[j]
            del found[j:]
            j = link
        found.append((first, i, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


class Model:
    """Lexicon, cost of other words, and lambda of the extreme-value law; then the calibration."""

    def __init__(self, lexicon: dict[str, float], cost: float, decay: float):
        self.lexicon, self.cost, self.decay = lexicon, cost, decay
        self.heads = {w.rstrip("*")[:4] for w in lexicon}
        self.calibration: Logistic | None = None

    def weight(self, word: str) -> float | None:
        found = [self.lexicon.get(word), *[self.lexicon.get(word[:k] + "*") for k in STEMS if len(word) > k]]
        return max((x for x in found if x is not None), default=None)

    def passages(self, text: str | None) -> tuple[list[str], list[tuple[int, int, float, float]]]:
        """Words of the text, and its maximal segments with their log expectation."""
        words, heads = WORDS.findall((text or "").lower()), self.heads
        hits, seen = [], {}
        for i, w in enumerate(words):
            if w[:4] in heads and (weight := self.weight(w)) is not None:
                seen[w] = seen.get(w, 0) + 1
                hits.append((i, weight / seen[w]))
        found = segments(hits, self.cost)
        return words, [(a, b, s, float(np.log(K * max(1, len(words)))) - self.decay * s) for a, b, s in found]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Of the best segment and of all significant ones, minus log expectation, and how many unlike toxic words those have."""
        words, found = self.passages(text)
        significant = [x for x in found if x[3] < 0]
        unlike = {w for a, b, *_ in significant for w in words[a : b + 1] if w[:4] in self.heads and self.weight(w) is not None}
        return max((-x[3] for x in significant), default=0.0) ** 0.5, float(np.log1p(sum(-x[3] for x in significant))), float(np.log1p(len(unlike)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.calibration(np.array([self.features(t) for t in texts.to_pylist()], float).reshape(-1, 3))


def _beginnings(words: str, k: int) -> Column:
    """The first k letters of longer words, with a star. A lambda of two parameters would be given an index as its second."""
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    rows = sample(docs, labels, "toxic", MOD, HELD_OUT, size)
    one = rows.filter("half = 0").select("y", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(PATTERN), F.lit(0))).alias("words"))
    d1, d0, length = (float(x or 0) for x in one.agg(F.sum("y"), F.sum(1 - F.col("y")), F.avg(F.size("words"))).first())
    stems = [_beginnings("words", k) for k in STEMS]
    entries = one.select("y", F.explode(F.array_distinct(F.concat("words", *stems))).alias("word"))
    counts = entries.groupBy("word").agg(F.sum("y").alias("y1"), F.sum(1 - F.col("y")).alias("y0"))
    prior = (F.col("y1") + F.col("y0")) / max(1.0, d1 + d0) * PRIOR + EVEN
    odds = F.log((F.col("y1") + prior) / (d1 + PRIOR)) - F.log((F.col("y0") + prior) / (d0 + PRIOR))
    z = odds / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    toxic = counts.select("word", "y1", ((F.col("y0") + prior) / (d0 + PRIOR)).alias("p0"), odds.alias("odds"), z.alias("z")).filter((F.col("z") >= MIN_Z) & (F.col("y1") >= MIN_COUNT) & (F.col("odds") >= MIN_ODDS))
    # of the sample's words and beginnings those in MIN_COUNT toxic documents at least, so that the sample's size bounds them
    found = toxic.orderBy("word").collect()
    lexicon = {r.word: float(r.odds) for r in found}
    # what a word that isn't in the lexicon says: each hit counts once, by its shortest entry
    roots = [r for r in found if not any(r.word[:k] + "*" in lexicon for k in STEMS if len(r.word.rstrip("*")) > k)]
    p1 = min(0.5, sum(r.y1 for r in roots) / max(1.0, d1 * (length or 1)))
    cost = max(1e-3, -float(np.log(1 - p1)))
    # lambda: the positive root of E exp(lambda s) = 1 under the words of documents that aren't toxic
    share, odds_of = np.array([r.p0 / max(1.0, length or 1) for r in roots]), np.array([r.odds for r in roots])
    low, high = 0.05, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        moment = (share * np.exp(mid * odds_of)).sum() + (1 - share.sum()) * np.exp(-mid * cost)
        low, high = (mid, high) if moment < 1 else (low, mid)
    model = Model(lexicon, cost, (low + high) / 2)
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([bound.value.features(t) for t in b.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.record_batch([b.column("y"), b.column("half"), *[pa.array(f[:, i]) for i in range(3)]], names=["y", "half", "f0", "f1", "f2"])

    # at most `size` rows of four numbers
    told = rows.select("text", "y", "half").mapInArrow(tidy(measured), "y int, half int, f0 double, f1 double, f2 double").toPandas()
    table = told[told["half"] == 1] if (told["half"] == 1).any() else told
    model.calibration = Logistic(table[["f0", "f1", "f2"]].to_numpy(float), table["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """row (a struct of those columns of docs) and score."""
    bound = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, list(columns), lambda texts: bound.value.scores(texts))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return classified(score(docs, fit(docs, labels), "doc_id"), MOD, HELD_OUT, THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic; without labels none is."""
    model = fit(docs, labels)
    rows = score(docs, model, *docs.columns)
    return (rows.filter(F.col("score") < THRESHOLD) if model.calibration.rows else rows).select(*unboxed(docs.columns))
