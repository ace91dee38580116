"""Hard negatives for anchors: the best scores of other labels just below a positive's, by a table of pivot distances.

A row's score with an anchor q is the inner product q.x. With M the largest norm of all, x gets one more component,
sqrt(M*M - x.x), and q gets 0 there; then the squared distance of the two is q.q + M*M - 2 q.x, so that the nearest has the
highest score. The pivot table stores each row's distances to a few pivots; by the triangle inequality
|d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) for each pivot p, which brackets the score. Rows whose bracket rules them
out aren't looked at; the survivors' products are made exactly, in whole numbers.

1. Positives: in blocks of anchors and rows of one label, the kth of the brackets' lower ends is a bound that the k best
   reach; survivors are checked, and the best of all blocks are taken.
2. Negatives: in blocks of anchors and rows of any label, a row survives for a positive if its bracket meets the band from
   `least` hundredths of the positive's score to that score, and the kth lower end among brackets inside the band raises
   that. Survivors are checked, and the best of all blocks are taken.

Anchors against all rows, in blocks, are the work that is asked for: each tile holds at most some ANCHORS anchors and ROWS
rows, tiles give k rows for each anchor and positive, and a label of many rows is dealt to many tiles.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; components
beyond 2**26 after scaling count as that; a shorter vector counts as if zeros followed; of rows of one id the one with the
least label, then vector, takes part; ties go to the smaller id; a positive below zero has no negatives; an anchor without
positives, or a positive without negatives, gives no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, small_side, staged, tidy, tidy_group

SCALE, MOST = 256, 1 << 26
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
LEAST, HIGHEST, WHOLE = 80, 100, 100
PIVOTS = 16
#: Rows that pivots are fitted on, those of the smallest hashes.
SAMPLE = 1024
ANCHORS, ROWS = 256, 2048


def vectors_of(rows: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label, v (whole numbers) of the rows that take part."""
    x = F.transform(quoted(vector), lambda c: c.cast("double"))
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    given = rows.select(quoted(id).cast("long").alias("id"), quoted(label).cast("long").alias("label"), F.when(usable, x).alias("x")).filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    v = F.transform("x", lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(F.lit(float(SCALE)) * c).cast("double"))).cast("int"))
    return given.select("id", "label", v.alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("of")).select("id", "of.label", "of.v")


def with_noise(rows: DataFrame, every: int = RELABEL_EVERY, labels: int = LABELS) -> DataFrame:
    """Every so-manieth id is given the next label, as labels of a real set are wrong at times."""
    return rows.withColumn("label", F.when(F.col("id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, zeros after the shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit_pivots(sample: np.ndarray, most: float, pivots: int = PIVOTS) -> np.ndarray:
    """Points among augmented vectors: seeds far from each other, then means of the nearest. most: the largest squared norm of all rows."""
    x = np.column_stack([sample, np.sqrt(np.maximum(0, most - (sample * sample).sum(1)))])
    if not len(x):
        return np.zeros((0, x.shape[1]))
    at, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < min(pivots, len(x)):
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    points = x[at]
    for _ in range(8):
        nearest = ((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T).argmin(1)
        points = np.stack([x[nearest == k].mean(0) if (nearest == k).any() else p for k, p in enumerate(points)])
    return points


def _distances(x: np.ndarray, last: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of vectors (and their last component) to the pivots."""
    squares = (x * x).sum(1) + last * last
    return np.sqrt(np.maximum(0, squares[:, None] + (points * points).sum(1) - 2 * (x @ points[:, :-1].T + last[:, None] * points[:, -1])))


def _pivoted(width: int, most: float, points: np.ndarray, every: int) -> Callable:
    """id, label, v -> also d (distances as a row) and q (distances as an anchor, null for others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), width).astype(np.float64)
            rows = _distances(x, np.sqrt(np.maximum(0, most - (x * x).sum(1))), points)
            asked = _distances(x, np.zeros(len(x)), points)
            is_anchor = b.column("id").to_numpy() % every == 0
            lists = pa.array([d if a else None for d, a in zip(asked, is_anchor)], pa.list_(pa.float64()))
            yield pa.record_batch([b.column("id"), b.column("label"), b.column("v"), pa.array(list(rows), pa.list_(pa.float64())), lists], names=["id", "label", "v", "d", "q"])

    return run


class _Tile:
    """Anchors and rows of a tile: brackets of scores, and exact scores of survivors."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, width: int, most: float):
        self.q, self.x = (_matrix(t.column("v"), width).astype(np.int64) for t in (anchors, rows))
        self.ids, self.labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        self.anchors, self.anchor_labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        n = len(anchors.column("q")[0]) if len(self.q) else 0
        self.to_rows, self.to_anchors = _matrix(rows.column("d"), n).T.copy(), _matrix(anchors.column("q"), n)
        self.most, self.squares = most, (self.q * self.q).sum(1)

    def brackets(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest score that each row may have with anchor a."""
        d = self.to_anchors[a][:, None]
        near, far = np.abs(d - self.to_rows).max(0), (d + self.to_rows).min(0)
        whole = float(self.squares[a]) + self.most
        slack = 1e-7 * whole + 1  # a distance near zero is wrong by the root of what its square is wrong by
        return (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack

    def scores(self, a: int, at: np.ndarray) -> np.ndarray:
        return self.x[at] @ self.q[a]

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[order]], scores[order]


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _columns(found: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64()) for i in range(len(names))], names=names)


def _positives(width: int, most: float, k: int) -> Callable:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            tile = _Tile(anchors, rows, width, most)
            for a in range(len(tile.q)):
                low, high = tile.brackets(a)
                other = tile.ids != tile.anchors[a]
                at = np.flatnonzero(other & (high >= _kth(low[other], k)))
                ids, scores = tile.best(at, tile.scores(a, at), k)
                found.append((np.full(len(ids), tile.anchors[a]), ids, scores, np.full(len(ids), len(at))))
        return _columns(found, ["anchor_id", "positive_id", "positive_score", "checked"])

    return run


def _negatives(width: int, most: float, k: int) -> Callable:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            tile = _Tile(anchors, rows, width, most)
            positives = anchors.column("positives").to_pylist()
            for a in range(len(tile.q)):
                low, high = tile.brackets(a)
                other = tile.labels != tile.anchor_labels[a]
                bands, survives = [], np.zeros(len(other), bool)
                for p in positives[a]:
                    top = p["positive_score"]
                    least = -(-LEAST * top // WHOLE)
                    raised = max(least, _kth(low[other & (low >= least) & (high <= top)], k))
                    bands.append((p["positive_id"], least, HIGHEST * top // WHOLE, raised))
                    survives |= other & (high >= raised) & (low <= top)
                at = np.flatnonzero(survives)
                scores = tile.scores(a, at)
                for id, least, top, _ in bands:
                    own = (scores >= least) & (scores <= top)
                    ids, best = tile.best(at[own], scores[own], k)
                    found.append((np.full(len(ids), tile.anchors[a]), np.full(len(ids), id), ids, best))
        return _columns(found, ["anchor_id", "positive_id", "negative_id", "negative_score"])

    return run


def _parts(n: Column | int, size: int) -> Column | int:
    return max(1, ceil(n / size)) if isinstance(n, int) else F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def _anew(*columns: str) -> list[Column]:
    """Columns under their own names, but of another side."""
    return [F.col(c).alias(c) for c in columns]


def _group(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id"), parts).cast("int")


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def pivot_table(rows: DataFrame, every: int = ANCHOR_EVERY, pivots: int = PIVOTS) -> tuple[DataFrame, int, float]:
    """id, label, v, d, q of rows (id, label, v), staged; the width of vectors, and their largest squared norm."""
    rows = staged(rows, "negatives-vectors")
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, c: s + c.cast("double") * c.cast("double"))
    width, most = rows.agg(F.max(F.size("v")), F.max(square)).first()
    width, most = width or 0, float(most or 0)
    # a bounded sample: SAMPLE vectors
    some = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    points = fit_pivots(np.array([v + [0] * (width - len(v)) for v in some], np.float64).reshape(len(some), width), most, pivots)
    table = rows.mapInArrow(tidy(_pivoted(width, most, points, every)), "id long, label long, v array<int>, d array<double>, q array<double>")
    return staged(table, "negatives-pivots"), width, most


def mine(rows: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. rows: id, label, v of unlike ids."""
    table, width, most = pivot_table(rows, every)
    sizes = table.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n"), F.count("q").alias("asked"))
    sizes = small_side(staged(sizes, "negatives-labels"), 24)
    rowed = table.join(sizes, F.col("label") == F.col("of"))
    tiled = lambda df, own, other, one, two: df.withColumn(one, _group(own)).withColumn(two, _each(other))
    asked, met = _parts(F.col("asked"), ANCHORS), _parts(F.col("n"), ROWS)
    left = tiled(rowed.filter("q IS NOT NULL").select("id", "label", "v", "q", "asked", "n"), asked, met, "g", "r").drop("asked", "n")
    right = tiled(rowed.filter("asked > 0").select(*_anew("id", "label", "v", "d", "asked", "n")), met, asked, "r", "g").drop("asked", "n")
    keys = ["label", "g", "r"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tidy_pair(_positives(width, most, positives)), "anchor_id long, positive_id long, positive_score long, checked long")
    first = _firsts(best, ["anchor_id"], ["positive_score", "positive_id"], positives, "place").select("anchor_id", "positive_id", "positive_score")
    found = staged(first, "negatives-positives")
    lists = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # `positives` of them at most
    count, n_asked = table.agg(F.count("*"), F.count("q")).first()
    asked, met = F.lit(_parts(int(n_asked), ANCHORS)), F.lit(_parts(int(count), ROWS))
    left = tiled(table.filter("q IS NOT NULL").select("id", "label", "v", "q").join(lists, F.col("id") == F.col("anchor_id")).drop("anchor_id"), asked, met, "g", "r")
    right = tiled(table.select(*_anew("id", "label", "v", "d")), met, asked, "r", "g")
    below = left.groupBy("g", "r").cogroup(right.groupBy("g", "r")).applyInArrow(tidy_pair(_negatives(width, most, negatives)), "anchor_id long, positive_id long, negative_id long, negative_score long")
    ranked = _firsts(below, ["anchor_id", "positive_id"], ["negative_score", "negative_id"], negatives, "rank")
    scores = small_side(found.select(F.col("anchor_id").alias("a"), F.col("positive_id").alias("p"), "positive_score"), 24)
    out = ranked.join(scores, (F.col("anchor_id") == F.col("a")) & (F.col("positive_id") == F.col("p")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def tidy_pair(run: Callable) -> Callable:
    """tidy_group for two tables."""
    give = tidy_group(lambda both: run(*both))
    return lambda left, right: give((left, right))


def _firsts(rows: DataFrame, by: list[str], order: list[str], k: int, rank: str) -> DataFrame:
    """The k of each group with the highest order[0], ties to the smaller order[1]. Groups hold k rows of each block."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order[0]).desc(), order[1]))
    return rows.withColumn(rank, place).filter(F.col(rank) <= k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The rows of mine() for a table vec_id, embedding, label, every seventh label of which is made wrong first."""
    return mine(with_noise(vectors_of(embeddings)))


SQL = f"""
WITH given AS (
  SELECT vec_id AS id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.id AS anchor, q.label AS own, x.id, x.label, list_inner_product(q.v, x.v)::BIGINT AS score FROM given q JOIN given x ON q.id % {ANCHOR_EVERY} = 0 AND x.id <> q.id
), positives AS (
  SELECT anchor AS anchor_id, own, id AS positive_id, score AS positive_score FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES}
), met AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored ON anchor = anchor_id AND label <> scored.own WHERE {LEAST} * positive_score <= {WHOLE} * score AND {WHOLE} * score <= {HIGHEST} * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= {NEGATIVES}
"""
