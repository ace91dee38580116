"""Bounded samples of labelled documents, scores of texts beside their rows, and a small logistic model for calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import boxed, heldout_mod, quoted, staged, tidy

#: Labelled documents that a model is fitted on at most: those of the smallest hashes.
SAMPLE = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, size: int = SAMPLE) -> DataFrame:
    """text, y (0 or 1) and half (1 for a quarter of them, kept for calibration, else 0) of up to size labelled documents whose crc32(doc_id) mod `mod` isn't held_out; staged."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (heldout_mod("doc_id", mod) != held_out))
    hashed = F.xxhash64(F.lit("labelled"), "doc_id")
    few = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(hashed, "doc_id").limit(size)
    few = staged(few.select("doc_id", "y", (hashed.bitwiseAND(F.lit(3)) == 0).cast("int").alias("half")), "labelled-ids")
    # at most `size` rows of three numbers
    rows = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").cast("string").alias("text"))
    # one row an id, however often it stands: the one with the least text
    one = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "y", "half")).alias("of"))
    return staged(one.select("of.text", "of.y", "of.half"), "labelled")


def scored(docs: DataFrame, columns: list[str], scores: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """row (a struct of those columns of docs) and score, which `scores` gives for a batch of texts."""
    rows = docs.select(boxed(docs, columns), quoted("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("row"), pa.array(scores(b.column("text")), pa.float64())], names=["row", "score"])

    return rows.mapInArrow(tidy(run), StructType([rows.schema["row"], StructField("score", DoubleType())]))


def classified(rows: DataFrame, mod: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted, from scored rows of doc_id."""
    told = rows.select(F.col("row").getField("doc_id").alias("doc_id"), "score")
    return told.select("doc_id", (heldout_mod("doc_id", mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


class Logistic:
    """Ridge logistic regression on a few columns; with one class only, a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.rows = len(x)
        z = self._with_one(x)
        self.w = np.zeros(z.shape[1])
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.w[-1] = np.log(share / (1 - share))
        if not 0 < y.sum() < len(y):
            return
        for _ in range(steps):
            p = self._p(z)
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(self.w)) * ridge * len(y)
            move = np.linalg.solve(curve, z.T @ (y - p) - ridge * len(y) * np.append(self.w[:-1], 0))
            self.w += np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-8:
                break

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def _p(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.w, -40, 40)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._p(self._with_one(x))
