"""What the learned operators share: held-out rows, bounded samples of labelled rows, and logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on at most, in the order of a hash of doc_id.
MAX_LABELLED = 8000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, columns: Sequence[str] = ("text",), most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the string ``columns`` and label ``y`` of rows that may be learned from: at most ``most`` documents, taken by hash order.

    Ids with several differing labels take the larger, and ids with several rows one of them; null labels
    and ids are left out. The ids are at most ``most``, hence the broadcast.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    ids = ids.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    taken = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("row"))
    found = rows.join(F.broadcast(taken), F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return found.select("doc_id", "row.*", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients and, last, the intercept of a ridge logistic regression, by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    c = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = sigmoid(x1 @ c)
        g = x1.T @ (w * (p - y)) + penalty * c
        h = (x1 * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(penalty)
        d = np.linalg.solve(h, g)
        c -= d * min(1.0, 10 / max(np.abs(d).max(), 1e-12))
        if np.abs(d).max() < 1e-6:
            break
    return c
