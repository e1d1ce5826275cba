"""Kernel regression at scale: random Fourier features of a Gaussian kernel and an epsilon-insensitive loss.

A row's features are cosines of random projections, whose products approximate the kernel, so the model is linear in them and
its size does not grow with the rows. The loss (nothing within epsilon, linear beyond, joined by a parabola so that
it has a gradient) is minimised on the driver by limited-memory steps; every evaluation is one pass in which tasks
sum the loss and its gradient over their rows, and one row a task comes back. It starts from the
least-squares solution, which is one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .grams import BLOCK, grams, matrix


def cosines(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2 / len(b)) * np.cos(x @ w + b)


def insensitive(r: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative at the residuals ``r``; the parabola is a quarter of epsilon wide."""
    width = max(epsilon / 4, 1e-6)
    u = np.abs(r) - epsilon
    inside = np.clip(u, 0, width)
    return inside * inside / (2 * width) + np.maximum(u - width, 0), np.sign(r) * inside / width


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, passes: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; ``f`` is called at most ``passes`` times."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    left = passes - 1
    while left > 0 and np.abs(g).max() > tolerance:
        d, coefficients = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            coefficients.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(coefficients)):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while left > 0:
            new = x + step * d
            value_new, g_new = f(new)
            left -= 1
            if value_new <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (g_new - g) @ (new - x) > 1e-12:
            pairs = [*pairs, (new - x, g_new - g)][-memory:]
        x, value, g = new, value_new, g_new
    return x


@dataclass(frozen=True)
class KernelRegression:
    """Means and deviations of the inputs, projections, phases, and intercept and weights of the features."""

    mean: np.ndarray
    deviation: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, vector: str, label: str, features: int = 512, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, passes: int = 40, tolerance: float = 1e-5, seed: int = 42) -> KernelRegression:
        """Fit ``label`` on the vectors of a column; rows that lack either are left out. Inputs are standardised; ``gamma`` is 1 over their number unless given.

        Minimises |weights|^2 / 2 + ``c`` times the sum of losses, in at most ``passes`` + 2 scans.
        """
        rows = checkpointed(df.select(F.col(vector).alias("x"), F.col(label).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL"), "kernel")
        g = grams(rows, "x").get(0)
        if g is None:
            raise ValueError("no row has a vector and a label")
        p, n = len(g.origin), g.n
        mean, sd = g.origin + g.sums[0, 1:] / n, np.sqrt(np.maximum(np.diag(g.covariance()), 0))
        sd = np.where(sd > 0, sd, 1.0)
        draw = np.random.default_rng(seed)
        w = draw.normal(size=(p, features)) * np.sqrt(2 * (1 / p if gamma is None else gamma))
        b = draw.uniform(0, 2 * np.pi, features)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    z = cosines((matrix(part.column(0), p) - mean) / sd, w, b)
                    yield np.hstack([np.ones((len(z), 1)), z]), part.column(1).to_numpy()

        def summed(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            """The sum over all rows of what ``of`` gives for a block; a task sends one row of numbers."""

            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for z, y in mapped(batches):
                    v = of(z, y)
                    total = v if total is None else total + v
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

            return np.sum([np.frombuffer(r["v"]) for r in rows.mapInArrow(task, "v binary").collect()], axis=0)

        k = features + 1
        penalty = np.concatenate([[0.0], np.full(features, 1 / (c * n))])
        both = summed(lambda z, y: np.hstack([z.T @ z, (z.T @ y)[:, None]]).ravel()).reshape(k, k + 1) / n
        start = np.linalg.solve(both[:, :k] + np.diag(penalty + 1e-9), both[:, k])

        def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
            def of(z: np.ndarray, y: np.ndarray) -> np.ndarray:
                loss, slope = insensitive(z @ theta - y, epsilon)
                return np.concatenate([[loss.sum()], z.T @ slope])

            s = summed(of) / n
            return float(s[0] + (penalty * theta * theta).sum() / 2), s[1:] + penalty * theta

        return cls(mean, sd, w, b, minimised(objective, start, passes, tolerance))

    def predict(self, df: DataFrame, vector: str, out: str = "predicted_activity") -> DataFrame:
        """``df`` with predictions; null where there is no vector."""
        kept, p = [c for c in df.columns if c != out], len(self.mean)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                have = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
                y = np.full(b.num_rows, np.nan)
                x = (matrix(b.column(1).take(pa.array(have)), p) - self.mean) / self.deviation
                y[have] = self.weights[0] + cosines(x, self.w, self.b) @ self.weights[1:]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y, mask=np.isnan(y))], ["row", "y"])

        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(vector).alias("x"))
        return rows.mapInArrow(of, f"row {rows.schema['row'].dataType.simpleString()}, y double").select("row.*", F.col("y").alias(out))
