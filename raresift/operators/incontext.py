"""A classifier that answers from a bounded context of labelled rows, without growing anything.

Every row is compared with all rows of the context; what their labels say is averaged with weights that fall with
distance (one softmax over the context, as attention has it). Several views differ in how wide they look and in how much
the features that set the classes apart count. Views are weighed by how well they foretell each context row from the
others, and the averaged answer is calibrated on the same left-out answers, so that it is a probability.

The context is bounded (``MOST_CONTEXT``), so it is fitted on the driver and travels with the scoring function. Scoring is a
map over Arrow batches: no row moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresift.constants import SEED
from raresift.schema import require_columns
from raresift.session import ship_package

MOST_CONTEXT = 4_096
VIEWS = 32
#: Views that take part in scoring: their weights come first.
KEPT_VIEWS = 4
WIDTHS = (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4)
#: Rows compared with the context at a time: their distances stay in a core's cache.
CHUNK = 128
#: Every class keeps this share of an answer, so that no answer is certain.
FLOOR = 1e-4
CONTEXT_COLUMNS = "place int, label int, x array<double>"


@dataclass(frozen=True)
class ContextClassifier:
    """Context rows and their classes, views as (share, factor per feature), and the calibration (slope, shift per class)."""

    features: tuple[str, ...]
    classes: int
    rows: tuple[tuple[float, ...], ...]
    labels: tuple[int, ...]
    views: tuple[tuple[float, tuple[float, ...]], ...]
    slope: float
    shifts: tuple[float, ...]

    def probability(self, values: Column) -> Column:
        """Class probabilities from the array of features in order."""
        answer = self.answerer()

        @F.pandas_udf("array<double>")
        def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.concatenate(batch.to_list() or [[]]).astype(float).reshape(len(batch), len(self.features))
                yield pd.Series(list(answer(x)))

        return probabilities(values)

    def answerer(self) -> Callable[[np.ndarray], np.ndarray]:
        context, truth = np.array(self.rows, float), np.eye(self.classes)[list(self.labels)]
        shifts = np.array(self.shifts)

        def answer(x: np.ndarray) -> np.ndarray:
            made = np.zeros((len(x), self.classes))
            for begin in range(0, len(x), CHUNK):
                own = x[begin : begin + CHUNK]
                shares = sum(share * _attend(own, context, truth, np.array(factors), False) for share, factors in self.views)
                made[begin : begin + CHUNK] = _calibrated(shares, self.slope, shifts)
            return made

        return answer

    def describe(self) -> dict:
        return {
            "features": list(self.features),
            "classes": self.classes,
            "views": [[share, list(factors)] for share, factors in self.views],
            "slope": self.slope,
            "shifts": list(self.shifts),
        }

    def save(self, spark: SparkSession, place: str) -> None:
        rows = [(i, label, list(x)) for i, (label, x) in enumerate(zip(self.labels, self.rows, strict=True))]
        spark.createDataFrame(rows, CONTEXT_COLUMNS).coalesce(1).write.mode("overwrite").parquet(place)


def load_context(spark: SparkSession, place: str, description: dict) -> ContextClassifier:
    rows = spark.read.parquet(place).orderBy("place").collect()  # MOST_CONTEXT at most
    return ContextClassifier(
        tuple(description["features"]),
        description["classes"],
        tuple(tuple(row.x) for row in rows),
        tuple(row.label for row in rows),
        tuple((share, tuple(factors)) for share, factors in description["views"]),
        description["slope"],
        tuple(description["shifts"]),
    )


def _attend(x: np.ndarray, context: np.ndarray, truth: np.ndarray, factors: np.ndarray, left_out: bool) -> np.ndarray:
    """Class shares of the context by softmax of minus the squared distances. ``left_out``: no row answers for itself."""
    a, b = x * factors, context * factors
    near = 2.0 * a @ b.T - (b**2).sum(axis=1)  # the row's own length does not change its softmax
    if left_out:
        np.fill_diagonal(near, -np.inf)
    weights = np.exp(near - near.max(axis=1, keepdims=True))
    shares = weights @ truth / weights.sum(axis=1, keepdims=True)
    return (1.0 - FLOOR * truth.shape[1]) * shares + FLOOR


def _calibrated(shares: np.ndarray, slope: float, shifts: np.ndarray) -> np.ndarray:
    scores = slope * np.log(shares) + shifts
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _loss(shares: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log((shares * truth).sum(axis=1)).mean())


def _calibrate(shares: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray]:
    """Slope and shifts of least loss, held near (1, 0) so that a small context cannot overdo it."""
    slope, shifts = 1.0, np.zeros(truth.shape[1])
    logs, count = np.log(shares), len(shares)
    for _ in range(300):
        miss = _calibrated(shares, slope, shifts) - truth
        slope -= 0.1 * (float((miss * logs).sum()) / count + (slope - 1.0) / count)
        shifts = shifts - 0.1 * (miss.sum(axis=0) / count + shifts / count)
        slope = max(0.05, slope)
    return slope, shifts


def fit_context(df: DataFrame, features: Sequence[str], label: str, classes: int, views: int = VIEWS, seed: int = SEED) -> ContextClassifier:
    """Take all rows of a small table as context. ``label`` holds 0..classes-1; more than ``MOST_CONTEXT`` rows are refused."""
    require_columns(df, [label, *features])
    ship_package(df.sparkSession)
    found = df.select(F.col(label).cast("int").alias("label"), *[F.col(name).cast("double") for name in features]).limit(MOST_CONTEXT + 1).toPandas()
    if not 0 < len(found) <= MOST_CONTEXT:
        raise ValueError(f"a context has 1 to {MOST_CONTEXT} rows")
    table = found.to_numpy(dtype=float)
    table = table[np.lexsort(table.T[::-1])]  # rows arrive in no fixed order
    labels, x = table[:, 0].astype(int), table[:, 1:]
    truth = np.eye(classes)[labels]
    spread = x.std(axis=0)
    scale = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)
    # How far apart the class means lie, in spreads within the classes.
    means = np.array([x[labels == code].mean(axis=0) if (labels == code).any() else x.mean(axis=0) for code in range(classes)])
    within = np.sqrt(((x - means[labels]) ** 2).mean(axis=0))
    telling = means.std(axis=0) / np.where(within > 0, within, np.where(spread > 0, spread, 1.0))
    telling = telling / (telling.max() or 1.0)
    draw = np.random.default_rng(seed)
    tried = []
    for view in range(views):
        power = 0.0 if view < len(WIDTHS) else draw.uniform(0.0, 1.5)
        factors = scale * np.maximum(telling, 1e-3) ** power / np.sqrt(2.0 * WIDTHS[view % len(WIDTHS)])
        tried.append((factors, _attend(x, x, truth, factors, True)) if len(x) > 1 else (factors, np.full((1, classes), 1.0 / classes)))
    losses = np.array([_loss(shares, truth) for _, shares in tried])
    best = np.argsort(losses, kind="stable")[:KEPT_VIEWS]
    share = np.exp(-min(len(x), 200) * (losses[best] - losses[best[0]]))
    share = share / share.sum()
    together = sum(part * tried[place][1] for part, place in zip(share, best, strict=True))
    slope, shifts = _calibrate(together, truth)
    return ContextClassifier(
        tuple(features),
        classes,
        tuple(map(tuple, x.tolist())),
        tuple(labels.tolist()),
        tuple((float(part), tuple(tried[place][0].tolist())) for part, place in zip(share, best, strict=True)),
        float(slope),
        tuple(shifts.tolist()),
    )
