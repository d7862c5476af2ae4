"""Anomaly filters that score a row by how badly it is rebuilt from a narrow code."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from raresift.constants import ANOMALY_PERCENTILE
from raresift.functions.keyed import TWO_POW_32, draw_key, key_number
from raresift.functions.values import total as sum_of
from raresift.operators.selection import exact_percentile
from raresift.session import materialise, ship_package

#: Fixed-point units of activations, signals and errors; rows whose products are summed at once (see ``_gradient_sums``).
ACTIVATION_UNIT, SIGNAL_UNIT, ERROR_UNIT = 2.0**12, 2.0**20, 2.0**30
MOST_ACTIVATION = 2.0**8
CHUNK = 4096
#: Packed vectors that are added in one place.
FAN_IN = 64
#: The folder of rows that are kept for validation.
VALIDATING = -1


@dataclass(frozen=True)
class LinearReconstruction:
    """Projection on a few orthonormal directions and back. Scores are plain column arithmetic."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]

    def codes(self) -> list[Column]:
        """Coordinates of the centred row along the directions."""
        centred = [F.col(name) - F.lit(middle) for name, middle in zip(self.features, self.mean)]
        return [sum_of(x * F.lit(weight) for x, weight in zip(centred, direction)) for direction in self.components]

    def error(self) -> Column:
        """Mean squared error between a row and its rebuilt form.

        The directions are orthonormal, so what the code misses is the squared length of the centred row less
        that of the code. This grows with features times directions; spelling the rebuilt row out would grow
        with the square of the features and burst the generated code.
        """
        centred = [F.col(name) - F.lit(middle) for name, middle in zip(self.features, self.mean)]
        missed = sum_of(x * x for x in centred) - sum_of(code * code for code in self.codes())
        return F.greatest(missed, F.lit(0.0)) / F.lit(float(len(self.features)))

    def rebuilt(self) -> list[Column]:
        """The features as restored from the code, in order."""
        codes = self.codes()
        return [
            sum_of([F.lit(self.mean[i]), *[code * F.lit(direction[i]) for code, direction in zip(codes, self.components)]])
            for i in range(len(self.features))
        ]

    def score(self, df: DataFrame, output: str = "filter_score") -> DataFrame:
        """Add the reconstruction error."""
        return df.withColumn(output, self.error())

    def describe(self) -> dict:
        return {
            "kind": "linear",
            "features": list(self.features),
            "mean": list(self.mean),
            "components": [list(direction) for direction in self.components],
        }


def fit_linear(df: DataFrame, features: Sequence[str], width: int = 8) -> LinearReconstruction:
    """Principal directions of the scaled features."""
    means = df.agg(*[F.avg(name).alias(name) for name in features]).first()
    centred = df.select(*[(F.col(name) - F.lit(means[name])).alias(name) for name in features])
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(centred).select("features")
    found = PCA(k=min(width, len(features)), inputCol="features", outputCol="code").fit(vectors).pc.toArray()
    return LinearReconstruction(
        tuple(features),
        tuple(float(means[name]) for name in features),
        tuple(tuple(float(weight) for weight in found[:, j]) for j in range(found.shape[1])),
    )


def layer_sizes(inputs: int, width: int) -> list[tuple[int, int]]:
    """(rows, columns) of the weight matrices: in -> width -> width / 2 -> width -> in."""
    sizes = [inputs, width, width // 2, width, inputs]
    return list(zip(sizes[:-1], sizes[1:]))


def _unpack(flat: np.ndarray, inputs: int, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, start = [], 0
    for rows, columns in layer_sizes(inputs, width):
        weights = flat[start : start + rows * columns].reshape(rows, columns)
        start += rows * columns
        layers.append((weights, flat[start : start + columns]))
        start += columns
    return layers


def _forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """Activations per layer: relu inside, sigmoid at the end."""
    seen = [x]
    for place, (weights, bias) in enumerate(layers):
        z = seen[-1] @ weights + bias
        seen.append(np.maximum(z, 0.0) if place < len(layers) - 1 else 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))
    return seen


def _whole(values: np.ndarray, unit: float, most: float) -> np.ndarray:
    """Values as whole numbers of units, cut at ``most``."""
    return np.rint(np.clip(values, -most, most) * unit)


def _gradient_sums(flat: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Sum over rows of the gradient of the squared error per row and feature, in whole units (64 bits).

    Activations and signals are rounded to whole numbers of 20 bits. Sums of their products over ``CHUNK`` rows are
    below 2**53, so the matrix products are exact, and so are all sums: no order of rows or tasks changes them.
    """
    layers = _unpack(flat, x.shape[1], width)
    total = np.zeros(len(flat), np.int64)
    for begin in range(0, len(x), CHUNK):
        rows = x[begin : begin + CHUNK]
        seen = _forward(layers, rows)
        output = seen[-1]
        signal = 2.0 * (output - rows) * output * (1.0 - output)
        pieces: list[np.ndarray] = []
        for place in range(len(layers) - 1, -1, -1):
            whole = _whole(signal, SIGNAL_UNIT, 1.0)
            weights = (_whole(seen[place], ACTIVATION_UNIT, MOST_ACTIVATION).T @ whole).ravel()
            pieces = [weights, whole.sum(axis=0) * ACTIVATION_UNIT, *pieces]
            if place:
                signal = (signal @ layers[place][0].T) * (seen[place] > 0)
        total += np.concatenate(pieces).astype(np.int64)
    return total


def _gradient(flat: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Gradient of the mean squared error over some rows."""
    return _gradient_sums(flat, x, width) / (SIGNAL_UNIT * ACTIVATION_UNIT * x.size)


@dataclass(frozen=True)
class DenseReconstruction:
    """A small dense network; weights travel with the scoring function."""

    features: tuple[str, ...]
    width: int
    weights: tuple[float, ...]
    #: Mean error of the fitted and of the validation rows, epoch by epoch.
    history: tuple[tuple[float, float | None], ...] = field(default=(), compare=False)

    def score(self, df: DataFrame, output: str = "filter_score") -> DataFrame:
        ship_package(df.sparkSession)
        flat, width, inputs = np.array(self.weights), self.width, len(self.features)

        @F.pandas_udf("double")
        def error(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            layers = _unpack(flat, inputs, width)
            for batch in batches:
                x = batch.to_numpy(dtype=float)
                yield pd.Series(((x - _forward(layers, x)[-1]) ** 2).mean(axis=1))

        return df.withColumn(output, error(F.struct(*self.features)))

    def describe(self) -> dict:
        return {
            "kind": "dense",
            "features": list(self.features),
            "width": self.width,
            "weights": list(self.weights),
        }


def fit_dense(
    df: DataFrame,
    features: Sequence[str],
    width: int = 32,
    epochs: int = 100,
    steps: int = 4,
    rate: float = 5e-3,
    seed: int = 42,
    validation: float = 0.1,
) -> DenseReconstruction:
    """Train the network on a scaled table by exchanging gradients.

    Rows are dealt by their content to ``steps`` folders per epoch and one of validation rows. In a step every task sums
    the gradient of its rows into one packed vector, the vectors are added in a tree, and one step of Adam is
    taken, whose moments last from the first epoch to the last. Sums are exact, so the weights do not depend on how
    rows are partitioned. Validation rows are never fitted; their error is taken after each epoch.
    """
    spark = df.sparkSession
    ship_package(spark)
    inputs = len(features)
    start = np.random.default_rng(seed)
    flat = np.concatenate(
        [
            np.concatenate([start.uniform(-1, 1, rows * columns) * np.sqrt(6.0 / (rows + columns)), np.zeros(columns)])
            for rows, columns in layer_sizes(inputs, width)
        ]
    )
    numbers = [F.col(name).cast("double").alias(f"x{place}") for place, name in enumerate(features)]
    draw = draw_key(seed, "net", *[F.col(f"x{place}") for place in range(inputs)])
    turn = F.when(key_number(draw) < F.lit(validation * TWO_POW_32), F.lit(VALIDATING)).otherwise((key_number(draw, 1) % steps).cast("int"))
    rows = materialise(df.select(*numbers).withColumn("turn", turn), by="turn")
    names = [f"x{place}" for place in range(inputs)]

    def pass_over(turns: list[int]) -> np.ndarray:
        chosen = rows.filter(F.col("turn").isin(turns)).select(*names, F.col("turn").cast("int").alias("turn"))
        return _summed(chosen.mapInArrow(_gradient_task(flat, width, inputs), "part int, sums binary"), chosen.rdd.getNumPartitions(), 4 + len(flat))

    first, second, taken = np.zeros_like(flat), np.zeros_like(flat), 0
    history: list[tuple[float, float | None]] = []
    for _ in range(epochs):
        fitted, error = 0, 0.0
        for step in range(steps):
            sums = pass_over([step])
            if not sums[0]:
                continue
            gradient = sums[4:] / (SIGNAL_UNIT * ACTIVATION_UNIT * inputs * float(sums[0]))
            fitted, error, taken = fitted + int(sums[0]), error + sums[1] / ERROR_UNIT, taken + 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            flat = flat - rate * (first / (1 - 0.9**taken)) / (np.sqrt(second / (1 - 0.999**taken)) + 1e-7)
        if not fitted:
            raise ValueError("cannot train on an empty table")
        unseen = pass_over([VALIDATING])
        history.append((float(error / fitted), float(unseen[3] / ERROR_UNIT / unseen[2]) if unseen[2] else None))
    return DenseReconstruction(tuple(features), width, tuple(float(weight) for weight in flat), tuple(history))


def _gradient_task(flat: np.ndarray, width: int, inputs: int):
    """Packed sums of one task: fitted rows and their error, validation rows and theirs, then the gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = _unpack(flat, inputs, width)
        total = np.zeros(4 + len(flat), np.int64)
        for batch in batches:
            x = np.array([batch.column(place).to_numpy(zero_copy_only=False) for place in range(inputs)], float).T.copy()
            unseen = batch.column(inputs).to_numpy(zero_copy_only=False) == VALIDATING
            for place, own in ((0, x[~unseen]), (2, x[unseen])):
                if len(own):
                    errors = ((_forward(layers, own)[-1] - own) ** 2).mean(axis=1)
                    total[place : place + 2] += (len(own), int(np.rint(errors * ERROR_UNIT).sum()))
            if not unseen.all():
                total[4:] += _gradient_sums(flat, x[~unseen], width)
        if total[0] or total[2]:
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            # High and low halves, so that the sum over all tasks cannot overflow.
            halves = np.concatenate([total >> 32, total & 0xFFFFFFFF])
            yield pa.RecordBatch.from_arrays([part, pa.array([halves.tobytes()], pa.binary())], ["part", "sums"])

    return run


def _summed(parts: DataFrame, tasks: int, length: int) -> np.ndarray:
    """The sum of all packed vectors; at most ``FAN_IN`` of them meet in one place."""

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(entry.as_buffer(), np.int64) for entry in group.column("sums")], axis=0)
        return pa.table({"part": group.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.col("part") % tasks).groupBy("part").applyInArrow(add, "part int, sums binary")
    total = np.zeros(2 * length, np.int64)
    for row in parts.collect():  # FAN_IN vectors at most
        total += np.frombuffer(row.sums, np.int64)
    return total[:length] * 2.0**32 + total[length:]


def reconstruction_from(description: dict) -> LinearReconstruction | DenseReconstruction:
    features = tuple(description["features"])
    if description["kind"] == "linear":
        return LinearReconstruction(
            features, tuple(description["mean"]), tuple(tuple(direction) for direction in description["components"])
        )
    return DenseReconstruction(features, description["width"], tuple(description["weights"]))


def fit_threshold(scored: DataFrame, score: str = "filter_score", percentile: float = ANOMALY_PERCENTILE) -> float | None:
    """Exact percentile of the training scores."""
    return exact_percentile(scored, score, percentile)


def above(threshold: float, score: str = "filter_score") -> Column:
    """Rebuilt worse than the threshold allows (strictly)."""
    return F.col(score) > F.lit(threshold)
