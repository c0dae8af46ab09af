"""A feed-forward network of rectified units with one sigmoid output, trained on mini-batches.

Rows are placed in a random order once and written by place; a batch is a stretch of places. Steps follow
each other, and small batches give a cluster nothing to share: a task therefore reads a block of batches of bounded
size, steps along all of them and hands on the weights. Of batches larger than a block the weights are broadcast
for each step, every task sums the gradient over its Arrow batches, and the sums meet on the driver, which
are as large as the weights.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ledgerlens.operators.ranking import shuffled_positions
from ledgerlens.session import Scratch
from ledgerlens.shipping import ship_code

# Sums of gradients that the driver adds up; more tasks than this are summed up in so many first.
FAN_IN = 32
SUMS = "n bigint, loss double, gradient array<double>"
# Values of the rows that one task steps along, in bytes.
BLOCK_BYTES = 64 << 20
# Rows that are scored together when values are swapped.
SWAPPED_ROWS = 1024


@dataclass(frozen=True)
class Network:
    """``weights`` holds, layer by layer, the matrix (inputs x units) and the offsets of the units."""

    layers: tuple[int, ...]
    weights: np.ndarray

    @classmethod
    def fresh(cls, layers: Sequence[int], seed: int) -> Network:
        """Uniform weights whose variance keeps that of rectified signals, no offsets."""
        rng = np.random.default_rng(seed)
        parts = []
        for inputs, units in zip(layers, layers[1:]):
            limit = np.sqrt(6.0 / inputs)
            parts += [rng.uniform(-limit, limit, inputs * units), np.zeros(units)]
        return cls(tuple(layers), np.concatenate(parts))

    def getLayers(self) -> list[int]:
        return list(self.layers)

    def _parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        parts, at = [], 0
        for inputs, units in zip(self.layers, self.layers[1:]):
            matrix = self.weights[at:at + inputs * units].reshape(inputs, units)
            at += inputs * units
            parts.append((matrix, self.weights[at:at + units]))
            at += units
        return parts

    def _signals(self, x: np.ndarray) -> list[np.ndarray]:
        """What enters each layer, and the output before its sigmoid."""
        signals = [x]
        parts = self._parts()
        for number, (matrix, offset) in enumerate(parts):
            out = signals[-1] @ matrix + offset
            signals.append(np.maximum(out, 0.0) if number < len(parts) - 1 else out)
        return signals

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._signals(x)[-1][:, 0])

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums of the cross entropy and of its gradient over the rows."""
        signals = self._signals(x)
        out = signals[-1][:, 0]
        loss = float(np.sum(np.logaddexp(0.0, out) - y * out))
        back = (_sigmoid(out) - y)[:, None]
        pieces: list[np.ndarray] = []
        for (matrix, _), signal in zip(reversed(self._parts()), reversed(signals[:-1])):
            pieces += [back.sum(axis=0), (signal.T @ back).ravel()]
            back = (back @ matrix.T) * (signal > 0)
        return loss, np.concatenate(pieces[::-1])

    def right_when_swapped(self, pairs: DataFrame) -> DataFrame:
        """Rows (j, n, right) of each task: rows (label, x) rightly classed with value ``j`` taken from ``other``.

        All features are swapped where the row is; only counts leave the task.
        """
        ship_code(pairs.sparkSession)
        network = pairs.sparkSession.sparkContext.broadcast(self)
        width = self.layers[0]

        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, right = 0, np.zeros(width, np.int64)
            for batch in batches:
                for begin in range(0, batch.num_rows, SWAPPED_ROWS):
                    part = batch.slice(begin, SWAPPED_ROWS)
                    y = part.column(0).to_numpy(zero_copy_only=False)
                    x, other = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) for i in (1, 2))
                    n += len(y)
                    for j in range(width):
                        swapped = x.copy()
                        swapped[:, j] = other[:, j]
                        right[j] += np.count_nonzero(np.rint(network.value.probabilities(swapped)) == y)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(right)], ["j", "n", "right"])

        return pairs.select("label", "x", "other").mapInArrow(per_task, "j int, n bigint, right bigint")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (of both classes) and ``prediction`` to rows with ``features``."""
        ship_code(df.sparkSession)
        network = df.sparkSession.sparkContext.broadcast(self)

        @pandas_udf("double")
        def probability(x):
            return _series(network.value, x)

        scored = df.withColumn("of_one", probability(vector_to_array("features")))
        one = F.col("of_one")
        return scored.withColumns({
            "probability": array_to_vector(F.array(1 - one, one)),
            "prediction": F.bround(one).cast("double")}).drop("of_one")


def _series(network: Network, x):
    import pandas as pd
    return pd.Series(network.probabilities(np.stack(x)) if len(x) else np.empty(0))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _sums(rows: list[tuple[int, float, np.ndarray]]) -> pa.RecordBatch:
    n, loss, gradient = (sum(column) for column in zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([float(loss)]), pa.array([gradient], pa.list_(pa.float64()))],
        ["n", "loss", "gradient"])


def gradient_of(network: Network, rows: DataFrame) -> tuple[int, float, np.ndarray]:
    """Rows, and the sums of loss and gradient over ``rows`` (label, x)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(network)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                loss, gradient = shared.value.loss_and_gradient(x, y)
                held = (len(y), loss, gradient) if held is None else (
                    held[0] + len(y), held[1] + loss, held[2] + gradient)
        if held is not None:
            yield _sums([held])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [(n, loss, np.array(gradient)) for batch in batches for n, loss, gradient in zip(
            *[batch.column(i).to_pylist() for i in range(3)])]
        if some:
            yield _sums(some)

    sums = rows.select("label", "x").mapInArrow(per_task, SUMS)
    if rows.rdd.getNumPartitions() > FAN_IN:
        sums = sums.repartition(FAN_IN).mapInArrow(together, SUMS)
    # At most FAN_IN rows, each as large as the weights.
    found = sums.collect()
    shared.destroy()
    if not found:
        return 0, 0.0, np.zeros_like(network.weights)
    return (sum(r.n for r in found), sum(r.loss for r in found), sum(np.array(r.gradient) for r in found))


def _step(network: Network, speed: np.ndarray, gradient: np.ndarray, step: float, momentum: float) -> tuple[Network, np.ndarray]:
    speed = momentum * speed - step * gradient
    return Network(network.layers, network.weights + speed), speed


def stepped(network: Network, speed: np.ndarray, rows: DataFrame, begins: Sequence[int], batch: int, step: float,
            momentum: float) -> tuple[Network, np.ndarray]:
    """The network and its speed after a step for each batch of a block ``rows`` (position, label, x), by one task.

    ``begins`` are the places in the block at which the batches begin, in the order of the steps.
    """
    shared = rows.sparkSession.sparkContext.broadcast((network, speed))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False),
                 b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                for b in batches if b.num_rows]
        position, y, x = (np.concatenate(column) for column in zip(*held))
        placed = np.argsort(position)
        now, speed = shared.value
        for begin in begins:
            at = placed[begin:begin + batch]
            _, gradient = now.loss_and_gradient(x[at], y[at])
            now, speed = _step(now, speed, gradient / len(at), step, momentum)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.list_(pa.float64())) for v in (now.weights, speed)], ["weights", "speed"])

    # One row, as large as the weights.
    (after,) = rows.select("position", "label", "x").coalesce(1).mapInArrow(
        per_task, "weights array<double>, speed array<double>").collect()
    shared.destroy()
    return Network(network.layers, np.array(after.weights)), np.array(after.speed)


def fit(rows: DataFrame, layers: Sequence[int], epochs: int, batch: int, step: float, momentum: float, seed: int) -> Network:
    """Descend along the mean gradient of one batch after the other.

    ``rows`` have ``id``, ``label`` and ``x``. Batches hold the same rows in every epoch; the order of the blocks and
    that of the batches in each change.
    """
    ship_code(rows.sparkSession)
    network = Network.fresh(layers, seed)
    with Scratch(rows.sparkSession) as scratch:
        n = rows.count()
        placed = shuffled_positions(rows, "id", seed, n).select("position", "label", "x")
        numbers = range(-(-n // batch))
        in_block = BLOCK_BYTES // (8 * layers[0] * batch)
        blocks = [list(numbers[i:i + max(1, in_block)]) for i in range(0, len(numbers), max(1, in_block))]
        files = max(1, len(blocks) if in_block else min(rows.rdd.getNumPartitions(), len(numbers)))
        stored = scratch.keep(placed.repartitionByRange(files, "position").sortWithinPartitions("position"), "batches")
        speed = np.zeros_like(network.weights)
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(blocks)
            for block in blocks:
                first = min(block)
                some = stored.where(F.col("position").between(first * batch, (max(block) + 1) * batch - 1))
                order.shuffle(block)
                if in_block:
                    begins = [(number - first) * batch for number in block]
                    network, speed = stepped(network, speed, some, begins, batch, step, momentum)
                else:
                    seen, _, gradient = gradient_of(network, some)
                    network, speed = _step(network, speed, gradient / max(seen, 1), step, momentum)
    return network
