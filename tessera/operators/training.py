"""Training of networks over features: minibatch gradients by partition, summed as a tree on the executors, AdamW on the driver.

The rows lie in a table in as many folders as an epoch has steps, dealt at random, so a step reads its own rows only. The
driver holds the weights and sums of gradients, whose size is the network's, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import NAMES, line_starts, matrix
from .labels import line_labels
from .lines import features as line_features
from .scoring import save_weights

Layers = list[tuple[np.ndarray, np.ndarray]]
#: Bins of scores between which a threshold is chosen.
BINS = 400


def fresh(sizes: tuple[int, ...], seed: int = 0) -> Layers:
    """Layers with random weights; sizes: of the input, of each inner layer, and of the output."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, math.sqrt(2 / a), (a, b)).astype(np.float32), np.zeros(b, np.float32)) for a, b in zip(sizes, sizes[1:])]


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The input of each layer, and the scores."""
    held = [x]
    for w, b in layers[:-1]:
        held.append(np.maximum(held[-1] @ w + b, 0))
    w, b = layers[-1]
    return [*held, 1 / (1 + np.exp(-np.clip(held[-1] @ w + b, -30, 30)))]


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, float, float]:
    """The sum over rows of the gradient of the weighted cross entropy, flat, the sum of the losses, and of the weights."""
    *held, p = forward(layers, x)
    p, y = p.astype(np.float64), y.reshape(len(x), -1)
    w = np.where(y > 0, weight, 1.0)
    loss = float(-(w * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
    delta, out = (w * (p - y)).astype(np.float32), []
    for (m, _), h in zip(layers[::-1], held[::-1]):
        out += [delta.sum(0), (h.T @ delta).ravel()]
        delta = (delta @ m.T) * (h > 0)
    return np.concatenate(out[::-1]).astype(np.float64), loss, float(w.sum())


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([x for w, b in layers for x in (w.ravel(), b)]).astype(np.float64)


def shaped(values: np.ndarray, layers: Layers) -> Layers:
    out, at = [], 0
    for w, b in layers:
        out.append((values[at : at + w.size].reshape(w.shape).astype(np.float32), values[at + w.size : at + w.size + b.size].astype(np.float32)))
        at += w.size + b.size
    return out


@dataclass
class AdamW:
    rate: float = 2e-3
    decay: float = 1e-3
    first: float = 0.9
    second: float = 0.999
    step: int = 0
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0

    def __call__(self, values: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m = self.first * self.m + (1 - self.first) * slope
        self.v = self.second * self.v + (1 - self.second) * slope**2
        m, v = self.m / (1 - self.first**self.step), self.v / (1 - self.second**self.step)
        return values - self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay * values)


def summed(spark: SparkSession, rows: DataFrame, layers: Layers, weight: float) -> tuple[np.ndarray, float]:
    """The mean gradient and loss over rows(x array<float>, y). Each partition sums its own; where these are many, some tasks
    sum the sums, so the driver gets few, however many rows and partitions there are."""
    held = spark.sparkContext.broadcast(layers)
    size = sum(w.size + b.size for w, b in layers)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float32)
                g, loss, n = gradient(held.value, x, b.column("y").to_numpy(zero_copy_only=False), weight)
                total += np.concatenate((g, (loss, n)))
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            for g in b.column("g").to_pylist():
                total += np.frombuffer(g)
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x", "y").mapInArrow(own, "g binary")
    n = rows.rdd.getNumPartitions()
    while n > 32:
        n = math.ceil(math.sqrt(n))
        parts = parts.repartition(n).mapInArrow(more, "g binary")
    total = sum((np.frombuffer(r["g"]) for r in parts.collect()), np.zeros(size + 2))
    held.destroy()
    return total[:-2] / max(total[-1], 1.0), total[-2] / max(total[-1], 1.0)


def dealt(rows: DataFrame, folder: str, steps: int, seed: int = 0) -> None:
    """rows(x, y) in a table of `steps` folders, dealt at random."""
    rows.withColumn("batch", F.least(F.floor(F.rand(seed) * steps), F.lit(steps - 1)).cast("int")).write.mode("overwrite").partitionBy("batch").parquet(folder)


@dataclass
class Trained:
    layers: Layers
    losses: list[float] = field(default_factory=list)
    threshold: float = 0.5
    f1: float = 0.0

    def save(self, path: str) -> None:
        save_weights(path, self.layers, threshold=self.threshold)


def f1_by_threshold(scores: DataFrame, bins: int = BINS) -> tuple[float, float]:
    """scores(score, y): the threshold with the best F1, the lowest of ties, and that F1; from counts in bins of scores."""
    rows = scores.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count_if(F.col("y") > 0).alias("hit"), F.count(F.lit(1)).alias("n")).collect()
    hit, n = np.zeros(bins), np.zeros(bins)
    for r in rows:
        hit[int(r["bin"])], n[int(r["bin"])] = r["hit"], r["n"]
    tp, taken = hit[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
    f1 = 2 * tp / np.maximum(taken + hit.sum(), 1)
    best = int(f1.argmax())
    return best / bins, float(f1[best])


def network_scores(spark: SparkSession, rows: DataFrame, layers: Layers) -> DataFrame:
    """rows(x, y) as (score, y)."""
    held = spark.sparkContext.broadcast(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(forward(held.value, x)[-1][:, 0].astype(np.float64)), b.column("y")], ["score", "y"])

    return rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, "score double, y double")


def train(spark: SparkSession, rows: DataFrame, held_out: DataFrame, folder: str, inner: tuple[int, ...] = (64, 32), epochs: int = 8, steps: int = 4, weight: float = 4.0, rate: float = 4e-3, seed: int = 0) -> Trained:
    """rows and held_out(x array<float>, y 0/1): a network with layers of `inner` neurons, positives weighing `weight`, trained for
    `epochs` times `steps` steps over the table written to `folder`, which all executors share. After each epoch the threshold
    with the best F1 on held_out is found; the weights and the threshold of the best epoch stay."""
    dealt(rows, folder, steps, seed)
    table = spark.read.schema("x array<float>, y double, batch int").parquet(folder)
    width = table.select(F.size("x").alias("n")).first()
    if width is None:
        raise ValueError("no rows to train on")
    layers = fresh((width["n"], *inner, 1), seed)
    best, optimiser, losses = Trained(layers, f1=-1.0), AdamW(rate), []
    for _ in range(epochs):
        for k in range(steps):
            slope, loss = summed(spark, table.where(F.col("batch") == k), layers, weight)
            layers = shaped(optimiser(flat(layers), slope), layers)
            losses.append(loss)
        threshold, f1 = f1_by_threshold(network_scores(spark, held_out, layers))
        if f1 > best.f1:
            best = Trained(layers, losses, threshold, f1)
    best.losses = losses
    return best


def line_rows(docs: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs(doc_id, text, boundaries): (doc_id, start, x, y) of each line that isn't empty, of documents of two or more: the
    features of its first character, and whether a unit starts there."""
    marks = docs.select("doc_id", F.explode("boundaries").alias("pos"))
    rows = line_labels(line_starts(line_features(docs.select("doc_id", "text"))), marks)
    return rows.select("doc_id", "start", matrix(rows, names).alias("x"), F.col("label").cast("double").alias("y"))
