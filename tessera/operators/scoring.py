"""Scorers of line starts, and operators on series of scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chars import NAMES, schema_digest

#: A rule of thumb, not a trained model: log-odds of a new unit for each feature of a line.
WEIGHTS = {
    "line_hash": 3.0, "line_qword": 1.2, "line_ends_q": 1.6, "line_legal": 2.2, "line_enum": 1.2, "line_bold_field": 1.5, "line_field": 0.9,
    "line_after_blank": 1.6, "line_speaker": 0.8, "line_title": 0.3, "line_bullet": -0.4, "line_colon": 0.5, "prev_line_ends_sent": 0.4,
    "prev_line_ends_open": -1.5, "in_code": -4.0, "line_table_row": -2.5, "line_blank_run": 0.8, "line_idx_frac": 0.1,
}
BIAS = -1.6
DEFAULT_STEPS = (0.5, 0.35, 0.25)


@dataclass(frozen=True)
class LinearScorer:
    """A sigmoid of a weighted sum of line features: DataFrame functions only."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    bias: float = BIAS

    def score(self, lines: DataFrame) -> DataFrame:
        kinds = dict(lines.dtypes)
        total: Column = F.lit(self.bias)
        for name, w in self.weights.items():
            value = F.col(name).cast("int") if kinds[name] == "boolean" else F.col(name)
            total = total + F.lit(w) * value
        return lines.withColumn("score", 1 / (1 + F.exp(-total)))


def owner(df: DataFrame) -> str:
    """The column that tells a document: doc_row where rows are numbered, else doc_id."""
    return "doc_row" if "doc_row" in df.columns else "doc_id"


@dataclass(frozen=True)
class MlpScorer:
    """A ReLU network with sigmoid ends over the features in `names`, the user's weights W1, b1, W2, ... in an npz file.

    context: the features of so many lines before and after are put before and behind a line's own. Scored in Arrow
    batches. The weights are broadcast; their size is the file's, whatever the input.
    """

    path: str
    names: tuple[str, ...]
    schema: str | None = None
    context: int = 0

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        with np.load(self.path) as z:
            if self.schema is not None and "SCHEMA" in z and str(z["SCHEMA"]) != self.schema:
                raise ValueError(f"feature schema {z['SCHEMA']} of the weights isn't {self.schema}")
            out, k = [], 1
            while f"W{k}" in z:
                out.append((z[f"W{k}"].T.astype(np.float32), z[f"b{k}"].astype(np.float32)))
                k += 1
        need = len(self.names) * (2 * self.context + 1)
        if not out or out[0][0].shape[0] != need:
            raise ValueError(f"feature schema: the weights take {out[0][0].shape[0] if out else 0} features, not {need}")
        return out

    def outputs(self, df: DataFrame) -> DataFrame:
        """df with `outputs`, the network's ends for each row."""
        held = df.sparkSession.sparkContext.broadcast(self.layers())

        @F.pandas_udf("array<double>")
        def forward(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            h = np.stack(x.to_numpy()).astype(np.float32)
            *inner, last = held.value
            for w, b in inner:
                h = np.maximum(h @ w + b, 0)
            z = np.clip(h @ last[0] + last[1], -30, 30).astype(np.float64)
            return pd.Series(list(1 / (1 + np.exp(-z))))

        if self.context:
            return context_stack(df, list(self.names), self.context).withColumn("outputs", forward("stack")).drop("stack")
        return df.withColumn("outputs", forward(F.array(*(F.col(n).cast("float") for n in self.names))))

    def score(self, lines: DataFrame) -> DataFrame:
        return self.outputs(lines).withColumn("score", F.get("outputs", F.lit(0))).drop("outputs")


def published(path: str) -> MlpScorer:
    """The scorer for weights made for all of chars.NAMES: of a character, or of a line with as many lines beside it as the
    first layer takes."""
    with np.load(path) as z:
        width = z["W1"].shape[1]
    if width % len(NAMES) or width // len(NAMES) % 2 == 0:
        raise ValueError(f"feature schema: the weights take {width} features, no odd multiple of {len(NAMES)}")
    return MlpScorer(path, NAMES, schema_digest(), width // len(NAMES) // 2)


def save_weights(path: str, layers: list[tuple[np.ndarray, np.ndarray]], schema: str | None = None, **more: object) -> None:
    """Layers (weights of inputs x outputs, biases) as W1, b1, ... in an npz file, with the digest of the features."""
    arrays = {f"{n}{k}": a for k, (w, b) in enumerate(layers, 1) for n, a in (("W", np.asarray(w, np.float32).T), ("b", np.asarray(b, np.float32)))}
    np.savez(path, **arrays, SCHEMA=schema or schema_digest(), F=layers[0][0].shape[0], **more)


def blend(line: Column, char: Column, share: float) -> Column:
    return (1 - share) * line + share * char


def flagged(scores: DataFrame, threshold: float = 0.5, steps: tuple[float, ...] = DEFAULT_STEPS, min_lines: int = 3) -> DataFrame:
    """scores(line_no, start, seg, score, ...) with `used`, the document's threshold, and `candidate`: whether a line that
    isn't empty reaches it. A document of more than min_lines such lines without any at `threshold` takes the first lower
    step that has one."""
    w = Window.partitionBy(owner(scores))
    full = F.col("seg") != ""
    df = scores.withColumns({"_n": F.count_if(full).over(w), "_top": F.max(F.when(full, F.col("score"))).over(w)})
    lower = F.coalesce(*(F.when(F.col("_top") >= t, F.lit(t)) for t in steps), F.lit(threshold))
    df = df.withColumn("used", F.when(F.col("_top") >= threshold, F.lit(threshold)).when(F.col("_n") > min_lines, lower).otherwise(threshold))
    return df.withColumn("candidate", full & (F.col("score") >= F.col("used"))).drop("_n", "_top")


def candidates(scores: DataFrame, threshold: float = 0.5, steps: tuple[float, ...] = DEFAULT_STEPS, min_lines: int = 3) -> DataFrame:
    """The lines that flagged() marks."""
    return flagged(scores, threshold, steps, min_lines).where("candidate").drop("candidate")


def local_maxima(scores: DataFrame, threshold: float, window: int = 3) -> DataFrame:
    """scores(doc_id, pos, score): positions at or above the threshold that no one within the window exceeds and that rise
    above the position before."""
    w = Window.partitionBy(owner(scores)).orderBy("pos")
    df = scores.withColumns({"_top": F.max("score").over(w.rowsBetween(-window, window)), "_before": F.lag("score").over(w)})
    return df.where((F.col("score") >= threshold) & (F.col("score") == F.col("_top")) & (F.col("_before").isNull() | (F.col("score") > F.col("_before")))).drop("_top", "_before")


def plateau_peaks(logp: DataFrame, floor: float = -90.0, window: int = 3, drop: float = 3.0) -> DataFrame:
    """logp(doc_id, pos, score): the last position of each top that is above the floor, highest within the window, and
    within `drop` of the document's highest top."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    df = logp.withColumns({"_next": F.lead("score").over(w), "_top": F.max("score").over(w.rowsBetween(-window, window))})
    df = df.where((F.col("score") > floor) & (F.col("score") == F.col("_top")) & (F.col("_next").isNull() | (F.col("score") > F.col("_next"))))
    best = F.max("score").over(Window.partitionBy("doc_id"))
    return df.withColumn("_best", best).where(F.col("score") >= F.col("_best") - drop).select("doc_id", "pos", "score")


def context_stack(lines: DataFrame, names: list[str], reach: int) -> DataFrame:
    """lines with `stack`: the features of the lines from -reach to reach, zeros beyond the document."""
    zero = F.array(*[F.lit(0.0)] * len(names))
    own = F.array(*(F.col(n).cast("double") for n in names))
    df = lines.withColumn("_own", own)
    w = Window.partitionBy(owner(df)).orderBy("line_no")
    parts = [F.lag("_own", -r, None).over(w) for r in range(-reach, reach + 1)]
    return df.withColumn("stack", F.concat(*(F.coalesce(p, zero) for p in parts))).drop("_own")
