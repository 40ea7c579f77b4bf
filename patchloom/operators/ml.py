"""Scoring with a user's model and fitting the classifiers of all labels together."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchloom.functions.scalar import sigmoid

#: Steps that a search direction remembers.
MEMORY = 10
#: Largest gradient entry, over scaled features, at which a label is fitted.
SETTLED = 1e-6


class LabelModel(NamedTuple):
    """A fitted label: its score is the sigmoid of ``intercept`` plus the weighted features."""

    coefficients: list[float]
    intercept: float


def score(
    samples: DataFrame,
    model_fn: Callable[[pd.DataFrame], np.ndarray],
    n_labels: int,
    id_col: str = "sid",
    targets: str | None = None,
) -> DataFrame:
    """Apply ``model_fn`` (batch of samples -> logits ``[n, labels]``), then the sigmoid.

    The result is long: ``(id, k, score)`` with ``y`` when the array column
    ``targets`` is given.  Batches come through Arrow and the model is sent once
    per task inside the function.
    """
    id_type = dict(samples.dtypes)[id_col]
    keep = f", {targets} array<double>" if targets else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logits = np.asarray(model_fn(batch), dtype=float)
            if logits.shape != (len(batch), n_labels):
                raise ValueError(f"model gave {logits.shape} for {len(batch)} samples")
            e = np.exp(-np.abs(logits))
            p = np.where(logits >= 0, 1 / (1 + e), e / (1 + e))
            out = pd.DataFrame({id_col: batch[id_col], "scores": list(p)})
            if targets:
                out[targets] = batch[targets]
            yield out

    if targets:
        samples = samples.withColumn(targets, F.col(targets).cast("array<double>"))
    scored = samples.mapInPandas(run, f"{id_col} {id_type}, scores array<double>{keep}")
    long = scored.select(id_col, *([targets] if targets else []), F.posexplode("scores").alias("k", "score"))
    if targets:
        y = F.get(F.col(targets), F.col("k")).cast("int")
        long = long.select(id_col, "k", y.alias("y"), "score")
    return long


def chip_features(pixels: DataFrame, channels: Sequence[str], by: str = "patch_id") -> DataFrame:
    """Mean and deviation of every channel per patch, one row per patch."""
    v = F.col("v").cast("double")
    aggs = []
    for c in channels:
        one = F.when(F.col("image") == c, v)
        aggs += [F.avg(one).alias(f"{c}_mean"), F.stddev_pop(one).alias(f"{c}_std")]
    return pixels.groupBy(by).agg(*aggs)


def fit_multilabel(
    features: DataFrame,
    columns: Sequence[str],
    labels: Sequence[str],
    weights: Mapping[str, float] | None = None,
    max_iter: int = 200,
    reg: float = 0.01,
) -> dict[str, LabelModel]:
    """Logistic regressions of all labels at once; ``weights`` raise the weight of positives.

    Every pass over the table sums loss and gradient of all labels at their own
    trial points, so the number of passes (``max_iter`` at most) does not grow with
    the labels; write the features before. Labels x features numbers reach the
    driver per pass. The penalty is on the coefficients as they are, without
    scaling the features. Null or non-finite features or labels, and an empty
    table, raise.
    """
    columns, labels = list(columns), list(labels)
    data = features.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate([*columns, *labels])])
    spread = data.agg(
        F.count("*").alias("n"),
        *[f(f"f{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if not spread["n"]:
        raise ValueError("no rows to fit")
    mean, scale = (
        np.array([np.nan if (v := spread[f"{n}{i}"]) is None else v for i in range(len(columns))]) for n in "ms"
    )
    scale[scale == 0] = 1.0
    raised = np.array([float((weights or {}).get(label, 1.0)) for label in labels])
    searches = [_Search(len(columns) + 1) for _ in labels]
    for _ in range(max_iter):
        open_ = [k for k, s in enumerate(searches) if not s.done]
        if not open_:
            break
        points = np.array([searches[k].trial() for k in open_])
        total, loss, gradient = _pass(data, len(columns), open_, points, mean, scale, raised[open_])
        if not np.isfinite(loss).all():
            raise ValueError("features and labels to fit must be finite numbers")
        own = points[:, :-1] / scale
        loss = loss / total + reg / 2 * (own**2).sum(axis=1)
        gradient = gradient / total[:, None]
        gradient[:, :-1] += reg * own / scale
        for k, f, g in zip(open_, loss, gradient):
            searches[k].tell(float(f), g)
    found = {}
    for label, search in zip(labels, searches):
        own = search.x[:-1] / scale
        found[label] = LabelModel([float(v) for v in own], float(search.x[-1] - own @ mean))
    return found


def _pass(
    data: DataFrame, d: int, labels: list[int], points: np.ndarray, mean: np.ndarray, scale: np.ndarray, raised: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, loss and gradient of every label in ``labels``, each summed over all rows.

    Tasks add up their batches; their sums are added per entry before the driver sees them.
    """
    width = d + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(labels), width))
        for batch in batches:
            rows = [np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in batch.columns]
            x = (np.column_stack(rows[:d]) - mean) / scale if d else np.zeros((batch.num_rows, 0))
            y = np.column_stack([rows[d + k] for k in labels])
            z = x @ points[:, :-1].T + points[:, -1]
            w = np.where(y > 0, raised, 1.0)
            sums[:, 0] += w.sum(axis=0)
            sums[:, 1] += (w * (np.logaddexp(0, z) - np.where(y > 0, z, 0.0) + 0 * y)).sum(axis=0)
            off = w * (np.exp(-np.logaddexp(0, -z)) - (y > 0))
            sums[:, 2:-1] += off.T @ x
            sums[:, -1] += off.sum(axis=0)
        place = np.arange(sums.size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel())], ["i", "v"])

    sums = np.zeros(len(labels) * width)
    for i, v in data.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        sums[i] = v
    sums = sums.reshape(len(labels), width)
    return sums[:, 0], sums[:, 1], sums[:, 2:]


class _Search:
    """Quasi-Newton descent of one label, asked for a trial point and told its value."""

    def __init__(self, n: int):
        self.x, self.step, self.done = np.zeros(n), 1.0, False
        self.value, self.gradient, self.direction = None, None, np.zeros(n)
        self.moves: list[tuple[np.ndarray, np.ndarray]] = []

    def trial(self) -> np.ndarray:
        return self.x + self.step * self.direction

    def tell(self, value: float, gradient: np.ndarray) -> None:
        if self.value is not None:
            slope = float(self.gradient @ self.direction)
            if value > self.value + 1e-4 * self.step * slope + 1e-13 * abs(self.value):
                self.step /= 2
                self.done = self.step < 1e-12
                return
            moved, turned = self.step * self.direction, gradient - self.gradient
            if moved @ turned > 1e-12 * (turned @ turned):
                self.moves = [*self.moves, (moved, turned)][-MEMORY:]
            self.x = self.x + moved
        self.value, self.gradient = value, gradient
        self.done = float(np.abs(gradient).max()) <= SETTLED
        self.direction, self.step = -self._curved(gradient), 1.0
        if not self.moves:
            self.step = 1 / max(1.0, float(np.linalg.norm(gradient)))

    def _curved(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the inverse curvature that the remembered moves tell."""
        out, shares = gradient.copy(), []
        for moved, turned in reversed(self.moves):
            share = (moved @ out) / (moved @ turned)
            shares.append(share)
            out -= share * turned
        if self.moves:
            moved, turned = self.moves[-1]
            out *= (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(self.moves, reversed(shares)):
            out += (share - (turned @ out) / (moved @ turned)) * moved
        return out


def fit_report(
    models: Mapping[str, LabelModel],
    features: DataFrame,
    columns: Sequence[str],
    id_col: str,
    weights: Mapping[str, float] | None = None,
    reg: float = 0.01,
) -> DataFrame:
    """Per label: rows, positives, weighted log loss of the model and of a constant, largest gradient entry.

    The gradient is that of the penalised loss at the fitted coefficients, near
    zero if the fit has settled.
    """
    scores = predict_multilabel(models, features, columns, id_col)
    rows = scores.join(features.select(id_col, *columns), id_col)
    w = F.lit(1.0)
    for k, label in enumerate(models):
        w = F.when((F.col("k") == k) & (F.col("y") > 0), float((weights or {}).get(label, 1.0))).otherwise(w)
    rows = rows.withColumn("w", w)
    miss = F.when(F.col("y") > 0, F.log("score")).otherwise(F.log1p(-F.col("score")))
    off = F.col("w") * (F.col("score") - F.col("y"))
    sums = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.sum("y").alias("targets"), F.sum("w").alias("weight"),
        F.sum(F.when(F.col("y") > 0, F.col("w")).otherwise(0.0)).alias("positive"),
        (-F.sum(F.col("w") * miss) / F.sum("w")).alias("loss"), F.sum(off).alias("g"),
        *[F.sum(off * F.col(c)).alias(f"g{i}") for i, c in enumerate(columns)],
    )
    p = F.col("positive") / F.col("weight")
    constant = -(p * F.log(p) + (1 - p) * F.log1p(-p))
    steps = [F.abs(F.col("g") / F.col("weight"))]
    for i in range(len(columns)):
        own = F.lit(0.0)
        for k, model in enumerate(models.values()):
            own = F.when(F.col("k") == k, float(model.coefficients[i])).otherwise(own)
        steps.append(F.abs(F.col(f"g{i}") / F.col("weight") + reg * own))
    return sums.select(
        "k", "n", "targets", "loss", constant.alias("constant_loss"), F.greatest(*steps).alias("gradient")
    )


def predict_multilabel(
    models: Mapping[str, LabelModel], features: DataFrame, columns: Sequence[str], id_col: str, labels: bool = True
) -> DataFrame:
    """Long scores ``(id, k, y, score)`` of fitted models, in one pass over the features.

    All models' probabilities are columns of the same row, so the table is read
    once however many labels there are.
    """
    entries = []
    for i, (label, model) in enumerate(models.items()):
        z = F.lit(model.intercept)
        for c, a in zip(columns, model.coefficients):
            z = z + F.col(c) * a
        y = [F.col(label).cast("int").alias("y")] if labels else []
        entries.append(F.struct(F.lit(i).alias("k"), *y, sigmoid(z).alias("score")))
    return features.select(id_col, F.explode(F.array(*entries)).alias("e")).select(id_col, "e.*")
