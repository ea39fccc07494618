"""Many small logistic models fitted together: all cohorts, folds and settings in one loop of aggregates.

Every model is an L2-penalised logistic regression with its own rows: a cohort's, but for one fold. Each step is one pass
over the rows: a task adds up, for every model that is still moving, loss, gradient and Hessian of its rows; tasks' sums are
added by model, and the driver takes one Newton step for each (halved where the objective rose). So the number of passes is
that of Newton steps, about ten, however many models there are, and results are those of ``pyspark.ml``'s
LogisticRegression with the same ``regParam`` (standardised penalty, free intercept).

The driver and the tasks hold the models: their number times the square of the number of features, which has a limit.

Cases: rows with a null label, feature array or part are left out; a cohort whose training rows are of one class gets the score of
that class; a model without training rows gives no scores; features without variation weigh nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import metrics

#: Numbers of all models' Hessians together; beyond it their cohorts have to be fitted in several calls.
MOST_NUMBERS = 50_000_000
STEPS = 40
TOLERANCE = 1e-9
#: Fold of a model that is fitted on all rows.
ALL = -1


def _summed(rows: DataFrame, add: Callable[[dict, pa.RecordBatch], None]) -> dict[str, np.ndarray]:
    """Arrays by key: add adds a batch's to those of its task; tasks' arrays are added by key."""

    def packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["key", "sums"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(sums, batch)
        yield packed(sums)

    def of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, values in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(values, float)
                sums[key] = sums[key] + own if key in sums else own
        yield packed(sums)

    parts = rows.mapInArrow(of_task, "key string, sums binary").repartition("key").mapInArrow(of_key, "key string, sums binary")
    return {r["key"]: np.frombuffer(r["sums"], float) for r in parts.collect()}


def _read(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(features with a one, labels, cohorts, parts) of rows (cohort, features, label, part)."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
    return np.column_stack([x, np.ones(len(x))]), batch.column(2).to_numpy().astype(float), np.array(batch.column(0).to_pylist(), object), batch.column(3).to_numpy()


@dataclass
class Model:
    """weights: of the standardised features, and the intercept. steps: objective and validation loss after each."""

    cohort: str
    fold: int
    setting: int
    penalty: float
    scale: np.ndarray
    n: float
    weights: np.ndarray
    before: np.ndarray | None = None
    value: float = np.inf
    done: bool = False
    validation: list[float] = field(default_factory=list)

    @property
    def key(self) -> str:
        return f"{self.fold}/{self.setting}/{self.cohort}"

    def raw(self) -> np.ndarray:
        """Weights of the features as they are, and the intercept."""
        return self.weights * np.append(np.where(self.scale > 0, 1 / np.where(self.scale > 0, self.scale, 1), 0), 1)

    def step(self, sums: np.ndarray) -> None:
        """A Newton step from (loss, validation loss, validation rows, gradient, Hessian's upper triangle)."""
        d = len(self.weights)
        free = np.append(np.where(self.scale > 0, self.penalty, 0.0), 0.0)
        value = sums[0] / self.n + 0.5 * (free * self.weights**2).sum()
        if self.before is not None and value > self.value + 1e-12 * abs(self.value):
            self.weights = (self.weights + self.before) / 2
            self.done = np.abs(self.weights - self.before).max() < TOLERANCE
            return
        self.value = value
        self.validation.append(sums[1] / sums[2] if sums[2] else np.nan)
        use = np.append(np.where(self.scale > 0, 1 / np.where(self.scale > 0, self.scale, 1), 0), 1)
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = sums[3 + d :]
        h = (h + np.triu(h, 1).T) * np.outer(use, use) / self.n + np.diag(free + np.append(self.scale == 0, False) + 1e-12)
        move = np.linalg.solve(h, sums[3 : 3 + d] * use / self.n + free * self.weights)
        self.before, self.weights = self.weights, self.weights - move
        self.done = bool(np.abs(move).max() < TOLERANCE)


@dataclass
class Fitted:
    models: list[Model]
    size: int
    passes: int


def _losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - y * margin


def fit(rows: DataFrame, penalties: list[float], folds: list[int], steps: int = STEPS, limits: dict[str, int] | None = None) -> Fitted:
    """Models of every cohort, fold and penalty: on the cohort's rows of all parts but the fold (ALL: of all parts).

    rows: (cohort, features array, label, part). limits: at most so many steps for some cohorts.
    """
    own = rows.select(F.col("cohort").cast("string").alias("cohort"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"), F.col("part").cast("int").alias("part")).dropna()
    first = own.select(F.size("features").alias("n")).first()
    if first is None:
        return Fitted([], 0, 0)
    size = first["n"]

    def moments(sums: dict, batch: pa.RecordBatch) -> None:
        x, y, cohort, part = _read(batch, size)
        for c in set(cohort):
            for p in np.unique(part[cohort == c]):
                at = (cohort == c) & (part == p)
                key = f"{p}/{c}"
                found = np.concatenate([[at.sum(), y[at].sum()], x[at, :-1].sum(axis=0), (x[at, :-1] ** 2).sum(axis=0)])
                sums[key] = sums[key] + found if key in sums else found

    of_part = {(int(k.split("/", 1)[0]), k.split("/", 1)[1]): v for k, v in _summed(own, moments).items()}
    models = []
    for c in sorted({c for _, c in of_part}):
        for fold in folds:
            parts = [v for (p, own_c), v in of_part.items() if own_c == c and p != fold]
            if not parts:
                continue
            n, positive, *rest = np.sum(parts, axis=0)
            one, two = np.array(rest[:size]), np.array(rest[size:])
            spread = np.maximum(0, two - one**2 / n) / max(1, n - 1)
            scale = np.where(spread > 1e-12 * np.maximum(1e-300, two / n), np.sqrt(spread), 0.0)
            for setting, penalty in enumerate(penalties):
                odds = np.log(positive / (n - positive)) if 0 < positive < n else np.inf if positive else -np.inf
                model = Model(c, fold, setting, penalty, scale, n, np.append(np.zeros(size), np.clip(odds, -1000, 1000)))
                model.done = not 0 < positive < n
                models.append(model)
    if len(models) * (size + 2) ** 2 / 2 > MOST_NUMBERS:
        raise ValueError(f"{len(models)} models of {size} features are too many for one call: fit fewer cohorts at a time")
    spark, upper, passes = rows.sparkSession, np.triu_indices(size + 1), 0
    limit = lambda m: min(steps, (limits or {}).get(m.cohort, steps))
    while active := [m for m in models if not m.done and len(m.validation) < limit(m)]:
        by_cohort: dict[str, list[tuple[str, int, np.ndarray]]] = {}
        for m in active:
            by_cohort.setdefault(m.cohort, []).append((m.key, m.fold, m.raw()))
        shared = spark.sparkContext.broadcast(by_cohort)

        def curves(sums: dict, batch: pa.RecordBatch) -> None:
            x, y, cohort, part = _read(batch, size)
            for c in set(cohort) & shared.value.keys():
                at = cohort == c
                mine, labels, parts = x[at], y[at], part[at]
                margins = mine @ np.array([w for *_, w in shared.value[c]]).T
                for (key, fold, _), margin in zip(shared.value[c], margins.T):
                    out = parts == fold
                    loss = _losses(margin, labels)
                    p = 0.5 * (1 + np.tanh(0.5 * margin))
                    inside = np.where(out, 0.0, 1.0)
                    gradient = mine.T @ (inside * (p - labels))
                    hessian = (mine * (inside * p * (1 - p))[:, None]).T @ mine
                    found = np.concatenate([[(inside * loss).sum(), loss[out].sum(), out.sum()], gradient, hessian[upper]])
                    sums[key] = sums[key] + found if key in sums else found

        sums = _summed(own, curves)
        passes += 1
        for m in active:
            m.step(sums[m.key])
        shared.destroy()
    return Fitted(models, size, passes)


def score(rows: DataFrame, fitted: Fitted, key: str = "series", fold: int | None = None) -> DataFrame:
    """(cohort, key, label, fold, combination, score): each row by its cohort's models of one fold, or (fold None) by those
    that have left out the row's part. rows: (cohort, key, features, label, part)."""
    models: dict[tuple[str, int], list[tuple[int, np.ndarray]]] = {}
    for m in fitted.models:
        models.setdefault((m.cohort, m.fold), []).append((m.setting, m.raw()))
    shared = rows.sparkSession.sparkContext.broadcast(models)
    size = fitted.size
    kind = rows.schema[key].dataType.simpleString()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not size:
                continue
            x, _, cohort, part = _read(batch, size)
            for c, f in sorted({(c, int(p) if fold is None else fold) for c, p in zip(cohort, part)}):
                at = np.flatnonzero((cohort == c) & (part == f if fold is None else True))
                for setting, w in shared.value.get((c, f), []):
                    found = 0.5 * (1 + np.tanh(0.5 * (x[at] @ w)))
                    rows_at = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [rows_at.column(0), rows_at.column(4), rows_at.column(2), pa.array(np.full(len(at), f, np.int32)), pa.array(np.full(len(at), setting, np.int32)), pa.array(found)],
                        ["cohort", key, "label", "fold", "combination", "score"],
                    )

    own = rows.select(F.col("cohort").cast("string").alias("cohort"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"), F.col("part").cast("int").alias("part"), key).dropna()
    return own.mapInArrow(fn, f"cohort string, `{key}` {kind}, label int, fold int, combination int, score double")


#: What parts mean where there are no inner folds.
TRAIN, VALIDATION = 0, 1


def _parts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.when(F.col("split") == "val", VALIDATION).otherwise(TRAIN))


def train(rows: DataFrame, mode: str, penalties: list[float], default: float = 0.1, best: dict[str, float] | None = None, folds: list[int] | None = None, key: str = "series") -> tuple[DataFrame, dict[str, float]]:
    """(scores, chosen penalty of each cohort) by one of five modes. rows: (cohort, key, features, label, split), and inner for nested.

    none: the default penalty on train. simple: every penalty on train; scores of val, nothing chosen. best: the given
    penalties on train and val. best_epochs: the default on train, of its steps that with the least loss on val; then the given penalties on
    train and val, for as many steps. nested: every penalty on all but one inner fold each, the one with the best mean
    AUROC on these folds (the first of equals), on train and val. Scores are of test unless said otherwise.
    """
    dev, test = rows.filter("split <> 'test'"), rows.filter("split = 'test'").withColumn("part", F.lit(TRAIN))
    if mode == "simple":
        return score(_parts(dev).filter(F.col("part") == VALIDATION), fit(_parts(dev), penalties, [VALIDATION]), key), {}
    if mode == "none":
        fitted = fit(_parts(dev), [default], [VALIDATION])
        return score(test, fitted, key, VALIDATION), {m.cohort: default for m in fitted.models}
    limits = None
    if mode == "best":
        chosen = dict(best or {})
    elif mode == "best_epochs":
        chosen = dict(best or {})
        fitted = fit(_parts(dev), [default], [VALIDATION])
        limits = {m.cohort: int(np.nanargmin(m.validation)) for m in fitted.models if m.validation and not np.isnan(m.validation).all()}
    elif mode == "nested":
        inner = dev.withColumn("part", F.col("inner"))
        folds = sorted(r[0] for r in inner.select("part").distinct().collect() if r[0] is not None) if folds is None else folds
        found = metrics.auroc(score(inner, fit(inner, penalties, folds), key), ["cohort", "combination", "fold"])
        means = found.groupBy("cohort", "combination").agg(F.avg("auroc").alias("auroc")).groupBy("cohort")
        # One row a cohort.
        picked = means.agg(F.min_by("combination", F.struct((-F.coalesce("auroc", F.lit(-1.0))).alias("a"), "combination")).alias("k")).collect()
        chosen = {r["cohort"]: penalties[r["k"]] for r in picked}
    else:
        raise ValueError(f"no mode {mode}: there are nested, simple, none, best and best_epochs")
    every = sorted({*chosen.values(), default})
    fitted = fit(_parts(dev), every, [ALL], limits=limits)
    used = {m.cohort: chosen.get(m.cohort, default) for m in fitted.models}
    kept = [m for m in fitted.models if m.penalty == used[m.cohort]]
    return score(test, Fitted(kept, fitted.size, fitted.passes), key, ALL), used
