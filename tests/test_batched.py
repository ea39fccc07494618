"""Batched logistic models against pyspark.ml, one model at a time, and the modes of training."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strandline.operators import batched, metrics, models

ROWS = "cohort string, series long, features array<double>, label int, part int"


def made(cohorts, n, rng, parts=5, size=6):
    rows = []
    for c in range(cohorts):
        w = [rng.gauss(0, 1) for _ in range(size)]
        for k in range(n):
            x = [rng.gauss(0, 10.0 ** (j % 3)) for j in range(size - 1)] + [3.0]
            odds = sum(a * b / 10.0 ** (j % 3) for j, (a, b) in enumerate(zip(w, x))) - 3 * w[-1] + rng.gauss(0, 1)
            rows.append((f"c{c}", 1000 * c + k, x, int(odds > 0), k % parts))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made(25, 60, random.Random(1))
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS + ", key string").repartition(5).cache()
    return rows, df, batched.fit(df, [0.01, 0.1, 1.0, 10.0], [0, 1, 2, 3, 4, batched.ALL])


def test_many_models_in_few_passes(fitted):
    rows, _, found = fitted
    assert len(found.models) == 25 * 6 * 4 and found.passes <= 20 and all(m.done for m in found.models)
    for m in found.models:
        x = np.array([[*r[2], 1.0] for r in rows if r[0] == m.cohort and r[4] != m.fold])
        y = np.array([r[3] for r in rows if r[0] == m.cohort and r[4] != m.fold])
        p = 1 / (1 + np.exp(-(x @ m.raw())))
        scale = x[:, :-1].std(axis=0, ddof=1)
        gradient = (x.T @ (p - y)) / len(y) + np.append(m.penalty * scale**2 * m.raw()[:-1], 0)
        assert np.abs(gradient / np.append(np.maximum(scale, 1), 1)).max() < 1e-8 and m.raw()[5] == 0


def test_weights_of_single_fits(fitted):
    _, df, found = fitted
    for m in [m for m in found.models if m.cohort in ("c0", "c7")][::9]:
        own = df.filter((F.col("cohort") == m.cohort) & (F.col("part") != m.fold)).select(array_to_vector("features").alias("features"), "label")
        single = LogisticRegression(regParam=m.penalty, elasticNetParam=0.0, tol=1e-12, maxIter=500).fit(own)
        assert np.allclose(m.raw(), [*single.coefficients, single.intercept], rtol=1e-4, atol=1e-6)


def test_scores_of_left_out_parts(fitted):
    rows, df, found = fitted
    got = batched.score(df, found).collect()
    assert len(got) == 4 * len(rows)
    weights = {(m.cohort, m.fold, m.setting): m.raw() for m in found.models}
    by_series = {r[1]: r for r in rows}
    for r in got[:: 37]:
        own = by_series[r.series]
        assert r.fold == own[4] and r.label == own[3]
        assert abs(r.score - 1 / (1 + np.exp(-(np.array([*own[2], 1.0]) @ weights[r.cohort, r.fold, r.combination])))) < 1e-9


def test_odd_cohorts(spark):
    rows = [("one", k, [float(k), 1.0], 1, k % 2) for k in range(6)] + [("none", k, [float(k), 1.0], 0, 0) for k in range(4)]
    rows += [("apart", k, [float(k > 9), 2.0], int(k > 9), k % 3) for k in range(20)] + [("some", 1, None, 1, 0), ("some", 2, [1.0, 1.0], None, 0), ("some", 3, [1.0, 1.0], 1, None)]
    df = spark.createDataFrame(rows, ROWS)
    found = batched.fit(df, [0.1], [0, batched.ALL])
    assert {(m.cohort, m.fold) for m in found.models} == {("one", 0), ("one", -1), ("none", -1), ("apart", 0), ("apart", -1)}
    scores = {(r.cohort, r.series): r.score for r in batched.score(df, found, fold=batched.ALL).collect()}
    assert {scores["one", k] for k in range(6)} == {1.0} and {scores["none", k] for k in range(4)} == {0.0}
    assert scores["apart", 3] < 0.5 < scores["apart", 13]
    empty = batched.fit(df.limit(0), [0.1], [batched.ALL])
    assert empty.models == [] and batched.score(df, empty).collect() == []
    with pytest.raises(ValueError, match="too many"):
        before, batched.MOST_NUMBERS = batched.MOST_NUMBERS, 10
        try:
            batched.fit(df, [0.1], [batched.ALL])
        finally:
            batched.MOST_NUMBERS = before


def test_modes(spark):
    rng = random.Random(3)
    rows = [(c, s, x, y, ("test", "val", "train", "train", "train")[k % 5], k % 3) for k, (c, s, x, y, _) in enumerate(made(3, 150, rng))]
    df = spark.createDataFrame(rows, "cohort string, series long, features array<double>, label int, split string, inner int").cache()
    grid = [0.001, 0.1, 5.0]
    out = {mode: batched.train(df, mode, grid, best={"c0": 0.1, "c1": 5.0}) for mode in ("none", "simple", "best", "best_epochs", "nested")}
    scores = {mode: {(r.cohort, r.series, r.combination): r.score for r in rows.collect()} for mode, (rows, _) in out.items()}
    split = {(r[0], r[1]): r[4] for r in rows}
    for mode, found in scores.items():
        assert {split[k[:2]] for k in found} == {"val" if mode == "simple" else "test"}
    assert len(scores["simple"]) == 3 * 90 and len(scores["nested"]) == len(scores["none"]) == 90
    assert out["simple"][1] == {} and out["best"][1] == {"c0": 0.1, "c1": 5.0, "c2": 0.1} == out["best_epochs"][1]

    def single(cohort, parts, penalty):
        own = df.filter((F.col("cohort") == cohort) & F.col("split").isin(*parts)).select(array_to_vector("features").alias("features"), "label")
        model = LogisticRegression(regParam=penalty, elasticNetParam=0.0, tol=1e-12, maxIter=500).fit(own)
        return lambda x: 1 / (1 + np.exp(-(np.dot(x, model.coefficients.toArray()) + model.intercept)))

    features = {(r[0], r[1]): r[2] for r in rows}
    for mode, parts in (("none", ("train",)), ("best", ("train", "val")), ("nested", ("train", "val"))):
        for cohort in ("c0", "c1"):
            told = single(cohort, parts, out[mode][1][cohort])
            assert all(abs(v - told(features[k[:2]])) < 1e-4 for k, v in scores[mode].items() if k[0] == cohort)
    # The nested choice is that of one fit after another.
    for cohort in ("c0", "c2"):
        own = models.as_vector(df.filter(F.col("cohort") == cohort))
        assert models.nested(own, "logistic", [{"regParam": p, "tol": 1e-12, "maxIter": 500} for p in grid], [0, 1, 2])[1]["regParam"] == out["nested"][1][cohort]
    # Fewer steps for the final fit where the loss on val rose.
    assert scores["best_epochs"].keys() == scores["best"].keys() and metrics.auroc(out["best_epochs"][0], ["cohort"]).count() == 3
    with pytest.raises(ValueError, match="no mode"):
        batched.train(df, "other", grid)
