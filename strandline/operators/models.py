"""Tabular models on flat features, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import metrics


def as_vector(rows: DataFrame, column: str = "features") -> DataFrame:
    return rows.withColumn(column, array_to_vector(column))


def estimator(kind: str, n_features: int = 0, seed: int = 42, **params: float):
    """random_forest, logistic (L2), gbt or mlp (layers: hidden sizes between the features and two classes)."""
    if kind == "random_forest":
        return RandomForestClassifier(seed=seed, **params)
    if kind == "logistic":
        return LogisticRegression(elasticNetParam=0.0, **{"regParam": 0.1} | params)
    if kind == "gbt":
        return GBTClassifier(seed=seed, **params)
    if kind == "mlp":
        hidden = params.pop("hidden", 16)
        return MultilayerPerceptronClassifier(layers=[n_features, int(hidden), 2], seed=seed, **params)
    raise ValueError(f"no model {kind}")


def fit_score(rows: DataFrame, kind: str, fit_on: Iterable[str] = ("train", "val"), score_on: str = "test", key: str = "series", **params: float) -> tuple[DataFrame, Model]:
    """(key, label, score) of the scored split after fitting on the others. rows: (key, features vector, label, split)."""
    train = rows.filter(F.col("split").isin(*fit_on))
    n = len(train.select("features").first()[0]) if kind == "mlp" else 0
    model = estimator(kind, n, **params).fit(train)
    scored = model.transform(rows.filter(F.col("split") == score_on))
    return scored.select(key, "label", vector_to_array("probability")[1].alias("score")), model


def fit_protocol(rows: DataFrame, kind: str, grid: bool, key: str = "series", **params: float) -> tuple[DataFrame, Model]:
    """For a grid of parameters: fit on train, score val. For the final model: fit on train and val, score test."""
    return fit_score(rows, kind, ("train",), "val", key, **params) if grid else fit_score(rows, kind, ("train", "val"), "test", key, **params)


def importances(model: Model, names: list[str]) -> DataFrame:
    """(feature, importance), largest first."""
    rows = sorted(zip(names, map(float, model.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def grid_search(rows: DataFrame, kind: str, grid: list[dict], folds: list[int], key: str = "series") -> DataFrame:
    """(combination, fold, auroc, loss): each combination fitted on all but one inner fold and scored on it.

    rows: with a column ``inner``; a loop over fits, each a distributed job.
    """
    out = None
    for i, params in enumerate(grid):
        for fold in folds:
            split = rows.withColumn("split", F.when(F.col("inner") == fold, "val").otherwise("train"))
            scored, _ = fit_score(split, kind, ("train",), "val", key, **params)
            one = scored.withColumns({"combination": F.lit(i), "fold": F.lit(fold)})
            out = one if out is None else out.unionByName(one)
    return metrics.all_metrics(out, ["combination", "fold"])


def nested(rows: DataFrame, kind: str, grid: list[dict], folds: list[int], key: str = "series") -> tuple[DataFrame, dict]:
    """Inner folds choose the combination with the best mean AUROC; refit on all but test; (test scores, chosen)."""
    dev = rows.filter("split <> 'test'")
    found = grid_search(dev, kind, grid, folds, key).groupBy("combination").agg(F.avg("auroc").alias("auroc")).orderBy(F.desc_nulls_last("auroc"), "combination").first()
    chosen = grid[found["combination"]]
    return fit_score(rows, kind, ("train", "val"), "test", key, **chosen)[0], chosen


def clusters(rows: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, float, float]:
    """(rows with cluster, inertia, silhouette) of standardised vectors."""
    scaled = StandardScaler(inputCol="features", outputCol="__z", withMean=True).fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="__z", predictionCol="cluster").fit(scaled)
    out = model.transform(scaled)
    silhouette = ClusteringEvaluator(featuresCol="__z", predictionCol="cluster").evaluate(out)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    gap = F.zip_with(vector_to_array("__z"), F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b))
    out = out.withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, b: a + b)))
    return out.drop("__z"), float(model.summary.trainingCost), float(silhouette)


def medoids(clustered: DataFrame, key: str = "series") -> DataFrame:
    """(cluster, key): the member nearest to each centre."""
    return clustered.groupBy("cluster").agg(F.min_by(key, F.struct("distance", key)).alias(key))


def principal(rows: DataFrame, k: int = 2) -> DataFrame:
    """Adds the first components of standardised vectors."""
    scaled = StandardScaler(inputCol="features", outputCol="__z", withMean=True).fit(rows).transform(rows)
    out = PCA(k=k, inputCol="__z", outputCol="__p").fit(scaled).transform(scaled).withColumn("components", vector_to_array("__p"))
    return out.drop("__z", "__p")


def ranked(importance: DataFrame) -> DataFrame:
    return importance.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
