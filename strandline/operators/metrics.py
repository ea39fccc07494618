"""Exact classification metrics, for all groups (cohort, model, fold, split) in one job.

Rows are first summed by group and distinct score. Running sums over the scores of a group are sums of score bands before
a band, plus running sums inside it. Bands are cut at approximate quantiles of each group's own scores, so they hold about
as many scores each wherever these lie (rare events, logits), and no group has to fit one task. The cuts decide only what
a task holds; sums are exact. Rows whose score is null or not a number, or whose label is null, are on no curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.bands import banded, matched


def by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """(group..., score, pos, neg)."""
    known = rows.filter("score is not null and not isnan(score) and label is not null")
    return known.groupBy(*by, F.col("score").cast("double").alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def running(rows: DataFrame, by: list[str]) -> DataFrame:
    """(group..., score, pos, neg, tp, fp, p, n): by_score() with the sums of its own and all higher scores, and of all."""
    rows = banded(by_score(rows, by), "score", by)
    bands = rows.groupBy(*by, "__band").agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))  # BANDS rows a group at most
    whole = Window.partitionBy(*by)
    higher = whole.orderBy(F.desc("__band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        *by, "__band", F.coalesce(F.sum("__pos").over(higher), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__neg").over(higher), F.lit(0)).alias("__fp"),
        F.sum("__pos").over(whole).alias("p"), F.sum("__neg").over(whole).alias("n"),
    )
    down = Window.partitionBy(*by, "__band").orderBy(F.desc("score"))
    joined = matched(rows.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)}), bands, [*by, "__band"])
    return joined.select(*by, "score", "pos", "neg", (F.col("tp") + F.col("__tp")).alias("tp"), (F.col("fp") + F.col("__fp")).alias("fp"), "p", "n")


def _auroc() -> Column:
    return F.try_divide(F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)), F.max(F.col("p") * F.col("n"))).alias("auroc")


def _steps() -> dict[str, Column]:
    """Precision and recall at a score, and at the next higher one; null with one class only."""
    both = (F.col("p") > 0) & (F.col("n") > 0)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    steps = {"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "p"), "p0": F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0)), "r0": F.try_divide(tp0, F.col("p"))}
    return {name: F.when(both, value) for name, value in steps.items()}


def _area() -> list[Column]:
    s = _steps()
    return [F.sum((s["recall"] - s["r0"]) * (s["precision"] + s["p0"]) / 2).alias("auprc"), F.max(F.least(s["precision"], s["recall"])).alias("minrp")]


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties as half; null with one class only."""
    return running(rows, by).groupBy(*by).agg(_auroc())


def pr_curve(rows: DataFrame, by: list[str]) -> DataFrame:
    """(group..., score, precision, recall) at each distinct score, with those of the next higher one (p0, r0)."""
    return running(rows, by).filter("p > 0 and n > 0").select(*by, "score", *[value.alias(name) for name, value in _steps().items()])


def auprc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(group..., auprc, minrp): trapezoids under the curve from (recall 0, precision 1); best of the smaller of the two."""
    return running(rows, by).filter("p > 0 and n > 0").groupBy(*by).agg(*_area())


def _loss(clip: float = 1e-7) -> Column:
    p = F.greatest(F.least("score", F.lit(1 - clip)), F.lit(clip))
    return F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("loss")


def log_loss(rows: DataFrame, by: list[str], clip: float = 1e-7) -> DataFrame:
    return rows.groupBy(*by).agg(_loss(clip))


def _cells(threshold: float) -> list[Column]:
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    return [F.count_if(test).cast("double").alias(name) for name, test in (("tp", hit & pos), ("fp", hit & ~pos), ("fn", ~hit & pos), ("tn", ~hit & ~pos))]


def _rates() -> dict[str, Column]:
    """From the four cells; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def part(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def f(beta: float) -> Column:
        return part((1 + beta**2) * tp, (1 + beta**2) * tp + beta**2 * fn + fp)

    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "balanced_acc": (part(tp, tp + fn) + part(tn, tn + fp)) / 2, "mcc": part(tp * tn - fp * fn, root), "f1": f(1), "f2": f(2)}


def at_threshold(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall, balanced accuracy, MCC, F1, F2 at a threshold (reaching it is positive); 0 where undefined."""
    return rows.groupBy(*by).agg(*_cells(threshold)).select(*by, *[value.alias(name) for name, value in _rates().items()])


def all_metrics(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """One row a group with every metric; with one class only, all but the loss are null.

    Two aggregates: one of the rows, one of the running sums.
    """
    of_rows = rows.groupBy(*by).agg(_loss(), *_cells(threshold)).select(*by, "loss", *[value.alias(name) for name, value in _rates().items()])
    out = matched(of_rows, running(rows, by).groupBy(*by).agg(_auroc(), *_area()), by, "left")
    rates = [F.when(F.col("auroc").isNotNull(), F.col(c)).alias(c) for c in _rates()]
    return out.select(*by, "loss", "auroc", "auprc", "minrp", *rates)
