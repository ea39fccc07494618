"""The catalog of cohorts and the tables of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import CATALOG_CHAPTERS, band, chapter, ratio

BAND_LABELS = ("very_low", "low", "medium", "high")


def query(catalog: DataFrame, ranges: dict[str, tuple[float | None, float | None]] | None = None, equal: dict[str, str] | None = None, among: DataFrame | None = None) -> DataFrame:
    """Rows within optional ranges and with optional values, among the cohorts of another table; largest risk first."""
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items()]
    for column, (low, high) in (ranges or {}).items():
        tests += [F.col(column) >= low] if low is not None else []
        tests += [F.col(column) <= high] if high is not None else []
    rows = catalog.filter(reduce(lambda a, b: a & b, tests)) if tests else catalog
    if among is not None:
        rows = rows.join(among.select("cohort").distinct(), "cohort", "left_semi")
    return rows.orderBy(F.desc("rr"), "cohort")


def characterise(catalog: DataFrame) -> DataFrame:
    """Adds sizes, rates, logarithms, imbalance and chapters; null where a ratio or logarithm has no value."""
    n = F.col("n_pos") + F.col("n_neg")
    rows = catalog.withColumns({"n_total": n, "target_rate": ratio(F.col("n_pos"), n), "imbalance": ratio(F.col("n_neg"), F.col("n_pos"))})
    logs = {"log_target_rate": "target_rate", "log_n_total": "n_total", "log_rr": "rr", "log_imbalance": "imbalance"}
    rows = rows.withColumns({name: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double"))) for name, c in logs.items()})
    return rows.withColumns({"d1_type": chapter(F.col("d1"), CATALOG_CHAPTERS), "d2_type": chapter(F.col("d2"), CATALOG_CHAPTERS)})


def reliable(catalog: DataFrame, test_share: float = 0.2, least: float = 10) -> DataFrame:
    """Adds whether a test split would have enough rows of both classes."""
    test = (F.col("n_pos") * test_share >= least) & (F.col("n_neg") * test_share >= least)
    return catalog.withColumn("reliable", test.cast("int"))


def equal_bands(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds one of four bands of equal width between the least and largest value, each with its upper bound."""
    ends = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    joined = rows.crossJoin(F.broadcast(ends))  # one row
    step = (F.col("__hi") - F.col("__lo")) / 4
    out = F.when(F.col(column).isNull(), None)
    for k, label in enumerate(BAND_LABELS[:-1], 1):
        out = out.when(F.col(column) <= F.col("__lo") + step * k, label)
    return joined.withColumn(name, out.otherwise(BAND_LABELS[-1])).drop("__lo", "__hi")


def first_per_band(rows: DataFrame, by: str, k: int, *order: str | Column) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__k") <= k).drop("__k")


def type_counts(rows: DataFrame, one: str, two: str) -> DataFrame:
    """(type, n_one, n_two): rows by each of two columns, by the larger count."""
    left, right = (rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("type")).agg(F.count("*").alias(n)) for c, n in ((one, "n_one"), (two, "n_two")))
    joined = left.join(right, "type", "full").fillna(0, ["n_one", "n_two"])
    return joined.orderBy(F.desc(F.greatest("n_one", "n_two")), "type")


def crosstab_shares(rows: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, share): counts of pairs over their row's count."""
    pairs = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    return pairs.select(row, column, (F.col("n") / F.sum("n").over(Window.partitionBy(row))).alias("share"))


def result_means(results: DataFrame, rates: DataFrame) -> DataFrame:
    """(cohort, model, auroc, auprc, lift, gain): means over folds; lift and gain against the rate of positives."""
    means = results.groupBy("cohort", "model").agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))
    joined = means.join(rates.select("cohort", "target_rate"), "cohort")
    return joined.withColumns({"lift": F.col("auprc") - F.col("target_rate"), "gain": ratio(F.col("auprc"), F.col("target_rate"))})


def best_params(results: DataFrame, by: list[str], params: list[str], metric: str = "auroc", extra: tuple[str, ...] = ("epoch",), largest: bool = True) -> DataFrame:
    """The parameter combination with the best mean metric of each group; null parameters are a value of their own."""
    means = results.groupBy(*by, *params).agg(F.avg(metric).alias(metric), *[F.avg(c).alias(c) for c in extra])
    order = F.desc_nulls_last(metric) if largest else F.asc_nulls_last(metric)
    return means.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order, *params))).filter("__k = 1").drop("__k")


def incomplete_grids(results: DataFrame, by: list[str], params: list[str], folds: int) -> DataFrame:
    """Groups whose rows are not folds times combinations: (by..., rows, expected)."""
    own = results.groupBy(*by).agg(F.count("*").alias("rows"), (F.countDistinct(F.struct(*params)) * folds).alias("expected"))
    return own.filter("rows <> expected")


def param_grid(rows: DataFrame, params: list[str]) -> DataFrame:
    """All combinations of the distinct values of each parameter (a small table of settings)."""
    out = rows.select(params[0]).distinct()
    for p in params[1:]:
        out = out.crossJoin(F.broadcast(rows.select(p).distinct()))
    return out


def random_params(grid: DataFrame, n: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """n different combinations, by a hash."""
    return grid.orderBy(F.xxhash64(F.lit(seed), *grid.columns) if order is None else order).limit(n)


def top_side_by_side(importances: DataFrame, k: int, variant: str = "variant", variants: list[str] | None = None) -> DataFrame:
    """(place, a column for each variant): the features of largest importance of each, by rank."""
    place = F.row_number().over(Window.partitionBy(variant).orderBy(F.desc("importance"), "feature"))
    rows = importances.withColumn("place", place).filter(F.col("place") <= k)
    return rows.groupBy("place").pivot(variant, variants).agg(F.first("feature"))


def better_sets(results: DataFrame, key: str, variant: str, metric: str, one: str, two: str) -> DataFrame:
    """How often one variant beats another, ties, and the reverse."""
    wide = results.groupBy(key).agg(*[F.avg(F.when(F.col(variant) == v, F.col(metric))).alias(c) for v, c in ((one, "a"), (two, "b"))]).filter("a is not null and b is not null")
    return wide.agg(F.count_if(F.col("a") > F.col("b")).alias("better"), F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count_if(F.col("a") < F.col("b")).alias("worse"))


__all__ = ["band", "best_params", "better_sets", "characterise", "crosstab_shares", "equal_bands", "first_per_band", "incomplete_grids", "param_grid", "query", "random_params", "reliable", "result_means", "top_side_by_side", "type_counts"]
