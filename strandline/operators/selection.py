"""Feature selection and statistics, grouped by cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.pvalues import t_pvalue
from strandline.operators import bands
from strandline.sources.scratch import written


def pearson(x: Column, y: Column) -> Column:
    """Correlation of rows that have both values; null where one of them does not vary (the built-in one raises)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def item_means(features: DataFrame, members: DataFrame, train_only: bool = True) -> DataFrame:
    """(cohort, encounter, item, value, label): means of an encounter's item, of training members."""
    own = members.filter("split = 'train'") if train_only else members
    means = features.groupBy("encounter", "item").agg(F.avg("value").alias("value"))
    return own.select("cohort", "encounter", "label").join(means, "encounter").filter("value is not null")


def correlations(means: DataFrame, min_count: int = 10) -> DataFrame:
    """(cohort, item, n, r, reason): point-biserial correlation with the label, or why there is none."""
    own = means.groupBy("cohort", "item").agg(
        F.count("*").alias("n"), pearson(F.col("value"), F.col("label").cast("double")).alias("r"), F.countDistinct("value").alias("values"), F.countDistinct("label").alias("labels")
    )
    reason = F.when(F.col("n") < min_count, "min_count").when(F.col("values") < 2, "value_const").when(F.col("labels") < 2, "label_const").when(F.col("r").isNull() | F.isnan("r") | (F.col("n") < 3), "nan_pval")
    return own.withColumn("reason", reason).select("cohort", "item", "n", F.when(F.col("reason").isNull(), F.col("r")).alias("r"), "reason")


def t_of_r(r: Column, n: Column) -> Column:
    """Test statistic of a correlation, with n - 2 degrees of freedom."""
    return r * F.sqrt(F.try_divide(n - 2, 1 - r * r))


def with_pvalues(found: DataFrame) -> DataFrame:
    return found.withColumn("p", t_pvalue(t_of_r(F.col("r"), F.col("n")), (F.col("n") - 2).cast("double")))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.2, by: tuple[str, ...] = ("cohort",), p: str = "p") -> DataFrame:
    """Adds whether a test is rejected: p up to the largest ordered p that is under alpha times its rank over n."""
    order, whole = Window.partitionBy(*by).orderBy(p), Window.partitionBy(*by)
    ranked = tests.withColumns({"__i": F.row_number().over(order), "__m": F.count("*").over(whole)})
    cut = F.max(F.when(F.col(p) <= F.col("__i") / F.col("__m") * alpha, F.col(p))).over(whole)
    return ranked.withColumn("selected", F.coalesce(F.col(p) <= cut, F.lit(False)).cast("int")).drop("__i", "__m")


def top_k(tests: DataFrame, k: int, by: tuple[str, ...] = ("cohort",), p: str = "p") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(p, "item"))
    return tests.withColumn("selected", (place <= k).cast("int"))


def holm(tests: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Adds Holm's adjusted p: the running largest of p times the number of tests not smaller, 1 at most."""
    order, whole = Window.partitionBy(*by).orderBy(p, "item"), Window.partitionBy(*by)
    steps = tests.withColumn("__x", F.col(p) * (F.count("*").over(whole) - F.row_number().over(order) + 1))
    return steps.withColumn("adjusted", F.least(F.max("__x").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("__x")


def f_statistics(means: DataFrame) -> DataFrame:
    """(cohort, item, f): analysis of variance of two classes; encounters without the item count as 0."""
    sizes = means.select("cohort", "encounter", "label").distinct().groupBy("cohort").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    sums = means.groupBy("cohort", "item").agg(
        F.count("*").alias("n"),
        F.countDistinct("value").alias("values"),
        F.sum(F.when(F.col("label") == 1, F.col("value")).otherwise(0)).alias("sp"),
        F.sum(F.when(F.col("label") == 0, F.col("value")).otherwise(0)).alias("sq"),
        F.sum(F.col("value") * F.col("value")).alias("ss"),
    )
    j = sums.join(sizes, "cohort")
    total = F.col("p") + F.col("q")
    mean = (F.col("sp") + F.col("sq")) / total
    between = F.pow("sp", F.lit(2)) / F.nullif(F.col("p"), F.lit(0)) + F.pow("sq", F.lit(2)) / F.nullif(F.col("q"), F.lit(0)) - total * mean * mean
    within = F.col("ss") - total * mean * mean - between
    return j.select("cohort", "item", "n", "values", F.try_divide(between, within / (total - 2)).alias("f"))


def item_correlations(means: DataFrame) -> DataFrame:
    """(cohort, a, b, r) for items a < b; encounters without an item count as 0. Pairs are made within an encounter."""
    sizes = means.select("cohort", "encounter").distinct().groupBy("cohort").agg(F.count("*").alias("n"))
    one = means.groupBy("cohort", "item").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    vectors = means.groupBy("cohort", "encounter").agg(F.array_sort(F.collect_list(F.struct("item", "value"))).alias("v"))
    first = vectors.select("cohort", F.posexplode("v").alias("k", "x"), "v").select("cohort", "x", F.explode(F.slice("v", F.col("k") + 2, F.size("v"))).alias("y"))
    shared = first.groupBy("cohort", F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(F.sum(F.col("x.value") * F.col("y.value")).alias("xy"))
    left, right = (one.select("cohort", F.col("item").alias(c), F.col("s").alias(f"s{c}"), F.col("ss").alias(f"q{c}")) for c in "ab")
    pairs = left.join(right, "cohort").filter("a < b").join(shared, ["cohort", "a", "b"], "left").join(sizes, "cohort")  # items by items of a cohort: a few hundred squared
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    top = n * F.coalesce("xy", F.lit(0.0)) - sa * sb
    bottom = F.sqrt((n * F.col("qa") - sa * sa) * (n * F.col("qb") - sb * sb))
    return pairs.select("cohort", "a", "b", F.try_divide(top, bottom).alias("r"))


def mrmr(means: DataFrame, k: int, min_count: int = 10) -> DataFrame:
    """(cohort, item, place): items by relevance over redundancy, one after the other.

    Relevance is the F statistic, redundancy the mean absolute correlation with the items already taken. The choice
    runs on the table of items and item pairs of each cohort, a few hundred rows, inside one grouped task.
    """
    import pandas as pd

    usable = f_statistics(means).filter((F.col("n") >= min_count) & (F.col("values") >= 2) & F.col("f").isNotNull())
    pairs = item_correlations(means)
    table = usable.select("cohort", F.col("item").alias("a"), F.lit(None).cast(means.schema["item"].dataType).alias("b"), F.col("f").alias("x")).unionByName(pairs.select("cohort", "a", "b", F.abs("r").alias("x")))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        relevance = group[group["b"].isna()].set_index("a")["x"].sort_index()
        near: dict = {}
        for a, b, x in group[group["b"].notna()][["a", "b", "x"]].itertuples(index=False):
            near[a, b] = near[b, a] = 0.0 if x != x else x
        taken: list = []
        while len(taken) < min(k, len(relevance)):
            rest = [i for i in relevance.index if i not in taken]
            score = {i: relevance[i] / (max(1e-3, sum(near.get((i, j), 0.0) for j in taken) / len(taken)) if taken else 1.0) for i in rest}
            taken.append(max(rest, key=lambda i: score[i]))
        return pd.DataFrame({"cohort": [group["cohort"].iloc[0]] * len(taken), "item": taken, "place": range(len(taken))})

    kinds = {f.name: f.dataType.simpleString() for f in means.schema.fields}
    return table.groupBy("cohort").applyInPandas(choose, f"cohort {kinds['cohort']}, item {kinds['item']}, place long")


def entropy(means: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by..., item, h): entropy of the histogram of z-scores in equal-width bins, one added to each count.

    Bounds are an aggregate joined back, so no group has to fit a task.
    """
    means = written(means.select(*by, "item", "value"), "means")
    ends = means.groupBy(*by, "item").agg(F.min("value").alias("__least"), F.max("value").alias("__most"))  # one row a group
    least, most = F.col("__least"), F.col("__most")
    place = F.when(most > least, F.least(F.floor((F.col("value") - least) / (most - least) * bins), F.lit(bins - 1))).otherwise(bins // 2)
    counted = bands.matched(means, ends, [*by, "item"]).withColumn("bin", place).groupBy(*by, "item", "bin").agg(F.count("*").alias("c"))
    sums = counted.groupBy(*by, "item").agg(F.sum("c").alias("n"), F.count("*").alias("used"), F.sum((F.col("c") + 1) * F.ln(F.col("c") + 1)).alias("x"))
    total = F.col("n") + bins
    return sums.select(*by, "item", (F.ln(total) - F.col("x") / total).alias("h"))


def cohens_d(means: DataFrame) -> DataFrame:
    """(cohort, item, d): absolute difference of the classes' means over the standard deviation of all."""
    mean = {c: F.avg(F.when(F.col("label") == c, F.col("value"))) for c in (0, 1)}
    return means.groupBy("cohort", "item").agg((F.abs(mean[1] - mean[0]) / (F.stddev_samp("value") + 1e-8)).alias("d"))


def feature_stats(means: DataFrame, members: DataFrame) -> DataFrame:
    """Per cohort: mean and variance of the items' missing shares, entropy by class, effect size, log entropy ratio."""
    means = written(means, "means")  # read five times
    sizes = members.groupBy("cohort").agg(F.countDistinct("encounter").alias("size"))
    miss = means.groupBy("cohort", "item").agg(F.countDistinct("encounter").alias("k")).join(sizes, "cohort").withColumn("miss", 1 - F.col("k") / F.col("size"))
    out = miss.groupBy("cohort").agg(F.avg("miss").alias("missing_mean"), F.var_samp("miss").alias("missing_var"))
    h = entropy(means, ["cohort", "label"]).groupBy("cohort").agg(F.avg(F.when(F.col("label") == 1, F.col("h"))).alias("h_pos"), F.avg(F.when(F.col("label") == 0, F.col("h"))).alias("h_neg"))
    d = cohens_d(means).groupBy("cohort").agg(F.avg("d").alias("d"))
    return out.join(h, "cohort", "left").join(d, "cohort", "left").withColumn("log_ratio", F.ln(F.try_divide("h_neg", "h_pos")))


# --- statistics of result tables -------------------------------------------------------------------------------------


def average_ranks(rows: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Adds the rank of a value in its group; equal values share the mean of their ranks. Nulls and NaN have no rank.

    Values are ranked once each and joined back, so neither a large group nor a frequent value has to fit a task.
    """
    found = bands.ranks(bands.counted(rows, column, by), column, by, name)
    return bands.matched(rows, found.drop("n"), [*by, column], "left")


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., n, r) over rows that have both values."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    ranked = average_ranks(average_ranks(both, x, by, "__x"), y, by, "__y")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col("__x"), F.col("__y")).alias("r"))


def paired_t(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., n, mean_diff, t)."""
    diff = F.col(x) - F.col(y)
    out = pairs.filter(diff.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("__s"))
    return out.withColumn("t", F.try_divide("mean_diff", F.col("__s") / F.sqrt("n"))).drop("__s")


def wilcoxon(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., n, w): signed-rank statistic, the smaller of the two rank sums; differences of zero are dropped."""
    rows = pairs.withColumn("__d", F.round(F.col(x) - F.col(y), 12)).filter("__d <> 0").withColumn("__a", F.abs("__d"))
    counts = rows.groupBy(*by, "__a").agg(F.count("*").alias("n"), F.count_if(F.col("__d") > 0).alias("__up"))
    ranked = _with_ranks(counts, "__a", by)
    up, down = (F.sum(F.col("__r") * c).cast("double") for c in (F.col("__up"), F.col("n") - F.col("__up")))
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.least(up, down).alias("w"))


def _with_ranks(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """counts (by..., value, n, ...) of different values with their rank ``__r``."""
    found = bands.ranks(counts.select(*by, value, "n"), value, by, "__r").drop("n")
    return bands.matched(counts, found, [*by, value])


def _rank_sums(rows: DataFrame, value: str, group: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by..., group, n, rsum) and (by..., total, ties): from counts of equal values, never from rows."""
    own = bands.counted(rows, value, [*by, group])
    counts = own.groupBy(*by, value).agg(F.sum("n").alias("n"))
    joined = bands.matched(own, _with_ranks(counts, value, by).drop("n"), [*by, value])
    groups = joined.groupBy(*by, group).agg(F.sum("n").alias("n"), F.sum(F.col("__r") * F.col("n")).alias("rsum"))
    ties = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    return groups, ties


def kruskal(rows: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(by..., h, df): rank test of several groups, corrected for ties."""
    groups, ties = _rank_sums(rows, value, group, by)
    sums = groups.groupBy(*by).agg(F.sum(F.pow("rsum", F.lit(2)) / F.col("n")).alias("s"), (F.count("*") - 1).alias("df")).join(ties, by)
    total = F.col("total")
    h = 12 / (total * (total + 1)) * F.col("s") - 3 * (total + 1)
    return sums.select(*by, F.try_divide(h, 1 - F.col("ties") / (F.pow(total, F.lit(3)) - total)).alias("h"), "df")


def dunn(rows: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(by..., a, b, z): differences of mean ranks of each pair of groups over their standard error, corrected for ties."""
    groups, ties = _rank_sums(rows, value, group, by)
    left, right = (groups.select(*by, F.col(group).alias(c), F.col("n").alias(f"n{c}"), (F.col("rsum") / F.col("n")).alias(f"m{c}")) for c in "ab")
    pairs = left.join(right, by).filter("a < b").join(ties, by)  # groups by groups: a few bands
    total = F.col("total")
    variance = (total * (total + 1) - F.col("ties") / (total - 1)) / 12
    return pairs.select(*by, "a", "b", (F.abs(F.col("ma") - F.col("mb")) / F.sqrt(variance * (1 / F.col("na") + 1 / F.col("nb")))).alias("z"))
