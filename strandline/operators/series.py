"""Time series of (series, item, minute, value): regular grids and irregular forms.

A grid is a long table (series, item, bin), never a driver array; windows run within one series and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 1440
KEYS = ["series", "item"]


def with_bins(rows: DataFrame, bin_hours: float = 24) -> DataFrame:
    return rows.withColumn("bin", F.floor(F.col("minute") / (60 * bin_hours)).cast("int"))


def day_only(rows: DataFrame) -> DataFrame:
    """Minutes replaced by those of their day's begin."""
    return rows.withColumn("minute", F.floor(F.col("minute") / DAY) * DAY)


def mean_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("value").alias("value"))


def full_grid(rows: DataFrame) -> DataFrame:
    """(series, item, bin) for all series, items and bins that occur; items and number of bins are one small row."""
    shape = rows.agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("bin").alias("last"))
    own = rows.select("series").distinct().crossJoin(F.broadcast(shape))
    return own.select("series", F.explode("items").alias("item"), "last").select("series", "item", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"), (F.col("last") + 1).alias("bins"))


def discretise(rows: DataFrame) -> DataFrame:
    """Grid with last, mean, sum, count and whether anything was observed; unobserved cells are null, count 0."""
    cells = rows.groupBy(*KEYS, "bin").agg(F.max_by("value", F.struct("minute", "value")).alias("last"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("*").alias("n"))
    joined = full_grid(rows).join(cells, [*KEYS, "bin"], "left")
    return joined.withColumns({"n": F.coalesce("n", F.lit(0)), "obs": F.col("n").isNotNull().cast("int")})


def _by_bin() -> Window:
    return Window.partitionBy(*KEYS).orderBy("bin")


def grid_delta(grid: DataFrame) -> DataFrame:
    """Adds bins since the last observed one over the number of bins: 0 where observed, bin + 1 before the first."""
    seen = F.last(F.when(F.col("obs") == 1, F.col("bin")), ignorenulls=True).over(_by_bin().rowsBetween(Window.unboundedPreceding, 0))
    since = F.when(F.col("obs") == 1, 0).otherwise(F.coalesce(F.col("bin") - seen, F.col("bin") + 1))
    return grid.withColumn("delta", since / F.col("bins"))


def fill(grid: DataFrame, column: str = "mean") -> DataFrame:
    """Unobserved cells take the last value before, else the first after, else 0."""
    before = F.last(column, ignorenulls=True).over(_by_bin().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(_by_bin().rowsBetween(0, Window.unboundedFollowing))
    return grid.withColumn("filled", F.coalesce(before, after, F.lit(0.0)))


def fill_mean(grid: DataFrame, train: DataFrame, column: str = "mean") -> DataFrame:
    """Unobserved cells take the mean of the item's observed cells of training series, else 0."""
    means = grid.join(train.select("series"), "series", "left_semi").groupBy("item").agg(F.avg(column).alias("__mean"))
    return grid.join(means, "item", "left").withColumn("filled", F.coalesce(column, "__mean", F.lit(0.0))).drop("__mean")


def standardise(grid: DataFrame, train: DataFrame, column: str = "filled", population: bool = True) -> DataFrame:
    """Adds (value - mean) / std with statistics of the training series by item; a std of 0 counts as 1."""
    std = F.stddev_pop(column) if population else F.coalesce(F.stddev_samp(column), F.lit(0.0))
    stats = grid.join(train.select("series"), "series", "left_semi").groupBy("item").agg(F.avg(column).alias("__m"), std.alias("__s"))
    scaled = (F.col(column) - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return grid.join(stats, "item").withColumn("scaled", scaled).drop("__m", "__s")


def variant(grid: DataFrame, kinds: str = "VMD") -> DataFrame:
    """(series, bin, kind, item, x): the blocks that a variant names: values, mask, delta."""
    columns = {"V": "scaled", "M": "obs", "D": "delta"}
    blocks = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(columns[k]).cast("double"))])
    return grid.select("series", "bin", "item", F.explode(blocks).alias("kind", "x"))


def flatten(grid: DataFrame, kinds: str = "VMD") -> DataFrame:
    """(series, features): one array a series, bin by bin, in a bin block by block, in a block item by item."""
    place = F.instr(F.lit(kinds), F.col("kind"))
    rows = variant(grid, kinds).withColumn("at", F.struct("bin", place.alias("block"), "item", "x"))
    return rows.groupBy("series").agg(F.transform(F.array_sort(F.collect_list("at")), lambda a: a["x"]).alias("features"))


def feature_names(grid: DataFrame, kinds: str = "VMD") -> DataFrame:
    """(place, name) of the features that flatten makes."""
    shape = grid.agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("bin").alias("last"))
    rows = shape.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"), "items").select("bin", F.posexplode(F.array(*map(F.lit, kinds))).alias("block", "kind"), "items")
    rows = rows.select("bin", "block", "kind", F.explode("items").alias("item"))
    place = F.row_number().over(Window.orderBy("bin", "block", "item")) - 1  # a row for each feature, no data
    return rows.select(place.alias("place"), F.concat_ws("_", F.col("item").cast("string"), "kind", F.concat(F.lit("Bin"), F.col("bin").cast("string"))).alias("name"))


def flatten_mean(grid: DataFrame, kinds: str = "VMD") -> DataFrame:
    return variant(grid, kinds).groupBy("series", "kind", "item").agg(F.avg("x").alias("x"))


def item_index(rows: DataFrame, name: str = "item") -> DataFrame:
    """(item, ind): dense index of the sorted distinct values, a small table."""
    return rows.select(name).distinct().withColumn("ind", F.row_number().over(Window.orderBy(name)) - 1)


# --- irregular forms -----------------------------------------------------------------------------------------------


def observed_matrix(rows: DataFrame) -> DataFrame:
    """(series, minute, item, value, mask): every observed time of a series with every item; 0 where not observed."""
    cells = mean_duplicates(rows, ["series", "minute", "item"])
    items = rows.agg(F.array_sort(F.collect_set("item")).alias("items"))
    times = cells.select("series", "minute").distinct().crossJoin(F.broadcast(items)).select("series", "minute", F.explode("items").alias("item"))
    joined = times.join(cells, ["series", "minute", "item"], "left")
    return joined.select("series", "minute", "item", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().cast("int").alias("mask"))


def irregular_delta(matrix: DataFrame, days: int) -> DataFrame:
    """Adds the time since the item was last observed before (since the series' begin if never), over its longest span."""
    order = Window.partitionBy(*KEYS).orderBy("minute")
    before = F.last(F.when(F.col("mask") == 1, F.col("minute")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.min("minute").over(Window.partitionBy(*KEYS))
    return matrix.withColumn("delta", (F.col("minute") - F.coalesce(before, begin)) / ((days + 1) * DAY))


def rate_of_change(rows: DataFrame, threshold: float, skip_item: str | int | None = None) -> DataFrame:
    """Adds whether an observation's change by minute since the item's last one is above a threshold; null for the first."""
    order = Window.partitionBy(*KEYS).orderBy("minute", "value")
    gap = F.col("minute") - F.lag("minute").over(order)
    rate = F.abs((F.col("value") - F.lag("value").over(order)) / F.when(gap == 0, 1e-6).otherwise(gap))
    out = rows.withColumn("significant", (rate > threshold).cast("int"))
    return out if skip_item is None else out.withColumn("significant", F.when(F.col("item") != skip_item, F.col("significant")))


def event_mask(rows: DataFrame, threshold: float = 0.001, insignificant: float = 0.4, seed: int = 42, skip_item: str | int | None = None) -> DataFrame:
    """Adds a mask: significant observations with probability 1 - insignificant, others with insignificant; by a hash."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "series", "item", "minute", "value"), F.lit(1_000_000)) / 1e6
    marked = rate_of_change(rows, threshold, skip_item)
    keep = F.when(F.col("significant") == 1, draw < 1 - insignificant).when(F.col("significant") == 0, draw < insignificant).otherwise(F.lit(False))
    return marked.withColumn("mask", keep)


def cap_rows(rows: DataFrame, most: int, by: list[str], order: Column | None = None, seed: int = 42) -> DataFrame:
    """At most so many rows of each group, chosen by a hash (or another order): the same on every run and partitioning."""
    order = F.xxhash64(F.lit(seed), *rows.columns) if order is None else order
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("__k") <= most).drop("__k")


def holdout(rows: DataFrame, share: float = 0.2, order: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds whether an observation is held out: floor(share * n) of each series and item, by a hash."""
    order = F.xxhash64(F.lit(seed), *rows.columns) if order is None else order
    place, n = F.row_number().over(Window.partitionBy(*KEYS).orderBy(order)), F.count("*").over(Window.partitionBy(*KEYS))
    return rows.withColumn("held_out", (place <= F.floor(n * share)).cast("int"))


def interpolation_inputs(matrix: DataFrame) -> DataFrame:
    """Times in hours; at the first time of a series every item counts as observed (with value 0 if it was not)."""
    first = F.min("minute").over(Window.partitionBy("series"))
    return matrix.withColumns({"hour": F.col("minute") / 60, "mask": F.when(F.col("minute") == first, 1).otherwise(F.col("mask"))})


def triplets(rows: DataFrame, days: int | None = None) -> DataFrame:
    """(series, obs): array of (minute, time, ind, value) in order; time scaled to -1..1 over the days, or in hours."""
    indexed = rows.join(F.broadcast(item_index(rows)), "item")  # an index of items: one row for each
    time = F.col("minute") / 60 if days is None else F.col("minute") / ((days + 1) * DAY) * 2 - 1
    return indexed.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("minute", "ind", "value", time.alias("time")))).alias("obs"))


def pad(ragged: DataFrame, length: int | None = None) -> DataFrame:
    """(series, times, values, mask): arrays filled up with zeros to one length, the longest if none is given."""
    if length is None:
        longest = ragged.agg(F.max(F.size("obs")).alias("__n"))
        ragged = ragged.crossJoin(F.broadcast(longest))  # one row
    else:
        ragged = ragged.withColumn("__n", F.lit(length))
    missing = F.greatest(F.col("__n") - F.size("obs"), F.lit(0))

    def filled(values: Column, zero: Column) -> Column:
        return F.slice(F.concat(values, F.array_repeat(zero, missing)), F.lit(1), F.col("__n"))

    ones = F.transform("obs", lambda o: F.lit(1))
    return ragged.select("series", filled(F.transform("obs", lambda o: o["time"]), F.lit(0.0)).alias("times"), filled(F.transform("obs", lambda o: o["value"]), F.lit(0.0)).alias("values"), filled(ones, F.lit(0)).alias("mask"))


def anchors(rows: DataFrame, earliest: float = 720) -> DataFrame:
    """(series, t1): distinct times of a series from the earliest on, without its last."""
    times = rows.select("series", F.col("minute").alias("t1")).distinct()
    last = F.max("t1").over(Window.partitionBy("series"))
    return times.withColumn("__last", last).filter((F.col("t1") < F.col("__last")) & (F.col("t1") >= earliest)).drop("__last")


def fixed_windows(rows: DataFrame, start: int = 20, stop: int = 360, step: int = 24, observe: float = 24, predict: float = 24) -> DataFrame:
    """(series, w): hours w with an event in [w - observe, w) and one in [w, w + predict]."""
    hour = F.col("minute") / 60
    # Only the windows that an event can belong to are made of it.
    low = F.ceil((hour - predict - start) / step)
    high = F.floor((hour + observe - start) / step)
    count = (stop - 1 - start) // step
    spread = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(count)))
    made = rows.withColumn("hour", hour).filter((F.greatest(low, F.lit(0)) <= F.least(high, F.lit(count))))
    made = made.select("series", "hour", F.explode(spread).alias("w")).withColumn("w", F.col("w") * step + start)
    before = (F.col("hour") >= F.col("w") - observe) & (F.col("hour") < F.col("w"))
    after = (F.col("hour") >= F.col("w")) & (F.col("hour") <= F.col("w") + predict)
    return made.groupBy("series", "w").agg(F.bool_or(before).alias("__b"), F.bool_or(after).alias("__a")).filter("__a and __b").select("series", "w")


def forecast_samples(rows: DataFrame, at: DataFrame, length: float = 10080, ahead: float = 1440, most: int = 1000, closed: bool = True, earliest_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Inputs (series, t1, item, minute, value, time) and targets (series, t1, item, target) of anchors (series, t1).

    Inputs are the latest events in [t1 - length, t1] (without t1 itself if not closed), their times shifted to the
    window and scaled to -1..1; targets the first value of each item in (t1, t1 + ahead] ([t1, ...] if not closed).
    """
    joined = rows.join(at.select("series", "t1"), "series").filter((F.col("minute") >= F.col("t1") - length) & (F.col("minute") <= F.col("t1") + ahead))
    now = F.col("minute") <= F.col("t1") if closed else F.col("minute") < F.col("t1")
    order = [F.col("minute"), F.col("item"), F.col("value")] if earliest_first else [F.desc("minute"), F.desc("item"), F.desc("value")]
    place = F.row_number().over(Window.partitionBy("series", "t1").orderBy(*order))
    inputs = joined.filter(now).withColumn("__k", place).filter(F.col("__k") <= most).drop("__k")
    shifted = F.col("minute") - F.greatest(F.col("t1") - length, F.lit(0.0))
    inputs = inputs.withColumn("time", shifted / length * 2 - 1)
    targets = joined.filter(~now).groupBy("series", "t1", "item").agg(F.min_by("value", F.struct("minute", "value")).alias("target"))
    return inputs, targets


def kernel_resample(rows: DataFrame, step: float, stop: float, alpha: float, sharper: float = 10.0) -> DataFrame:
    """(series, item, r, weight, value, sharp): Gaussian-kernel means of irregular observations at regular points.

    Times and points are in hours; sums under 1 divide by 1, so far from all observations the value goes to 0.
    """
    points = rows.withColumn("hour", F.col("minute") / 60).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(int(stop // step))))).withColumn("r", F.col("r") * step)
    weight = F.exp(-alpha * F.pow(F.col("hour") - F.col("r"), F.lit(2)))
    sharp = F.exp(-alpha * sharper * F.pow(F.col("hour") - F.col("r"), F.lit(2)))
    sums = points.groupBy(*KEYS, "r").agg(F.sum(weight).alias("weight"), F.sum(weight * F.col("value")).alias("__x"), F.sum(sharp).alias("__w"), F.sum(sharp * F.col("value")).alias("__y"))
    return sums.select(*KEYS, "r", "weight", (F.col("__x") / F.greatest("weight", F.lit(1.0))).alias("value"), (F.col("__y") / F.greatest("__w", F.lit(1.0))).alias("sharp"))


def static_vector(rows: DataFrame, columns: list[str], train: Column, key: str = "series", propagate_null: bool = False) -> DataFrame:
    """Columns z-scored with the population statistics of training rows (std 0 counts as 1), missing as 0, and for each
    column with missing values an indicator that it was there.

    propagate_null: a column with a missing value among training rows becomes 0 throughout.
    """
    own = [F.col(c).cast("double") for c in columns]
    inside = [F.when(train, x) for x in own]
    stats = rows.agg(
        *[x for c, v in zip(columns, inside) for x in (F.avg(v).alias(f"__m_{c}"), F.stddev_pop(v).alias(f"__s_{c}"))],
        *[F.count_if(train & x.isNull()).alias(f"__n_{c}") for c, x in zip(columns, own)],
    )
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    out = []
    for c, x in zip(columns, own):
        z = (x - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
        if propagate_null:
            z = F.when(F.col(f"__n_{c}") == 0, z)
        out += [F.coalesce(z, F.lit(0.0)).alias(f"{c}_z"), x.isNotNull().cast("int").alias(f"{c}_known")]
    return joined.select(key, *out)


def targets(rows: DataFrame, key: str = "series") -> DataFrame:
    """(key, label, share): label of each series with the share of its class."""
    counts = rows.groupBy("label").agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("__all"))
    shares = counts.crossJoin(F.broadcast(total)).select("label", (F.col("__n") / F.col("__all")).alias("share"))
    return rows.join(F.broadcast(shares), "label").select(key, "label", "share")  # a row for each class
