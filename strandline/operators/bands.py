"""Order statistics of groups of any size: bands of values, offsets of bands, and windows inside a band.

Equal values are counted together first, with partial sums. Bands are cut at approximate quantiles of each group's own
values, so they hold about as many values each wherever these lie; a group with very many values is ``BANDS`` windows, not
one. The cuts decide only what a task holds: ranks, running sums and quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bands of a group.
BANDS = 64


def counted(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, n) of the values that are neither null nor not a number. No other column is called n."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return rows.filter(known).groupBy(*by, value).agg(F.count("*").alias("n"))


def matched(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with other's further columns, joined on keys that can be null; without keys other is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(other))
    renamed = other.select(*[F.col(c).alias(f"__match_{c}") for c in keys], *[c for c in other.columns if c not in keys])
    joined = rows.join(renamed, [F.col(c).eqNullSafe(F.col(f"__match_{c}")) for c in keys], how)
    return joined.drop(*[f"__match_{c}" for c in keys])


def banded(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds ``__band``, from 0 for a group's lowest values; nulls in by are a group. rows: different values of each group."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [k / BANDS for k in range(1, BANDS)], 1000).alias("__cuts"))
    return matched(rows, cuts, by).withColumn("__band", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def placed(counts: DataFrame, value: str, by: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """counted() with ``before``, the number of rows of the group with a smaller value.

    wanted: (by..., ks): only the values at some places from 0; then only the bands that hold one are sorted. Adds k.
    """
    rows = banded(counts, value, by)
    sums = rows.groupBy(*by, "__band").agg(F.sum("n").alias("__n"))  # BANDS rows a group at most
    lower = Window.partitionBy(*by).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(lower), F.lit(0)))
    if wanted is not None:
        here = F.filter("ks", lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__n")))
        sums = matched(sums, wanted, by).withColumn("ks", here).filter(F.size("ks") > 0)
    inner = Window.partitionBy(*by, "__band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    found = matched(rows, sums.drop("__n"), [*by, "__band"]).withColumn("before", F.col("__before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    if wanted is None:
        return found.select(*by, value, "n", "before")
    return found.select(*by, value, "n", "before", F.explode(F.filter("ks", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))).alias("k"))


def ranks(counts: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """counted() with the rank of each value from 1; equal values share the mean of their ranks."""
    return placed(counts, value, by).select(*by, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def quantiles(rows: DataFrame, value: str, by: list[str], shares: Sequence[float]) -> DataFrame:
    """(by..., q<0>, q<1>...): exact quantiles, between two values by linear interpolation.

    No group's values are held together: a first pass counts by bands, then only the bands with a quantile are sorted.
    """
    counts = counted(rows, value, by)
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("__all"))
    at = [(F.col("__all") - 1) * F.lit(float(s)) for s in shares]
    places = sizes.select(*by, F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)])).alias("ks"))
    found = placed(counts, value, by, places)
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", F.col(value).cast("double")))).alias("__at"))
    out = []
    for i, p in enumerate(at):
        low, high = (F.element_at("__at", f(p).cast("long")) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * (p - F.floor(p))).alias(f"q{i}"))
    return matched(sizes, held, by).select(*by, *out)
