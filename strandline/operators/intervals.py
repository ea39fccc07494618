"""Joins of time-stamped rows with windows around encounters and stays.

Each is an equi-join on entity, encounter or stay with a range as residual condition; aggregates come before the rows
are widened. Windows around encounters meet events by entity and a piece of time, so the work of an entity grows with its
rows and not with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import hours, micros, plus_days


def piece(ts: str, width: float) -> Column:
    """Number of the piece of time, so many days long, that a time is in."""
    return F.floor(micros(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)) / (width * 8.64e10))


def lookback_events(events: DataFrame, encounters: DataFrame, days: float = 14, items: DataFrame | None = None, by_day: bool = False) -> DataFrame:
    """(entity, encounter, item, value, minute): events in the days before each encounter's end.

    One event can belong to several encounters. Minutes count from the midnight at or before the window's begin.
    Time is cut into pieces as long as a window, which so is in two of them (in three, if it touches a bound); by_day:
    into days, for entities with very many events in a window.
    """
    own = events.select("entity", "item", "ts", "value").filter("value is not null")
    if items is not None:
        own = own.join(items.select("item").distinct(), "item", "left_semi")
    width = 1.0 if by_day else max(float(days), 1.0)
    windows = encounters.select("entity", "encounter", plus_days(F.col("disch"), -days).alias("begin"), F.col("disch").alias("end"))
    windows = windows.withColumn("__piece", F.explode(F.sequence(piece("begin", width), piece("end", width))))
    # A plan takes exploded rows for as few as the encounters, and so would broadcast them: the join is told to sort.
    joined = own.withColumn("__piece", piece("ts", width)).join(windows.hint("merge"), ["entity", "__piece"]).filter("ts >= begin and ts <= end")
    minute = micros(F.date_trunc("DAY", F.col("begin")), F.col("ts")) / 6e7
    return joined.select("entity", "encounter", "item", "value", minute.alias("minute")).filter("minute >= 0")


def window_flags(rows: DataFrame, events: DataFrame, tests: dict[str, Column], key: str = "stay", anchor: str = "intime", inside: str | None = None, at: str = "ts") -> DataFrame:
    """rows with a flag for each test on ``hours``, the time of an event of the row's stay since its anchor.

    inside: end column; if given, only events between anchor and end count.
    """
    windows = rows.select(key, anchor, *([inside] if inside else [])).distinct()
    dated = events.select(key, F.col(at).alias("__at")).join(windows, key).withColumn("hours", hours(F.col(anchor), F.col("__at")))
    if inside:
        dated = dated.filter((F.col("__at") >= F.col(anchor)) & (F.col("__at") <= F.col(inside)))
    found = dated.groupBy(key).agg(*[F.bool_or(test).alias(f"__{name}") for name, test in tests.items()])
    joined = rows.join(found, key, "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col(f"__{name}"), F.lit(False)).alias(name) for name in tests])


def anchored_events(events: DataFrame, stays: DataFrame, before_hours: float, after_hours: float, key: str = "encounter", anchor: str = "intime") -> DataFrame:
    """Events of a stay's encounter from some hours before to some hours after its begin, with their hours."""
    joined = events.select(key, "item", "ts", "value").join(stays.select(key, "stay", anchor), key)
    return joined.withColumn("hours", hours(F.col(anchor), F.col("ts"))).filter(F.col("hours").between(-before_hours, after_hours)).drop(anchor)


def has_all_groups(events: DataFrame, groups: dict[str, list[int]], keys: list[str]) -> DataFrame:
    """Keys that have an event of each of several groups of items (relational division)."""
    group = F.coalesce(*[F.when(F.col("item").isin(ids), F.lit(name)) for name, ids in groups.items()])
    own = events.withColumn("grp", group).filter("grp is not null").groupBy(*keys)
    return own.agg(F.countDistinct("grp").alias("groups")).filter(F.col("groups") == len(groups)).select(*keys)


def followups(encounters: DataFrame, days: float, flags: list[str]) -> DataFrame:
    """(encounter, next_encounter, next_admit, next_<flag>...): other encounters of the entity in (end, end + days]."""
    later = encounters.select("entity", F.col("encounter").alias("next_encounter"), F.col("admit").alias("next_admit"), *[F.col(f).alias(f"next_{f}") for f in flags])
    joined = encounters.select("entity", "encounter", "disch").join(later, "entity")
    kept = joined.filter((F.col("next_encounter") != F.col("encounter")) & (F.col("next_admit") > F.col("disch")) & (F.col("next_admit") <= plus_days(F.col("disch"), days)))
    return kept.drop("entity", "disch")


def first_event_after(events: DataFrame, encounters: DataFrame, days: float, test: Column, deal: Callable[..., DataFrame] = lambda rows, *keys: rows) -> DataFrame:
    """(encounter, first_at): first fitting event of the entity in [end, end + days]; null where there is none.

    deal: deals rows by keys over as many tasks as a large input needs.
    """
    width = max(float(days), 1.0)
    windows = encounters.select("entity", "encounter", "disch", plus_days(F.col("disch"), days).alias("__until"))
    near = windows.withColumn("__piece", F.explode(F.sequence(piece("disch", width), piece("__until", width))))
    own = events.filter(test).select("entity", "ts", piece("ts", width).alias("__piece"))
    found = deal(near, "entity", "__piece").hint("merge").join(deal(own, "entity", "__piece"), ["entity", "__piece"]).filter("ts >= disch and ts <= __until")
    found = deal(found.select("encounter", "ts"), "encounter").groupBy("encounter").agg(F.min("ts").alias("first_at"))
    return deal(encounters.select("encounter"), "encounter").distinct().join(found, "encounter", "left")


def largest_rise(events: DataFrame, key: str = "stay", within: str = "INTERVAL 48 HOURS", rise: float = 0.3) -> DataFrame:
    """(key, rises): whether some value is at least rise above one of the hours before it (equal times count)."""
    least = F.expr(f"min(value) over (partition by {key} order by ts range between {within} preceding and current row)")
    return events.filter("value is not null").withColumn("least", least).groupBy(key).agg(F.bool_or(F.col("value") - F.col("least") >= rise).alias("rises"))
