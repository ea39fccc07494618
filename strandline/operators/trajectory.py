"""Code-to-code trajectory cohorts: all edges in one job.

An edge (d1, d2, days) asks who, in the days after a first code of group d1, goes on to a first code of group d2. First
dates are aggregated by entity and group before anything is joined; the edge table is small and broadcast under a
size check; what is shuffled is one row for each entity and group, and the encounters, by entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import days, plus_days

#: Edges are a parameter table; up to so many rows it is broadcast.
BROADCAST_EDGES = 100_000
FIVE_YEARS = 5 * 365


def trajectory_rows(encounters: DataFrame, first_dates: DataFrame, edges: DataFrame, deal: Callable[..., DataFrame] = lambda rows, *keys: rows) -> DataFrame:
    """Encounters of every edge's cohort with their label.

    encounters: with entity attributes and ``next_admit``; first_dates: (entity, grp, first_at), read twice. deal: deals
    rows by keys over as many tasks as a large input needs.
    An encounter counts if it begins within the edge's days after the first d1 and before the first d2, if its entity
    did not die in that time without d2, and if a next encounter begins within five years of the first d1. The label
    says whether the first d2 comes within five years.
    """
    own = edges.select("d1", "d2", "diff_days").dropna().distinct()
    if own.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:
        own = F.broadcast(own)
    one = first_dates.select("entity", F.col("grp").alias("d1"), F.col("first_at").alias("d1_at"))
    two = first_dates.select(F.col("entity").alias("e2"), F.col("grp").alias("g2"), F.col("first_at").alias("d2_at"))
    pairs = deal(one.join(own, "d1"), "entity", "d2")
    pairs = pairs.join(deal(two, "e2", "g2"), (F.col("entity") == F.col("e2")) & (F.col("d2") == F.col("g2")), "left").drop("e2", "g2")
    pairs = pairs.withColumns({"d1_until": plus_days(F.col("d1_at"), F.col("diff_days")), "d1_5y": plus_days(F.col("d1_at"), FIVE_YEARS)})
    rows = encounters.join(pairs, "entity")
    dead = F.coalesce((F.col("dod") <= F.col("d1_until")) & F.col("d2_at").isNull(), F.lit(False))
    rows = rows.filter("admit >= d1_at and admit <= d1_until and (d2_at is null or admit < d2_at) and next_admit <= d1_5y").filter(~dead)
    label = F.coalesce(F.col("d2_at") <= F.col("d1_5y"), F.lit(False)).cast("int")
    return rows.withColumns({"cohort": F.concat_ws("-", "d1", "d2"), "label": label})


def edge_stats(rows: DataFrame) -> DataFrame:
    """Per edge: rows by label; its entities, women among them, mean age, deaths; mean whole days from d1 to d2 of positives."""
    gap = F.floor(days(F.col("d1_at"), F.col("d2_at")))
    people = rows.groupBy("d1", "d2", "entity").agg(
        F.first("gender").alias("gender"),
        F.first("age").alias("age"),
        F.first("dod").alias("dod"),
        F.max(F.when(F.col("label") == 1, gap)).alias("gap"),
        F.count_if(F.col("label") == 0).alias("neg"),
        F.count_if(F.col("label") == 1).alias("pos"),
    )
    return people.groupBy("d1", "d2").agg(
        F.sum("neg").alias("n_neg"),
        F.sum("pos").alias("n_pos"),
        F.count("*").alias("entities"),
        F.count_if(F.col("gender") == "F").alias("females"),
        F.avg("age").alias("mean_age"),
        F.avg("gap").alias("mean_days"),
        F.count_if(F.col("dod").isNotNull()).alias("deaths"),
    )


def large_enough(stats: DataFrame, more_pos: int = 10, more_neg: int = 50) -> DataFrame:
    """Cohorts with more than so many positives and negatives."""
    return stats.filter((F.col("n_pos") > more_pos) & (F.col("n_neg") > more_neg))


def select_edges(edges: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """All edges, or those of some pairs."""
    own = edges.dropna(subset=["d1", "d2"]).distinct()
    if pairs is None:
        return own
    wanted = edges.sparkSession.createDataFrame(pairs, "d1 string, d2 string")
    return own.join(wanted, ["d1", "d2"], "left_semi")
