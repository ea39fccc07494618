"""First and next rows of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_ties(rows: DataFrame, by: str, at: str) -> DataFrame:
    """All rows at the earliest time of their group."""
    return rows.withColumn("__place", F.rank().over(Window.partitionBy(by).orderBy(at))).filter("__place = 1").drop("__place")


def first_row(rows: DataFrame, by: str, *at: str) -> DataFrame:
    """Exactly one row of each group, the first in an order that ends with a unique column."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*at))).filter("__place = 1").drop("__place")


def flag_first(rows: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """Adds whether a row is at the earliest time of its group (ties all are)."""
    return rows.withColumn(name, F.col(at) == F.min(at).over(Window.partitionBy(by)))


def with_next(encounters: DataFrame) -> DataFrame:
    """Adds time and id of the entity's next encounter."""
    order = Window.partitionBy("entity").orderBy("admit", "encounter")
    return encounters.withColumns({"next_admit": F.lead("admit").over(order), "next_encounter": F.lead("encounter").over(order)})


def eligible(stays: DataFrame, age_min: float = 18, age_max: float = 120, min_los: float = 0) -> DataFrame:
    """Adds whether age and length of stay are in range and whether it is the entity's first stay (ties too)."""
    flags = {"is_age_eligible": F.coalesce(F.col("age").between(age_min, age_max), F.lit(False)), "has_min_los": F.coalesce(F.col("los") >= min_los, F.lit(False))}
    return flag_first(stays.withColumns(flags), "entity", "intime", "is_first_stay")
