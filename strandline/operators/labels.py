"""Outcome labels of stays and encounters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.scalar import days, plus_days


def died_within(n_days: float, begin: str = "intime") -> Column:
    """1 if the first known time of death (the recorded time, else the date) is in [begin, begin + n days]."""
    at = F.coalesce("death", "dod")
    return F.coalesce((at >= F.col(begin)) & (at <= plus_days(F.col(begin), n_days)), F.lit(False)).cast("int")


def died_in_hospital() -> Column:
    return F.col("death").isNotNull()


def survival(least_days: float, begin: str = "intime", among_dead: bool = True) -> Column:
    """1 if death came at least so many days after begin; without a date of death 0.

    Deaths before begin count as day 0; among_dead asks besides that death is not before begin.
    """
    after = F.greatest(days(F.col(begin), F.col("dod")), F.lit(0.0))
    test = F.col("dod").isNotNull() & (after >= least_days)
    return F.coalesce(test & (F.col("dod") >= F.col(begin)) if among_dead else test, F.lit(False)).cast("int")
