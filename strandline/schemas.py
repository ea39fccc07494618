"""Declared columns of the tables that the operators work on, and the projection onto them.

``entity`` is a person, ``encounter`` a hospital stay of one, ``stay`` a part of it in one unit, ``code`` a diagnosis or
procedure, ``item`` a kind of measurement, an ``event`` one measurement with its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S, D, I, N = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


ENCOUNTERS = _table(("entity", L), ("encounter", L), ("admit", N), ("disch", N), ("death", N), ("died", I), ("insurance", S), ("race", S))
ENTITIES = _table(("entity", L), ("age", I), ("gender", S), ("dod", N))
CODES = _table(("kind", S), ("entity", L), ("encounter", L), ("code", S), ("version", I))
STAYS = _table(("entity", L), ("encounter", L), ("stay", L), ("intime", N), ("outtime", N), ("los", D), ("unit", S), ("last_unit", S))
EVENTS = _table(("entity", L), ("encounter", L), ("item", L), ("ts", N), ("value", D))
STAY_EVENTS = _table(("stay", L), ("item", L), ("ts", N), ("value", D))
ITEMS = _table(("item", L), ("label", S))
EDGES = _table(("d1", S), ("d2", S), ("rr", D), ("valid", I), ("diff_days", D), ("age_days", D), ("counts", L), ("female_counts", L), ("death_counts", L), ("p_direction", D))

#: Columns that a saved cohort keeps, those of them that it has.
COHORT_COLUMNS = ["cohort", "entity", "encounter", "admit", "disch", "race", "los", "gender", "age", "dod", "label"]
STAY_COHORT_COLUMNS = ["cohort", "entity", "encounter", "stay", "intime", "outtime", "race", "los", "gender", "age", "dod", "label"]


def conform(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("entity", "encounter")) -> DataFrame:
    """The declared columns that df has, in their order; ValueError if a key is missing."""
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"missing key columns: {missing}")
    return df.select(*[F.col(c) for c in columns if c in df.columns])
