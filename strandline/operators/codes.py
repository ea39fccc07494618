"""Membership by diagnosis and procedure codes: all flags of a table in one aggregate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(code: Column) -> Column:
    """A code without dots, in upper case."""
    return F.upper(F.replace(code, F.lit("."), F.lit("")))


def matches(prefixes: tuple[str, ...] = (), exact: tuple[str, ...] = (), parts: tuple[str, ...] = (), version: int | None = None, code: str = "code") -> Column:
    """Whether a code begins with, equals or contains one of several strings; of one code version, or of any."""
    own = plain(F.col(code))
    tests = [F.startswith(own, F.lit(p)) for p in prefixes]
    if exact:
        tests.append(own.isin(*exact))
    if parts:
        tests.append(own.rlike("|".join(parts)))
    test = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    return test if version is None else (F.col("version") == version) & test


def code_flags(rows: DataFrame, codes: DataFrame, rules: dict[str, Column], level: str = "encounter") -> DataFrame:
    """rows with a boolean column for each rule: whether the row's encounter (or entity) has a code that fits.

    The codes are aggregated once for all rules and before the join, so rows are not multiplied; no code is false.
    """
    found = codes.filter(F.col(level).isNotNull()).groupBy(level).agg(*[F.bool_or(F.coalesce(test, F.lit(False))).alias(f"__{name}") for name, test in rules.items()])
    joined = rows.join(found, level, "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col(f"__{name}"), F.lit(False)).alias(name) for name in rules])


def entities_with(rows: DataFrame, flag: str) -> DataFrame:
    """Rows of the entities that have at least one row with the flag."""
    return rows.join(rows.filter(F.col(flag)).select("entity").distinct(), "entity", "left_semi")


def without_codes(rows: DataFrame, codes: DataFrame, rule: Column, level: str = "encounter") -> DataFrame:
    """Rows whose encounter has no fitting code."""
    return rows.join(codes.filter(rule).select(level).distinct(), level, "left_anti")


def without_entities(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of entities that none of the other tables has."""
    for other in others:
        rows = rows.join(other.select("entity").distinct(), "entity", "left_anti")
    return rows


def first_code(codes: DataFrame, encounters: DataFrame, rule: Column) -> DataFrame:
    """(entity, first_code, first_at): the first admission of an entity with a fitting code; of its codes the smallest."""
    dated = codes.filter(rule).join(encounters.select("encounter", "admit"), "encounter").filter("admit is not null")
    return dated.groupBy("entity").agg(F.min_by("code", F.struct("admit", "code")).alias("first_code"), F.min("admit").alias("first_at"))


def first_group_dates(codes: DataFrame, encounters: DataFrame, version: int = 10, size: int = 3, deal: Callable[..., DataFrame] = lambda rows, *keys: rows) -> DataFrame:
    """(entity, grp, first_at): first admission with a code of each group, by the code's first characters.

    deal: deals rows by keys over as many tasks as a large input needs.
    """
    own = codes.filter(F.col("version") == version).select("encounter", F.substring(plain(F.col("code")), 1, size).alias("grp")).distinct()
    dated = own.join(encounters.select("entity", "encounter", "admit"), "encounter")
    return deal(dated, "entity").groupBy("entity", "grp").agg(F.min("admit").alias("first_at"))
