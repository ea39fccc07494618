"""Scalar expressions: time differences, code chapters, bands, baseline estimates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chapter of a code by its first letter; there is no U.
CHAPTERS = {
    "A": "Infectious",
    "B": "Infectious",
    "C": "Malignant Neoplasms",
    "D": "Blood/Other Neoplasms",
    "E": "Endocrine & Metabolic",
    "F": "Mental",
    "G": "Nervous",
    "H": "Eye/Ear",
    "I": "Circulatory",
    "J": "Respiratory",
    "K": "Digestive",
    "L": "Skin",
    "M": "Musculoskeletal",
    "N": "Genitourinary",
    "O": "Pregnancy",
    "P": "perinatal",
    "Q": "Congenital",
    "R": "Symptoms and abnormal findings",
    "S": "Injury Site",
    "T": "Injury Type",
    "V": "external death causes(Transport accidents)",
    "W": "external death causes(Accidental injuries)",
    "X": "external death causes(Accidents + intentional harm)",
    "Y": "external death causes(Legal, medical, unknown intent + sequelae)",
    "Z": "Non-disease factors",
}
#: The coarser chapters of the catalog, A to Q.
CATALOG_CHAPTERS = {
    "A": "infectious",
    "B": "infectious",
    "C": "neoplasms",
    "D": "blood",
    "E": "metabolic",
    "F": "mental",
    "G": "nervous",
    "H": "sensory",
    "I": "circulatory",
    "J": "respiratory",
    "K": "digestive",
    "L": "skin",
    "M": "musculoskeletal",
    "N": "genitourinary",
    "O": "pregnancy",
    "P": "perinatal",
    "Q": "congenital",
}


def micros(a: Column, b: Column) -> Column:
    """Microseconds from a to b, by way of the interval between them (twice as fast as timestamp_diff)."""
    return ((b - a).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def hours(a: Column, b: Column) -> Column:
    return micros(a, b) / 3.6e9


def days(a: Column, b: Column) -> Column:
    """Fractional days from a to b."""
    return micros(a, b) / 8.64e10


def plus_days(ts: Column, n: Column | float) -> Column:
    """A time some (fractional) days later, to the microsecond."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * 86400).cast("decimal(18,6)"))


def chapter(code: Column, names: dict[str, str] = CHAPTERS) -> Column:
    """Chapter of a code by its first letter; null for others."""
    letters = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.try_element_at(letters, F.upper(F.substring(code, 1, 1)))


def band(value: Column, upper: Sequence[float], labels: Sequence[str], lowest: float | None = None) -> Column:
    """Right-closed bands: the first label whose upper bound the value does not exceed; the lowest bound counts in."""
    out = F.when(value.isNull() | F.isnan(value), None)
    if lowest is not None:
        out = out.when(value < lowest, None)
    for bound, label in zip(upper, labels):
        out = out.when(value <= bound, label)
    return out


def baseline_creatinine(age: Column, female: Column, black: Column, ckd: Column, first_value: Column, normal_rate: float = 75.0) -> Column:
    """The first measured value with kidney disease; else the creatinine that a normal filtration rate would have."""
    sex, race = F.when(female, 0.742).otherwise(1.0), F.when(black, 1.21).otherwise(1.0)
    estimate = F.pow((175.0 * sex * race) / (normal_rate * F.pow(age.cast("double"), F.lit(0.203))), F.lit(1 / 1.154))
    return F.when(ckd, first_value).otherwise(estimate)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
