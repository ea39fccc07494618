"""Composed queries; importing a module of queries registers them."""

from strandline.plans import queries_cohorts, queries_series, queries_stats  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES  # noqa: F401
