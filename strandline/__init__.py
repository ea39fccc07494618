"""Cohort and longitudinal-feature analytics on Spark."""
