"""Profiles of encounters against loops over events, and what reads their input."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strandline.operators import profiles

T0 = dt.datetime(2020, 1, 1)
EVENTS = "entity long, encounter long, item long, ts timestamp_ntz"


def test_profile_equals_loops(spark):
    """Running counts of one sort; events without a time are none, events without an item are of no item."""
    rng = random.Random(3)
    ends = [(e, 10 * e + k, T0 + dt.timedelta(days=rng.randrange(60)), T0 + dt.timedelta(days=60 + rng.randrange(30))) for e in range(5) for k in range(4)]
    events = [(e, 10 * e + rng.randrange(4), rng.choice([None, 1, 2, 3]), rng.choice([None, T0 + dt.timedelta(days=rng.randrange(95))])) for e in range(4) for _ in range(12)]
    events += [(4, 40, None, T0)]
    found = profiles.encounter_profile(spark.createDataFrame(events, EVENTS), spark.createDataFrame(ends, "entity long, encounter long, admit timestamp_ntz, disch timestamp_ntz"), (5, 30))
    rows = {r.encounter: r for r in found.collect()}
    for entity, encounter, admit, disch in ends:
        own = [x for x in events if x[0] == entity and x[3] is not None and x[3] <= disch]
        if not own:
            assert encounter not in rows
            continue
        r = rows.pop(encounter)
        assert (r.first_event, r.last_event) == (min(x[3] for x in own), max(x[3] for x in own))
        assert (r.n_events, r.n_before, r.n_during) == (len(own), sum(x[3] < admit for x in own), sum(x[3] >= admit for x in own))
        assert (r.n_items, r.n_encounters) == (len({x[2] for x in own} - {None}), len({x[1] for x in own}))
        for w in (5, 30):
            near = [x for x in own if x[3] >= disch - dt.timedelta(days=w)]
            assert (r[f"n_events_{w}"], r[f"n_items_{w}"]) == (len(near), len({x[2] for x in near} - {None}))
    assert not rows


def test_profiles_are_made_once_for_all_figures(spark, tmp_path):
    """Shares, medians and quantiles read a written profile, not what it is made of again."""
    path = str(tmp_path / "profile")
    columns = ["los", "lod", "n_events", "n_items", "n_encounters", "pre_days", *[f"n_events_{w}" for w in (15, 30)]]
    spark.range(40).select(F.col("id").alias("encounter"), *[(F.col("id") * k % 7).alias(c) for k, c in enumerate(columns, 1)]).write.parquet(path)
    profile = spark.read.parquet(path)
    members = spark.range(40).select(F.col("id").alias("encounter"), (F.col("id") % 2).alias("cohort"))
    for found in (profiles.cohort_profile(profile, members, 3, (15, 30)), profiles.coverage(profile, (15, 30), (3,))):
        assert found.count() == 2 and not any(path in f for f in found.inputFiles())


def test_scaled_groups_are_made_once(spark, tmp_path):
    """Ends and values read a written table of groups; equal values are null."""
    path = str(tmp_path / "groups")
    spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", 2.0, 5.0)], "g string, x double, y double").write.parquet(path)
    found = profiles.minmax(spark.read.parquet(path), ["x", "y"])
    assert not any(path in f for f in found.inputFiles())
    assert {tuple(r) for r in found.collect()} == {("a", 0.0, None), ("b", 1.0, None), ("c", 0.5, None)}


def test_trajectories_are_dealt_by_entity_and_read_lines_once(spark, sf_dir, monkeypatch):
    """Joins and aggregates by entity run in as many tasks as the lines need, not the session's; first dates are made once."""
    from strandline.plans import queries_cohorts
    from strandline.sources import fixtures

    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    t = fixtures.Tables(spark, sf_dir)
    assert t.parts > 4
    rows = queries_cohorts.trajectories(t)
    assert rows.rdd.getNumPartitions() == t.parts
    assert not any("lineitem" in f for f in rows.inputFiles())
    assert queries_cohorts.group_dates(t).rdd.getNumPartitions() == t.parts
