"""Cohorts as data: every table read once, the same members as single queries give, and a user's own cohort."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import codes as C
from strandline.plans import QUERIES, queries_cohorts, specs
from strandline.sources.fixtures import Tables
from strandline.sources.scratch import written

TABLES = ("encounters", "entities", "codes", "procedures", "stays", "events")


def members(extraction):
    return extraction.members().select("cohort", "entity", "encounter", "stay", "label")


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    """All members, and the plans of all jobs on tables that are files."""
    t = queries_cohorts.extraction(Tables(spark, sf_dir), list(queries_cohorts.registered().values()))
    files = {n: written(t.tables.get(n) if n in t.tables else getattr(t, n), f"file-{n}") for n in TABLES}
    plans = []

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return written(df, name)

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    before, specs.written = specs.written, recorded
    try:
        rows = recorded(members(specs.Extraction(t.specs, *[files[n] for n in TABLES])), "members").collect()
    finally:
        specs.written = before
    return rows, "\n".join(plans)


@pytest.mark.parametrize("table", TABLES)
def test_each_table_is_read_once(found, table):
    assert found[1].count(f"/file-{table}-") == 1


@pytest.mark.parametrize("name", queries_cohorts.REGISTERED)
def test_members_of_single_queries(spark, sf_dir, found, name):
    single = QUERIES[queries_cohorts.OTHER_NAMES.get(name, f"cohort_{name}")](spark, sf_dir)
    keys = [c for c in ("entity", "encounter", "stay", "label") if c in single.columns and not (name == "everyone_else" and c == "label")]
    assert sorted(tuple(r[c] for c in keys) for r in found[0] if r.cohort == name) == sorted(tuple(r[c] for c in keys) for r in single.collect())


def test_own_cohort_beside_registered_ones(spark, sf_dir):
    """Flags of one name with other rules, a dated flag, a measure, a comparison; nulls and no rows anywhere."""
    own = specs.CohortSpec(
        "own",
        flags={"code": specs.CodeFlag(C.matches(("A",))), "since": specs.CodeFlag(C.matches(("B",)), dated=True), "never": specs.CodeFlag(F.lit(None).cast("boolean"), "procedures")},
        measures={"highest": specs.Measure(F.col("item") == 50801, lambda _: F.max(F.when((F.col("item") == 50801) & F.col("inside"), F.col("value"))))},
        over=lambda own: {"last": ("entity", F.max(F.when(own("code"), F.col("intime"))))},
        keep=lambda own: own("code") & (F.col("intime") == own("last")) & ~own("never"),
        label=lambda own: (F.col("intime") > own("since")) & (own("highest") > 2),
    )
    registered = queries_cohorts.registered()
    t = Tables(spark, sf_dir)
    both = members(queries_cohorts.extraction(t, [*specs.chosen(["uti"], registered), own])).collect()
    stays = {r.stay: r for r in t.stay_people.collect()}
    codes = t.codes.collect()
    with_a, b_of = {r.encounter for r in codes if r.code.startswith("A")}, {r.encounter for r in codes if r.code.startswith("B")}
    admit = {r.encounter: (r.entity, r.admit) for r in t.encounters.collect()}
    since = {}
    for e in b_of:
        entity, at = admit[e]
        since[entity] = min(at, since.get(entity, at))
    events = {}
    for r in t.events.filter("item = 50801 and value is not null").collect():
        events.setdefault(r.encounter, []).append(r)
    want = []
    for s in stays.values():
        mine = [x.intime for x in stays.values() if x.entity == s.entity and x.encounter in with_a]
        if s.encounter in with_a and s.intime == max(mine):
            values = [r.value for r in events.get(s.encounter, []) if s.intime <= r.ts <= s.outtime]
            late, high = (s.entity in since) and s.intime > since[s.entity], (max(values) > 2) if values else None
            label = None if s.entity not in since and high is not False else 0 if not late or high is False else None if high is None else 1
            want.append(("own", s.entity, s.encounter, s.stay, label))
    assert sorted((tuple(r) for r in both if r.cohort == "own"), key=repr) == sorted(want, key=repr) and want
    assert {r.cohort for r in both} == {"own", "uti"}
    nothing = specs.Extraction([own, *registered.values()], *[(t.events if n == "events" else getattr(t, n)).limit(0) for n in TABLES])
    nothing.events = nothing.events.withColumn("text", F.lit("")).withColumn("is_blood", F.lit(False))
    assert members(nothing).collect() == []


def test_flags_are_packed_and_steps_dealt(spark, sf_dir, monkeypatch):
    """130 flags of three kinds: written tables hold no column for each, words meet the rows right, and steps run in as many tasks as the lines need."""
    from strandline.sources import fixtures

    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    groups = [f"{c}0{k}{d}" for c in "ABCDEFGH" for k in range(5) for d in (0, 5)][:65]
    rules = {f"own{g}": specs.CodeFlag(C.matches((g,))) for g in groups} | {f"ever{g}": specs.CodeFlag(C.matches((g,)), level="entity") for g in groups[:-1]} | {"since": specs.CodeFlag(C.matches(("H",)), dated=True)}
    spec = specs.CohortSpec("many", "encounter", flags=rules, over=lambda own: {"first": ("entity", F.min(F.when(own("everA000"), F.col("admit"))))})
    names, before = {}, specs.written

    def recorded(df, name):
        names[name] = df.columns
        return before(df, name)

    monkeypatch.setattr(specs, "written", recorded)
    t = fixtures.Tables(spark, sf_dir)
    found = queries_cohorts.extraction(t, [spec])
    rows = {r.encounter: r.asDict() for r in found.wide_encounters.collect()}
    assert names["flagged"][-3:] == ["__flags0", "__flags1", "__flags2"] and not any("__own" in c or "__ever" in c for columns in names.values() for c in columns)
    assert found.flagged().rdd.getNumPartitions() == t.parts > 4
    held = {}
    for r in t.codes.collect():
        held.setdefault(r.encounter, set()).add(r.code)
    of_entity = {}
    for r in rows.values():
        of_entity.setdefault(r["entity"], []).append(r)
    for r in rows.values():
        codes, every = held.get(r["encounter"], set()), set().union(*[held.get(x["encounter"], set()) for x in of_entity[r["entity"]]])
        assert {g for g in groups if r[f"many__own{g}"]} == codes & set(groups)
        assert {g for g in groups[:-1] if r[f"many__ever{g}"]} == every & set(groups[:-1])
        assert r["many__since"] == min((x["admit"] for x in of_entity[r["entity"]] if any(c.startswith("H") for c in held.get(x["encounter"], set()))), default=None)
        assert r["many__first"] == (min(x["admit"] for x in of_entity[r["entity"]]) if "A000" in every else None)
    assert any(r[f"many__own{groups[-1]}"] for r in rows.values())
