"""Queries: sources, code predicates, joins, trajectories, labels and cohorts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import scalar
from strandline.functions.scalar import hours, plus_days
from strandline.operators import codes as C
from strandline.operators import firsts, intervals, labels, trajectory
from strandline.plans import cohorts as K
from strandline.plans import published as P
from strandline.plans.registry import ORACLES, query
from strandline.plans.specs import CohortSpec, Extraction, chosen
from strandline.schemas import CODES, COHORT_COLUMNS, EVENTS, ITEMS, STAY_EVENTS, STAYS
from strandline.sources import readers
from strandline.sources.fixtures import Tables
from strandline.sources.scratch import scratch, written


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name).cast("double"), 6).alias(alias or name)


def as_int(*names: str):
    return [F.col(n).cast("int").alias(n) for n in names]


def has(alias: str, prefixes: str = "", exact: str = "", table: str = "cod", level: str = "encounter", more: str = "") -> str:
    """SQL: whether a row has a code that begins with or equals one of some space-separated strings."""
    tests = [f"starts_with(c.code, '{p}')" for p in prefixes.split()] + [f"c.code = '{e}'" for e in exact.split()]
    return f"EXISTS (SELECT 1 FROM {table} c WHERE c.{level} = {alias}.{level} AND ({' OR '.join(tests)}) {more})"


DIED = "CAST(coalesce(coalesce(s.death, s.dod) >= s.intime AND coalesce(s.death, s.dod) <= s.intime + INTERVAL {} DAY, false) AS INT)"
FIRST = "s.intime = (SELECT min(intime) FROM {} q WHERE q.entity = s.entity)"

# --- sources -------------------------------------------------------------------------------------------------------


@query("io_encounters", "SELECT entity, encounter, admit, disch, death, died, race, round(los, 6) AS los FROM enc")
def _(t: Tables) -> DataFrame:
    return readers.with_los(t.encounters.drop("los")).select("entity", "encounter", "admit", "disch", "death", "died", "race", r6("los"))


@query("io_entities", "SELECT entity, age, gender, dod FROM ent")
def _(t: Tables) -> DataFrame:
    return readers.adults(t.entities)


#: Columns of the source files.
FILE_NAMES = {"entity": "subject_id", "encounter": "hadm_id", "code": "icd_code", "version": "icd_version", "item": "itemid", "stay": "stay_id", "unit": "first_careunit", "ts": "starttime", "d1": "D1", "d2": "D2", "rr": "RR", "diff_days": "CODE_DIFF_DAYS"}


def written_csv(rows: DataFrame, name: str, sep: str = ",") -> tuple[str, dict[str, str]]:
    """Gzip files with a header and the source's column names; their path, and the source column of each column."""
    path, names = scratch(rows.sparkSession, name), {c: FILE_NAMES.get(c, c) for c in rows.columns}
    rows.withColumnsRenamed(names).write.options(header=True, sep=sep, compression="gzip").csv(path)
    return path, names


def through_csv(rows: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """rows written as files and read by the CSV reader with a declared schema."""
    path, names = written_csv(rows, name)
    return readers.read_csv(rows.sparkSession, path, names, schema)


@query("io_codes", "SELECT entity, encounter, code, version FROM cod")
def _(t: Tables) -> DataFrame:
    return through_csv(t.codes, "diagnoses", CODES)


@query("io_procedures", "SELECT entity, encounter, code FROM px")
def _(t: Tables) -> DataFrame:
    return through_csv(t.procedures, "procedures", CODES)


@query("io_dict", "SELECT item, label FROM itm")
def _(t: Tables) -> DataFrame:
    return through_csv(t.items, "items", ITEMS)


@query("io_stays", "SELECT entity, encounter, stay, intime, outtime, round(los, 6) AS los, unit FROM st")
def _(t: Tables) -> DataFrame:
    rows = through_csv(t.stays.select("entity", "encounter", "stay", "intime", "outtime", "los", "unit"), "stays", STAYS)
    return rows.withColumn("los", r6("los"))


@query("io_proc_events", "SELECT stay, item, ts FROM pev")
def _(t: Tables) -> DataFrame:
    return through_csv(t.proc_events, "procedure-events", STAY_EVENTS)


@query("io_input_events", "SELECT stay, item, ts, value FROM iev")
def _(t: Tables) -> DataFrame:
    return through_csv(t.input_events, "input-events", STAY_EVENTS)


@query("io_code_list", "SELECT DISTINCT code FROM px ORDER BY code LIMIT 47")
def _(t: Tables) -> DataFrame:
    """A semicolon-separated file with all procedure codes in order, of which the first 47 are read."""
    path = scratch(t.spark, "code-list")
    listed = t.procedures.select(F.col("code").alias("icd_code"), F.concat(F.lit("Procedure "), "code").alias("title")).distinct()
    listed.coalesce(1).sortWithinPartitions("icd_code").write.options(header=True, sep=";").csv(path)
    return readers.read_code_list(t.spark, path, "icd_code", 47)


@query("io_split_lists", "SELECT DISTINCT split, entity FROM spl")
def _(t: Tables) -> DataFrame:
    """Three lists of ids, one id a line, written and read."""
    path = scratch(t.spark, "split-lists")
    names = ("train", "val", "test")
    for name in names:
        t.splits.filter(F.col("split") == name).select(F.col("entity").cast("string")).distinct().write.text(f"{path}/{name}")
    return readers.read_split_lists(t.spark, {name: f"{path}/{name}" for name in names})


@query("io_edges", "SELECT d1, d2, rr, diff_days FROM edg")
def _(t: Tables) -> DataFrame:
    path, names = written_csv(t.edges, "edges", "\t")
    return readers.read_edges(t.spark, path, names)


@query("ev_scan_entities", "SELECT entity, encounter, item, ts, value FROM ev WHERE value IS NOT NULL AND entity IN (SELECT entity FROM st)")
def _(t: Tables) -> DataFrame:
    return readers.events_of_entities(t.events, t.stays)


@query("ev_scan_item", "SELECT entity, encounter, item, ts, value FROM ev WHERE item = 50803")
def _(t: Tables) -> DataFrame:
    return readers.events_of_items(t.events, [50803])


@query("ev_scan_items", "SELECT entity, encounter, item, ts, value FROM ev WHERE item IN (50801, 50804, 50807)")
def _(t: Tables) -> DataFrame:
    return readers.events_of_items(t.events, [50801, 50804, 50807])


@query("ev_clean_store", "SELECT entity, encounter, item, ts, value FROM ev WHERE value IS NOT NULL AND item NOT IN (50800, 50805, 50811)")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "events")
    readers.write_event_store(t.events, path, (50800, 50805, 50811))
    return t.spark.read.schema(EVENTS).parquet(path)


@query("ev_read_pushdown", "SELECT entity, encounter, item, ts, value FROM ev WHERE value IS NOT NULL AND entity IN (SELECT entity FROM ent WHERE age > 90)")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "events")
    readers.write_event_store(t.events, path)
    return readers.read_event_store(t.spark, path, t.entities.filter("age > 90"))


@query(
    "ev_scan_until_last_end",
    """SELECT ev.entity, encounter, item, ts, value FROM ev JOIN (SELECT entity, max(disch) AS until FROM enc GROUP BY entity) u ON u.entity = ev.entity
    WHERE ts <= until AND item NOT IN (50800, 50810)""",
)
def _(t: Tables) -> DataFrame:
    return readers.events_until_last_end(t.events, t.encounters, (50800, 50810))


SUMMARY = "SELECT cohort, count(*) AS n, count(DISTINCT entity) AS entities, CAST(sum(label) AS BIGINT) AS positives, round(avg(label) * 100, 6) AS percent FROM c GROUP BY cohort"


BY_GENDER = f", c AS (SELECT CASE WHEN gender = 'F' THEN 'women' ELSE 'men' END AS cohort, s.*, {DIED.format(28)} AS label FROM sp s)"


def by_gender(t: Tables) -> DataFrame:
    return t.stay_people.withColumns({"cohort": F.when(F.col("gender") == "F", "women").otherwise("men"), "label": labels.died_within(28)})


@query("cohort_sink", BY_GENDER + "SELECT cohort, entity, encounter, stay, intime, outtime, race, round(los, 6) AS los, gender, age, dod, label FROM c")
def _(t: Tables) -> DataFrame:
    return readers.write_cohorts(by_gender(t), scratch(t.spark, "cohorts")).withColumn("los", F.round("los", 6))


@query("agg_cohort_summary", BY_GENDER + SUMMARY)
def _(t: Tables) -> DataFrame:
    return readers.cohort_summary(by_gender(t))


# --- predicates ----------------------------------------------------------------------------------------------------


@query("code_flag", f"SELECT encounter, CAST({has('s', 'A00 B')} AS INT) AS begins, CAST({has('s', exact='C021 D033')} AS INT) AS equals, CAST({has('s', 'H04', level='entity')} AS INT) AS person FROM enc s")
def _(t: Tables) -> DataFrame:
    rows = C.code_flags(t.encounters.select("entity", "encounter"), t.codes, {"begins": C.matches(("A00", "B")), "equals": C.matches(exact=("C021", "D033"))})
    return C.code_flags(rows, t.codes, {"person": C.matches(("H04",))}, level="entity").select("encounter", *as_int("begins", "equals", "person"))


VERSIONED = f"SELECT encounter, CAST({has('s', 'A0', more='AND c.version = 10')} OR {has('s', exact='A001 A012', more='AND c.version = 9')} AS INT) AS one, CAST({has('s', 'B03', more='AND c.version = 10')} AS INT) AS two FROM enc s"


@query("code_flag_versioned", VERSIONED)
def _(t: Tables) -> DataFrame:
    rules = {"one": C.matches(("A0",), version=10) | C.matches(exact=("A001", "A012"), version=9), "two": C.matches(("B03",), version=10)}
    return C.code_flags(t.encounters.select("encounter"), t.codes, rules).select("encounter", *as_int("one", "two"))


ALGEBRA = f"""SELECT entity, CAST({has('s', 'C01', level='entity', more='AND c.version = 10')} AS INT) AS pc, CAST({has('s', 'F02', level='entity', more='AND c.version = 10')} AS INT) AS bph,
    CAST(EXISTS (SELECT 1 FROM cod c WHERE c.entity = s.entity AND c.version = 10 AND c.code LIKE 'C%' AND c.code NOT LIKE 'C01%') AS INT) AS other FROM ent s"""


@query("code_flag_setalgebra", ALGEBRA)
def _(t: Tables) -> DataFrame:
    mine = C.matches(("C01",), version=10)
    rules = {"pc": mine, "bph": C.matches(("F02",), version=10), "other": C.matches(("C",), version=10) & ~mine}
    return C.code_flags(t.entities.select("entity"), t.codes, rules, level="entity").select("entity", *as_int("pc", "bph", "other"))


@query("code_pair_flags", f"SELECT encounter FROM enc s WHERE {has('s', exact='A001 B012 C023 D034')} AND {has('s', 'E0 F01', 'G021')}")
def _(t: Tables) -> DataFrame:
    rules = {"a": C.matches(exact=("A001", "B012", "C023", "D034")), "b": C.matches(("E0", "F01"), ("G021",))}
    return C.code_flags(t.encounters.select("encounter"), t.codes, rules).filter("a and b").select("encounter")


@query("code_incl_excl", f"SELECT encounter FROM enc s WHERE {has('s', 'C D0')} AND NOT {has('s', 'C04 H')}")
def _(t: Tables) -> DataFrame:
    return C.code_flags(t.encounters.select("encounter"), t.codes, {"a": C.matches(("C", "D0")), "b": C.matches(("C04", "H"))}).filter("a and not b").select("encounter")


@query(
    "code_regex_flag",
    f""", x AS (SELECT entity, encounter, CAST(EXISTS (SELECT 1 FROM px c WHERE c.encounter = s.encounter AND regexp_matches(c.code, '001|012|003')) OR {has('s', 'E042')} AS INT) AS chemo FROM enc s)
    SELECT * FROM x WHERE entity IN (SELECT entity FROM x WHERE chemo = 1)""",
)
def _(t: Tables) -> DataFrame:
    rows = C.code_flags(t.encounters.select("entity", "encounter"), t.procedures, {"a": C.matches(parts=("001", "012", "003"))})
    rows = C.code_flags(rows, t.codes, {"b": C.matches(("E042",))}).withColumn("chemo", F.col("a") | F.col("b"))
    return C.entities_with(rows, "chemo").select("entity", "encounter", *as_int("chemo"))


@query("dict_label_search", "SELECT item, label FROM itm WHERE lower(label) LIKE '%rbc%' OR lower(label) LIKE '%50804%'")
def _(t: Tables) -> DataFrame:
    return readers.items_by_label(t.items, "rbc", "50804")


@query("dict_label_both", "SELECT item, label FROM itm WHERE lower(label) LIKE '%packed%' AND lower(label) LIKE '%5080%'")
def _(t: Tables) -> DataFrame:
    return readers.items_by_label(t.items, "PACKED", "5080", every=True)


@query("text_value_regex", "SELECT p_partkey AS item, p_name AS text FROM part WHERE regexp_matches(lower(p_name), '(red|blue)\\s+w')")
def _(t: Tables) -> DataFrame:
    return t.raw("part").selectExpr("p_partkey as item", "p_name as text").filter(F.col("text").rlike(r"(?i)(RED|BLUE)\s+W"))


@query("careunit_contains", "SELECT stay, CAST(coalesce(unit LIKE '%CCU%' OR unit LIKE '%CORONARY%', false) AS INT) AS coronary FROM st")
def _(t: Tables) -> DataFrame:
    return t.stays.select("stay", F.coalesce(F.col("unit").rlike("CCU|CORONARY"), F.lit(False)).cast("int").alias("coronary"))


@query("age_los_eligibility", f"SELECT stay, CAST(age BETWEEN 18 AND 89 AS INT) AS is_age_eligible, CAST(los >= 2 AS INT) AS has_min_los, CAST({FIRST.format('sp')} AS INT) AS is_first_stay FROM sp s")
def _(t: Tables) -> DataFrame:
    return firsts.eligible(t.stay_people, 18, 89, 2).select("stay", *as_int("is_age_eligible", "has_min_los", "is_first_stay"))


@query("los_hours_fallback", "SELECT stay, round(coalesce(CASE WHEN stay % 2 = 0 THEN los END * 24, date_diff('microsecond', intime, outtime) / 3.6e9), 6) AS hours FROM st")
def _(t: Tables) -> DataFrame:
    known = F.when(F.col("stay") % 2 == 0, F.col("los"))
    return t.stays.select("stay", F.round(F.coalesce(known * 24, hours(F.col("intime"), F.col("outtime"))), 6).alias("hours"))


SEV = "(SELECT st.stay, st.intime, st.outtime, ev.item, ev.ts, ev.value, date_diff('microsecond', st.intime, ev.ts) / 3.6e9 AS h FROM ev JOIN st ON ev.encounter = st.encounter)"


@query("interval_flag", f"SELECT stay, CAST(EXISTS (SELECT 1 FROM {SEV} e WHERE e.stay = s.stay AND h >= 0 AND h < 24) AS INT) AS early, CAST(EXISTS (SELECT 1 FROM {SEV} e WHERE e.stay = s.stay AND h >= 24 AND h <= 72) AS INT) AS late FROM st s")
def _(t: Tables) -> DataFrame:
    own = t.events.join(t.stays.select("encounter", "stay"), "encounter")
    tests = {"early": (F.col("hours") >= 0) & (F.col("hours") < 24), "late": F.col("hours").between(24, 72)}
    return intervals.window_flags(t.stays, own, tests).select("stay", *as_int("early", "late"))


@query("exclude_by_code", "SELECT encounter FROM enc s WHERE NOT EXISTS (SELECT 1 FROM px c WHERE c.encounter = s.encounter AND starts_with(c.code, '002'))")
def _(t: Tables) -> DataFrame:
    return C.without_codes(t.encounters.select("encounter"), t.procedures, C.matches(("002",)))


@query("exclude_entities_of", "SELECT encounter FROM enc WHERE entity NOT IN (SELECT entity FROM st) AND entity NOT IN (SELECT entity FROM px)")
@query("cohort_all", "SELECT encounter FROM enc WHERE entity NOT IN (SELECT entity FROM st) AND entity NOT IN (SELECT entity FROM px)")
def _(t: Tables) -> DataFrame:
    return K.everyone_else(t.encounters, [t.stays, t.procedures]).select("encounter")


# --- joins ---------------------------------------------------------------------------------------------------------


@query("join_encounter_entity", "SELECT encounter, age, gender, dod FROM enc LEFT JOIN ent USING (entity)")
def _(t: Tables) -> DataFrame:
    return t.encounters.join(t.entities, "entity", "left").select("encounter", "age", "gender", "dod")


@query("join_semi", "SELECT encounter FROM enc WHERE entity IN (SELECT entity FROM ent WHERE gender = 'F')")
def _(t: Tables) -> DataFrame:
    return t.encounters.join(t.entities.filter("gender = 'F'"), "entity", "left_semi").select("encounter")


@query("join_anti", "SELECT encounter FROM enc WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.entity = enc.entity)")
def _(t: Tables) -> DataFrame:
    return t.encounters.join(t.entities, "entity", "left_anti").select("encounter")


FIRST_CODE = """(SELECT entity, admit AS first_at, code AS first_code FROM (SELECT enc.entity, admit, code, row_number() OVER (PARTITION BY enc.entity ORDER BY admit, code) AS k
    FROM cod JOIN enc ON cod.encounter = enc.encounter WHERE code LIKE 'B%') WHERE k = 1)"""


@query("join_first_code", f"SELECT stay, first_code, CAST(coalesce(intime >= first_at, false) AS INT) AS flag FROM st LEFT JOIN {FIRST_CODE} f USING (entity)")
def _(t: Tables) -> DataFrame:
    found = t.stays.join(C.first_code(t.codes, t.encounters, C.matches(("B",))), "entity", "left")
    return found.select("stay", "first_code", F.coalesce(F.col("intime") >= F.col("first_at"), F.lit(False)).cast("int").alias("flag"))


LOOKBACK = """SELECT enc.entity, enc.encounter, ev.item, ev.value, round(date_diff('microsecond', date_trunc('day', disch - INTERVAL 14 DAY), ev.ts) / 6e7, 6) AS minute
    FROM ev JOIN enc ON ev.entity = enc.entity WHERE ev.value IS NOT NULL AND ev.ts BETWEEN disch - INTERVAL 14 DAY AND disch"""


@query("join_interval_lookback", LOOKBACK)
def _(t: Tables) -> DataFrame:
    return intervals.lookback_events(t.events, t.encounters).withColumn("minute", F.round("minute", 6))


@query("join_interval_lookback_by_day", LOOKBACK)
def _(t: Tables) -> DataFrame:
    return intervals.lookback_events(t.events, t.encounters, by_day=True).withColumn("minute", F.round("minute", 6))


@query("feature_sink", f"SELECT l.*, cohort FROM ({LOOKBACK}) l JOIN spl USING (encounter)")
def _(t: Tables) -> DataFrame:
    rows = intervals.lookback_events(t.events, t.encounters).join(t.splits.select("encounter", "cohort"), "encounter")
    return readers.write_features(rows, scratch(t.spark, "features")).withColumn("minute", F.round("minute", 6))


@query("join_interval_anchor", f"SELECT stay, item, value, round(h, 6) AS hours FROM {SEV} WHERE h BETWEEN -6 AND 24")
def _(t: Tables) -> DataFrame:
    return intervals.anchored_events(t.events, t.stays, 6, 24).select("stay", "item", "value", r6("hours"))


@query("join_self_followup", "SELECT a.encounter, b.encounter AS next_encounter, b.admit AS next_admit FROM enc a JOIN enc b ON a.entity = b.entity AND a.encounter <> b.encounter AND b.admit > a.disch AND b.admit <= a.disch + INTERVAL 30 DAY")
def _(t: Tables) -> DataFrame:
    return intervals.followups(t.encounters, 30, [])


@query("join_event_followup", "SELECT a.encounter, min(e.ts) AS first_at FROM enc a LEFT JOIN ev e ON a.entity = e.entity AND e.value < 0.5 AND e.ts >= a.disch AND e.ts <= a.disch + INTERVAL 45 DAY GROUP BY a.encounter")
def _(t: Tables) -> DataFrame:
    return intervals.first_event_after(t.events, t.encounters, 45, F.col("value") < 0.5)


DIVISION = "SELECT entity, encounter FROM ev GROUP BY ALL HAVING count(*) FILTER (WHERE item IN (50800, 50801, 50802, 50803)) > 0 AND count(*) FILTER (WHERE item IN (50804, 50805, 50806)) > 0"


@query("join_relational_division", DIVISION)
def _(t: Tables) -> DataFrame:
    return intervals.has_all_groups(t.events, {"a": [50800, 50801, 50802, 50803], "b": [50804, 50805, 50806]}, ["entity", "encounter"])


@query("join_right_type", "SELECT i.item, i.label, e.encounter, e.value FROM (SELECT * FROM ev WHERE item < 50803) e RIGHT JOIN itm i USING (item)")
def _(t: Tables) -> DataFrame:
    return t.events.filter("item < 50803").join(t.items, "item", "right").select("item", "label", "encounter", "value")


@query("join_dict_label", "SELECT 'item_' || item || '_V' AS feature, item, label FROM itm WHERE item % 2 = 1")
def _(t: Tables) -> DataFrame:
    names = t.items.filter("item % 2 = 1").select(F.concat(F.lit("item_"), F.col("item").cast("string"), F.lit("_V")).alias("feature"))
    parsed = names.withColumn("item", F.regexp_extract("feature", r"item_(\d+)_", 1).try_cast("long"))
    return parsed.join(t.items, "item", "left").select("feature", "item", "label")


# --- firsts, trajectories ------------------------------------------------------------------------------------------


@query("win_next", "SELECT encounter, lead(admit) OVER w AS next_admit, lead(encounter) OVER w AS next_encounter FROM enc WINDOW w AS (PARTITION BY entity ORDER BY admit, encounter)")
def _(t: Tables) -> DataFrame:
    return firsts.with_next(t.encounters).select("encounter", "next_admit", "next_encounter")


@query("win_first_stay_ties", f"SELECT stay FROM st s WHERE {FIRST.format('st')}")
def _(t: Tables) -> DataFrame:
    return firsts.first_ties(t.stays, "entity", "intime").select("stay")


@query("win_first_row", "SELECT entity, min(encounter) AS encounter FROM enc e WHERE admit = (SELECT min(admit) FROM enc q WHERE q.entity = e.entity) GROUP BY entity")
def _(t: Tables) -> DataFrame:
    return firsts.first_row(t.encounters, "entity", "admit", "encounter").select("entity", "encounter")


GROUPS = "(SELECT enc.entity, substr(code, 1, 3) AS grp, min(admit) AS first_at FROM cod JOIN enc ON cod.encounter = enc.encounter WHERE version = 10 GROUP BY ALL)"


@query("agg_first_code", f"SELECT * FROM {GROUPS}")
def group_dates(t: Tables) -> DataFrame:
    return C.first_group_dates(t.codes, t.encounters, deal=t.dealt)


TRAJECTORY = f""", fst AS (SELECT * FROM {GROUPS}), nxt AS (SELECT *, lead(admit) OVER (PARTITION BY entity ORDER BY admit, encounter) AS next_admit FROM ppl),
tr AS (SELECT d1 || '-' || d2 AS cohort, d1, d2, n.entity, n.encounter, n.age, n.gender, n.dod, a.first_at AS d1_at, b.first_at AS d2_at,
    CAST(coalesce(b.first_at <= a.first_at + INTERVAL 1825 DAY, false) AS INT) AS label
    FROM nxt n JOIN fst a ON a.entity = n.entity JOIN edg ON edg.d1 = a.grp LEFT JOIN fst b ON b.entity = n.entity AND b.grp = edg.d2
    WHERE n.admit >= a.first_at AND n.admit <= a.first_at + to_microseconds(CAST(round(diff_days * 86400 * 1000000) AS BIGINT)) AND (b.first_at IS NULL OR n.admit < b.first_at)
    AND NOT coalesce(n.dod <= a.first_at + to_microseconds(CAST(round(diff_days * 86400 * 1000000) AS BIGINT)) AND b.first_at IS NULL, false)
    AND n.next_admit <= a.first_at + INTERVAL 1825 DAY)
"""
STATS = """, es AS (SELECT d1, d2, count(*) FILTER (WHERE label = 0) AS n_neg, count(*) FILTER (WHERE label = 1) AS n_pos, count(DISTINCT entity) AS entities,
    count(DISTINCT entity) FILTER (WHERE gender = 'F') AS females, count(DISTINCT entity) FILTER (WHERE dod IS NOT NULL) AS deaths FROM tr GROUP BY d1, d2),
pp AS (SELECT DISTINCT d1, d2, entity, age, CASE WHEN label = 1 THEN floor(date_diff('microsecond', d1_at, d2_at) / 8.64e10) END AS gap FROM tr),
pm AS (SELECT d1, d2, avg(age) AS mean_age, avg(gap) AS mean_days FROM pp GROUP BY d1, d2)
"""


def trajectories(t: Tables) -> DataFrame:
    encounters = firsts.with_next(t.people.select("entity", "encounter", "admit", "age", "gender", "dod"))
    return trajectory.trajectory_rows(encounters, written(group_dates(t), "first-dates"), trajectory.select_edges(t.edges), t.dealt)


def stats_of(t: Tables) -> DataFrame:
    rows = trajectory.edge_stats(trajectories(t))
    return rows.withColumns({"mean_age": F.round("mean_age", 6), "mean_days": F.round("mean_days", 6)})


@query("join_edge_cohort", TRAJECTORY + "SELECT cohort, entity, encounter, label FROM tr")
def _(t: Tables) -> DataFrame:
    return trajectories(t).select("cohort", "entity", "encounter", "label")


@query("agg_edge_stats", TRAJECTORY + STATS + "SELECT es.*, round(mean_age, 6) AS mean_age, round(mean_days, 6) AS mean_days FROM es JOIN pm USING (d1, d2)")
def _(t: Tables) -> DataFrame:
    return stats_of(t)


@query("min_class_filter", TRAJECTORY + STATS + "SELECT d1, d2, n_neg, n_pos FROM es WHERE n_pos > 10 AND n_neg > 50")
def _(t: Tables) -> DataFrame:
    return trajectory.large_enough(stats_of(t)).select("d1", "d2", "n_neg", "n_pos")


BIG = TRAJECTORY + STATS + "SELECT cohort, entity, encounter, label FROM tr JOIN es USING (d1, d2) WHERE n_pos > 10 AND n_neg > 50"


def large_trajectories(t: Tables) -> DataFrame:
    """The rows are written once; the statistics and the result read them."""
    rows = written(trajectories(t).select("cohort", "d1", "d2", "entity", "encounter", "admit", "age", "gender", "dod", "d1_at", "d2_at", "label"), "trajectories")
    large = trajectory.large_enough(trajectory.edge_stats(t.dealt(rows, "entity"))).select("d1", "d2")
    return rows.join(large, ["d1", "d2"], "left_semi")


@query("cohort_trajectory", BIG)
def _(t: Tables) -> DataFrame:
    return large_trajectories(t).select("cohort", "entity", "encounter", "label")


@query("edge_cohort_sink", BIG)
def _(t: Tables) -> DataFrame:
    return readers.write_cohorts(large_trajectories(t), scratch(t.spark, "edge-cohorts"), COHORT_COLUMNS).select("cohort", "entity", "encounter", "label")


@query("edge_select", "SELECT d1, d2, rr, diff_days FROM edg WHERE (d1, d2) IN (('A00', 'B01'), ('C02', 'H00'))")
def _(t: Tables) -> DataFrame:
    return trajectory.select_edges(t.edges, [("A00", "B01"), ("C02", "H00"), ("Q00", "Q01")])


# --- labels --------------------------------------------------------------------------------------------------------


@query("label_timed_mortality", f"SELECT stay, {DIED.format(28)} AS d28, {DIED.format(90)} AS d90 FROM sp s")
def _(t: Tables) -> DataFrame:
    return t.stay_people.select("stay", labels.died_within(28).alias("d28"), labels.died_within(90).alias("d90"))


@query("label_inhospital_mortality", "SELECT stay, CAST(death IS NOT NULL AS INT) AS died_here FROM st")
def _(t: Tables) -> DataFrame:
    return t.stays.select("stay", labels.died_in_hospital().cast("int").alias("died_here"))


HORIZON = "CAST(coalesce(dod >= intime AND date_diff('microsecond', intime, dod) / 8.64e10 >= {}, false) AS INT)"


@query("label_survival_horizons", f"SELECT stay, {HORIZON.format(31)} AS m1, {HORIZON.format(90)} AS m3, {HORIZON.format(365)} AS y1, {HORIZON.format(1095)} AS y3 FROM sp")
def _(t: Tables) -> DataFrame:
    return t.stay_people.select("stay", *[labels.survival(n).alias(name) for name, n in (("m1", 31), ("m3", 90), ("y1", 365), ("y3", 1095))])


CRE = """(CASE WHEN st.stay % 7 = 0 THEN 1.5 ELSE pow((175.0 * (CASE WHEN gender = 'F' THEN 0.742 ELSE 1 END) * (CASE WHEN race = 'BLACK' THEN 1.21 ELSE 1 END)) / (75.0 * pow(CAST(age AS DOUBLE), 0.203)), 1 / 1.154) END)"""


@query("scalar_baseline_creatinine", f"SELECT stay, round({CRE.replace('st.stay', 'stay')}, 6) AS baseline FROM sp")
def _(t: Tables) -> DataFrame:
    value = scalar.baseline_creatinine(F.col("age"), F.col("gender") == "F", F.col("race") == "BLACK", F.col("stay") % 7 == 0, F.lit(1.5))
    return t.stay_people.select("stay", F.round(value, 6).alias("baseline"))


# --- cohorts: the definitions with codes of the derived tables --------------------------------------------------------

MEMBER = ["entity", "encounter", "stay", "label"]


def code_sql(test: str, died: str, last: bool, where: str = "TRUE") -> str:
    """First stay before or after age and length are looked at."""
    pick = f"x AS (SELECT * FROM sp s WHERE {test}" + (f" AND {where}" if last else "") + ")"
    return f", {pick} SELECT entity, encounter, stay, {died} AS label FROM x s WHERE {FIRST.format('x')}" + ("" if last else f" AND {where}")


@query("cohort_alc_cirrhosis", code_sql(has("s", exact="A001 B012 C023 D004 E015"), DIED.format(28), True, "age BETWEEN 18 AND 120"))
def _(t: Tables) -> DataFrame:
    return K.alcoholic_cirrhosis(t.stay_people, t.codes, ("A001", "B012", "C023", "D004", "E015")).select(MEMBER)


@query("cohort_mi", code_sql(has("s", "A0 B01") + " AND (unit LIKE '%CCU%' OR unit LIKE '%CORONARY%')", DIED.format(30), False, "age BETWEEN 18 AND 120"))
def _(t: Tables) -> DataFrame:
    return K.myocardial_infarction(t.stay_people, t.codes, ("A0", "B01")).select(MEMBER)


HERE = "CAST(death IS NOT NULL AS INT)"


@query("cohort_uti", code_sql(has("s", "C0 D01"), HERE, True, "age BETWEEN 18 AND 120"))
def _(t: Tables) -> DataFrame:
    return K.urinary_infection(t.stay_people, t.codes, ("C0", "D01")).select(MEMBER)


@query("cohort_immunocompromised", code_sql(has("s", "B C0 D02"), DIED.format(28), True, "age BETWEEN 18 AND 120 AND date_diff('microsecond', intime, outtime) / 3.6e9 >= 30"))
def _(t: Tables) -> DataFrame:
    return K.immunocompromised(t.stay_people, t.codes, ("B", "C0", "D02"), min_hours=30).select(MEMBER)


@query("cohort_hf_af", code_sql(has("s", exact="A001 B012 C023 D034 E005 F016 G027") + " AND " + has("s", "A B", "C001"), HERE, False, "age BETWEEN 18 AND 120 AND los >= 1"))
def _(t: Tables) -> DataFrame:
    return K.heart_failure_fibrillation(t.stay_people, t.codes, ("A001", "B012", "C023", "D034", "E005", "F016", "G027"), ("A", "B"), ("C001",)).select(MEMBER)


@query(
    "cohort_bone_tumor",
    f""", early AS (SELECT encounter FROM sp WHERE date_diff('microsecond', intime, dod) / 8.64e10 < -1), x AS (SELECT * FROM sp s WHERE {has('s', 'E F01')} AND encounter NOT IN (SELECT encounter FROM early))
    SELECT entity, encounter, stay, CAST(coalesce(greatest(date_diff('microsecond', intime, dod) / 8.64e10, 0) >= 31, false) AND dod IS NOT NULL AS INT) AS label
    FROM x s WHERE {FIRST.format('x')} AND age BETWEEN 18 AND 120 AND los >= 1""",
)
def _(t: Tables) -> DataFrame:
    return K.bone_tumor(t.stay_people, t.codes, ("E", "F01")).select(MEMBER)


BMI = """(SELECT encounter, median(value) FILTER (WHERE item IN (50801, 50802, 50803)) AS h, median(value) FILTER (WHERE item IN (50804, 50805, 50806)) AS w FROM ev GROUP BY encounter)"""


@query("agg_median_ratio", f"SELECT encounter, round(w / pow(h / 100, 2), 6) AS bmi FROM {BMI} WHERE h IS NOT NULL OR w IS NOT NULL OR encounter IN (SELECT encounter FROM ev WHERE item BETWEEN 50801 AND 50806)")
def _(t: Tables) -> DataFrame:
    return K.body_mass(t.events, (50801, 50802, 50803), (50804, 50805, 50806)).withColumn("bmi", F.round("bmi", 6))


@query(
    "cohort_obesity_pneumonia",
    f""", x AS (SELECT * FROM sp s WHERE {has('s', 'D E F')}) SELECT entity, s.encounter, stay, {DIED.format(90)} AS label FROM x s JOIN {BMI} b ON b.encounter = s.encounter
    WHERE {FIRST.format('x')} AND w / pow(h / 100, 2) IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    return K.obesity_pneumonia(t.stay_people, t.codes, t.events, ("D", "E", "F"), (50801, 50802, 50803), (50804, 50805, 50806)).select(MEMBER)


FIRST_ENC = "(SELECT entity, min(encounter) AS encounter FROM enc e WHERE admit = (SELECT min(admit) FROM enc q WHERE q.entity = e.entity) GROUP BY entity)"


@query("cohort_pneumonia", f"SELECT entity, encounter, stay, {HERE} AS label FROM sp s WHERE {has('s', 'A B C')} AND {FIRST.format('sp')} AND age BETWEEN 18 AND 120 AND los >= 1 AND encounter IN (SELECT encounter FROM {FIRST_ENC})")
def _(t: Tables) -> DataFrame:
    return K.pneumonia(t.stay_people, t.encounters, t.codes, ("A", "B", "C")).select(MEMBER)


LIVER = K.KidneyLiverCodes((("A", "B"), ("A001",)), (("C", "D"), ("C001", "C012")), (("E003",), ("E014",)), (("H041",), ("H042",)), ("0021",))


@query(
    "cohort_liver_cirrhosis",
    f"""SELECT entity, encounter, stay, {DIED.format(28)} AS label, CAST({has('s', 'C D', more='AND version = 10')} OR {has('s', exact='C001 C012', more='AND version = 9')} AS INT) AS has_lc FROM sp s
    WHERE ({has('s', 'A B', more='AND version = 10')} OR {has('s', exact='A001', more='AND version = 9')}) AND encounter IN (SELECT encounter FROM {FIRST_ENC}) AND los * 24 >= 24 AND age BETWEEN 18 AND 120
    AND date_diff('microsecond', admit, disch) / 3.6e9 >= 24 AND NOT {has('s', 'E003', more='AND version = 10')} AND NOT {has('s', exact='E014', more='AND version = 9')}
    AND NOT {has('s', 'H041', more='AND version = 10')} AND NOT {has('s', exact='H042', more='AND version = 9')} AND NOT {has('s', '0021 3995', table='px')}""",
)
def _(t: Tables) -> DataFrame:
    return K.liver_cirrhosis(t.stay_people, t.encounters, t.codes, t.procedures, LIVER).select(*MEMBER, *as_int("has_lc"))


@query("cohort_thrombosis", f"SELECT entity, encounter, stay, CAST({has('s', 'G0')} AS INT) AS label FROM sp s WHERE {FIRST.format('sp')} AND age BETWEEN 18 AND 300 AND los >= 1 AND {has('s', 'C D')} AND NOT {has('s', 'C04')} AND NOT {has('s', 'H03')}")
def _(t: Tables) -> DataFrame:
    return K.thrombosis(t.stay_people, t.codes, ("C", "D"), ("C04",), ("G0",), ("H03",)).select(MEMBER)


@query(
    "cohort_prostate",
    f""", a AS (SELECT s.*, {has('s', 'C011', level='entity', more='AND version = 10')} AS pc, {has('s', 'F022', level='entity', more='AND version = 10')} AS bph,
    EXISTS (SELECT 1 FROM cod c WHERE c.entity = s.entity AND version = 10 AND code LIKE 'C01%' AND code NOT LIKE 'C011%') AS other FROM ppl s), x AS (SELECT * FROM a WHERE pc <> bph AND NOT other)
    SELECT entity, encounter, CAST(pc AS INT) AS label FROM x s WHERE admit = (SELECT min(admit) FROM x q WHERE q.entity = s.entity) AND gender = 'M' AND age BETWEEN 18 AND 120""",
)
def _(t: Tables) -> DataFrame:
    return K.prostate(t.people, t.codes, "C011", "F022", "C01").select("entity", "encounter", "label")


@query("agg_window_first_max", f"SELECT stay, arg_min(value, (ts, value)) FILTER (WHERE h < 24 AND value IS NOT NULL) AS first_value, max(value) FILTER (WHERE h < 24) AS max_before, max(value) FILTER (WHERE h >= 24) AS max_after FROM {SEV} WHERE item = 50801 AND h BETWEEN 0 AND 72 GROUP BY stay")
def _(t: Tables) -> DataFrame:
    return K.creatinine_features(t.stays, t.events, K.KidneyInjury(item=50801))


@query(
    "agg_pairwise_rise",
    f""", x AS (SELECT * FROM {SEV} WHERE item IN (50801, 50802, 50803) AND value IS NOT NULL)
    SELECT a.stay, CAST(bool_or(b.value - a.value >= 1) AS INT) AS rises FROM x a JOIN x b ON a.stay = b.stay AND a.ts <= b.ts AND b.ts <= a.ts + INTERVAL 48 HOUR GROUP BY a.stay""",
)
def _(t: Tables) -> DataFrame:
    own = t.events.filter("item in (50801, 50802, 50803)").join(t.stays.select("encounter", "stay"), "encounter")
    return intervals.largest_rise(own, rise=1).select("stay", *as_int("rises"))


@query(
    "cohort_aki",
    f""", e AS (SELECT * FROM {SEV}), f AS (SELECT stay, arg_min(value, (ts, value)) FILTER (WHERE h < 24 AND value IS NOT NULL) AS fv, max(value) FILTER (WHERE h >= 24) AS ma FROM e WHERE item = 50801 AND h BETWEEN 0 AND 72 GROUP BY stay),
    p AS (SELECT * FROM e WHERE item = 50801 AND h BETWEEN 24 AND 72 AND value IS NOT NULL),
    r AS (SELECT DISTINCT a.stay FROM p a JOIN p b ON a.stay = b.stay AND a.ts <= b.ts AND b.ts <= a.ts + INTERVAL 48 HOUR WHERE b.value - a.value >= 0.3),
    d AS (SELECT DISTINCT stay FROM e WHERE item = 50802 AND h BETWEEN 24 AND 72)
    SELECT s.entity, s.encounter, s.stay, CAST(d.stay IS NOT NULL OR r.stay IS NOT NULL OR coalesce(ma > 1.5 * (CASE WHEN coalesce(intime >= first_at, false) THEN fv
        ELSE pow((175.0 * (CASE WHEN gender = 'F' THEN 0.742 ELSE 1 END) * (CASE WHEN race = 'BLACK' THEN 1.21 ELSE 1 END)) / (75.0 * pow(CAST(age AS DOUBLE), 0.203)), 1 / 1.154) END), false) AS INT) AS label
    FROM sp s JOIN f ON f.stay = s.stay LEFT JOIN r ON r.stay = s.stay LEFT JOIN d ON d.stay = s.stay LEFT JOIN {FIRST_CODE} c ON c.entity = s.entity
    WHERE {FIRST.format('sp')} AND age BETWEEN 18 AND 89 AND los >= 1 AND fv <= 4""",
)
def _(t: Tables) -> DataFrame:
    done = t.events.join(t.stays.select("encounter", "stay"), "encounter")
    p = K.KidneyInjury(item=50801, dialysis=(50802,), chronic=("B",), black=("BLACK",))
    return K.acute_kidney_injury(t.stay_people, t.codes, t.encounters, t.events, done, p).select(MEMBER)


@query(
    "cohort_gi_bleed",
    f"""SELECT entity, encounter, stay, CAST(EXISTS (SELECT 1 FROM {SEV} e JOIN itm USING (item) WHERE label LIKE '%RBC%' AND e.stay = s.stay AND e.ts BETWEEN e.intime AND e.outtime AND h > 5) AS INT) AS label
    FROM sp s WHERE {has('s', exact='A001 B012 C023 D034 E005 F016 G027 H031')} AND age BETWEEN 18 AND 120""",
)
def _(t: Tables) -> DataFrame:
    inputs = t.events.join(t.stays.select("encounter", "stay"), "encounter")
    items = readers.items_by_label(t.items, "PRBC", "PACKED RBC")
    return K.transfusion(t.stay_people, t.codes, inputs, items, ("A001", "B012", "C023", "D034", "E005", "F016", "G027", "H031")).select(MEMBER)


ULCER = f"EXISTS (SELECT 1 FROM {SEV} e WHERE e.stay = s.stay AND item IN (50802, 50804) AND ts BETWEEN e.intime AND e.outtime AND h {{}})"


@query("cohort_pressure_ulcer", f"SELECT entity, encounter, stay, CAST({ULCER.format('>= 24')} AS INT) AS label FROM sp s WHERE age BETWEEN 18 AND 120 AND los >= 1 AND NOT {ULCER.format('< 24')}")
def _(t: Tables) -> DataFrame:
    own = t.events.join(t.stays.select("encounter", "stay"), "encounter")
    return K.pressure_ulcer(t.stay_people, own, (50802, 50804)).select(MEMBER)


AFIB = f"EXISTS (SELECT 1 FROM {SEV} e WHERE e.stay = s.stay AND item IN (50803, 50806) AND ts BETWEEN e.intime AND e.outtime AND h {{}})"


@query(
    "cohort_af",
    f"""SELECT entity, encounter, stay, CAST({AFIB.format('> 24')} AS INT) AS label FROM sp s WHERE {FIRST.format('sp')} AND age BETWEEN 18 AND 120 AND los >= 2 AND NOT {has('s', exact='B001 B012', level='entity')}
    AND NOT {has('s', '002', table='px')} AND NOT {AFIB.format('<= 24')}""",
)
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("item") == 50803, "Afib (Atrial Fibrillation)").when(F.col("item") == 50806, "a-flutter").otherwise("Sinus rhythm")
    rhythms = t.events.withColumn("text", text).join(t.stays.select("encounter", "stay"), "encounter")
    return K.new_fibrillation(t.stay_people, t.codes, t.procedures, rhythms, ("B001", "B012"), ("002",)).select(MEMBER)


CHEMO = K.Chemotherapy(("C",), ("001", "012"), ("E04",))
CHEMO_SQL = f""", ch AS (SELECT s.*, (EXISTS (SELECT 1 FROM px c WHERE c.encounter = s.encounter AND regexp_matches(c.code, '001|012')) OR {has('s', 'E04')}) AS chemo FROM ppl s WHERE {has('s', 'C', level='entity')}),
cc AS (SELECT * FROM ch WHERE entity IN (SELECT entity FROM ch WHERE chemo))"""
FEVER = (
    CHEMO_SQL
    + f""", nf AS (SELECT s.*, ({has('s', 'A')} AND {has('s', 'B')}) AS nf FROM cc s),
c AS (SELECT * FROM nf WHERE chemo AND NOT nf AND died = 0),
f AS (SELECT c.encounter, n.nf, n.chemo, row_number() OVER (PARTITION BY c.encounter ORDER BY n.admit, n.encounter) AS k FROM c JOIN nf n ON n.entity = c.entity AND n.encounter <> c.encounter AND n.admit > c.disch AND n.admit <= c.disch + INTERVAL {{days}} DAY),
g AS (SELECT encounter, min(k) FILTER (WHERE chemo) AS ck FROM f GROUP BY encounter),
h AS (SELECT f.encounter, count(*) AS n, any_value(ck) AS ck, count(*) FILTER (WHERE nf) AS nfs, count(*) FILTER (WHERE nf AND k < ck) AS pre, count(*) FILTER (WHERE nf AND k >= ck) AS post FROM f JOIN g USING (encounter) GROUP BY f.encounter),
l AS (SELECT c.entity, c.encounter, CASE WHEN n IS NULL AND coalesce(dod <= disch + INTERVAL {{days}} DAY, false) THEN NULL WHEN ck IS NOT NULL AND pre = 0 THEN CASE WHEN post = 0 THEN 0 END
    WHEN nfs > 0 THEN 1 WHEN n IS NULL THEN {{empty}} ELSE 0 END AS label FROM c LEFT JOIN h ON h.encounter = c.encounter)
SELECT entity, encounter, label FROM l WHERE label IS NOT NULL"""
)


@query("cohort_neutropenic_fever", FEVER.format(days=400, empty="0"))
def _(t: Tables) -> DataFrame:
    return K.neutropenic_fever(t.people, t.codes, t.procedures, CHEMO, ("A",), ("B",), 400).select("entity", "encounter", "label")


@query("cohort_neutropenic_fever_readmitted", FEVER.format(days=400, empty="NULL"))
def _(t: Tables) -> DataFrame:
    return K.neutropenic_fever(t.people, t.codes, t.procedures, CHEMO, ("A",), ("B",), 400, readmitted_only=True).select("entity", "encounter", "label")


@query(
    "cohort_aplasia",
    CHEMO_SQL
    + f""", x AS (SELECT s.*, {has('s', '000', table='px')} AS tr FROM cc s), low AS (SELECT entity, ts FROM ev WHERE value < 0.3),
c AS (SELECT * FROM x WHERE chemo AND died = 0 AND NOT tr AND NOT EXISTS (SELECT 1 FROM low WHERE low.entity = x.entity AND ts BETWEEN admit AND disch)),
n AS (SELECT c.encounter, (SELECT min(ts) FROM low WHERE low.entity = c.entity AND ts BETWEEN c.disch AND c.disch + INTERVAL 300 DAY) AS lt,
    (SELECT min(o.admit) FROM x o WHERE o.entity = c.entity AND o.tr AND o.admit BETWEEN c.disch AND c.disch + INTERVAL 300 DAY) AS tt,
    (SELECT min(o.admit) FROM x o WHERE o.entity = c.entity AND o.encounter <> c.encounter AND o.chemo AND o.admit BETWEEN c.disch AND c.disch + INTERVAL 300 DAY) AS ct,
    (SELECT count(*) FROM x o WHERE o.entity = c.entity AND o.encounter <> c.encounter AND o.admit BETWEEN c.disch AND c.disch + INTERVAL 300 DAY) AS k FROM c),
l AS (SELECT entity, c.encounter, CASE WHEN k = 0 AND coalesce(dod <= disch + INTERVAL 300 DAY, false) THEN NULL WHEN ct IS NULL THEN CAST(lt IS NOT NULL OR tt IS NOT NULL AS INT)
    WHEN lt IS NULL AND tt IS NULL THEN 0 WHEN least(lt, tt) < ct THEN 1 END AS label FROM c JOIN n USING (encounter))
SELECT entity, encounter, label FROM l WHERE label IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    return K.aplasia(t.people, t.codes, t.procedures, t.events, F.col("value") < 0.3, C.matches(("000",)), CHEMO, 300).select("entity", "encounter", "label")


MANY = ("A001", "B012", "C023", "D034", "E005", "F016", "G027")


def registered() -> dict[str, CohortSpec]:
    """Every registered cohort by name, with the codes and items of the derived tables, as the queries of single cohorts have them."""
    specs = (
        P.acute_kidney_injury(K.KidneyInjury(item=50801, dialysis=(50802,), chronic=("B",), black=("BLACK",))),
        P.alcoholic_cirrhosis(("A001", "B012", "C023", "D004", "E015")),
        P.aplasia(F.col("value") < 0.3, C.matches(("000",)), CHEMO, 300),
        P.new_fibrillation(("B001", "B012"), ("002",)),
        P.bone_tumor(("E", "F01")),
        P.transfusion(F.col("is_blood"), (*MANY, "H031")),
        P.heart_failure_fibrillation(MANY, ("A", "B"), ("C001",)),
        P.immunocompromised(("B", "C0", "D02"), min_hours=30),
        P.liver_cirrhosis(LIVER),
        P.everyone_else(),
        P.myocardial_infarction(("A0", "B01")),
        P.neutropenic_fever(CHEMO, ("A",), ("B",), 400),
        P.obesity_pneumonia(("D", "E", "F"), (50801, 50802, 50803), (50804, 50805, 50806)),
        P.pneumonia(("A", "B", "C")),
        P.prostate("C011", "F022", "C01"),
        P.thrombosis(("C", "D"), ("C04",), ("G0",), ("H03",)),
        P.pressure_ulcer((50802, 50804)),
        P.urinary_infection(("C0", "D01")),
    )
    return {s.name: s for s in specs}


#: Names in the order of the registry.
REGISTERED = ("aki", "alc_cirrhosis", "aplasia", "af", "bone_tumor", "gi_bleed", "hf_af", "immunocompromised", "liver_cirrhosis", "everyone_else", "mi", "neutropenic_fever", "obesity_pneumonia", "pneumonia", "prostate_cancer", "thrombosis", "pressure_ulcer", "uti")


def extraction(t: Tables, specs: list[CohortSpec]) -> Extraction:
    """Over the derived tables; events get their rhythm and whether they are a transfusion."""
    text = F.when(F.col("item") == 50803, "Afib (Atrial Fibrillation)").when(F.col("item") == 50806, "a-flutter").otherwise("Sinus rhythm")
    blood = readers.items_by_label(t.items, "PRBC", "PACKED RBC").select("item", F.lit(True).alias("is_blood"))
    events = t.events.withColumn("text", text).join(blood, "item", "left")
    return Extraction(specs, t.encounters, t.entities, t.codes, t.procedures, t.stays, events, t.dealt)



#: The queries of single cohorts under other names than the registry's.
OTHER_NAMES = {"everyone_else": "cohort_all", "prostate_cancer": "cohort_prostate"}


def registry_sql() -> str:
    """Every cohort's own SQL, counted. The common tables come before the first select."""
    parts = []
    for name in REGISTERED:
        label = "NULL" if name == "everyone_else" else "label"
        own = ORACLES[OTHER_NAMES.get(name, f"cohort_{name}")]
        parts.append(f"SELECT '{name}' AS cohort, count(*) AS n, CAST(count(DISTINCT encounter) AS BIGINT) AS encounters, CAST(coalesce(sum({label}), 0) AS BIGINT) AS positives FROM ({own})")
    return ", every AS (" + " UNION ALL ".join(parts) + ") SELECT * FROM every WHERE n > 0"


@query("cohort_registry", registry_sql())
def _(t: Tables) -> DataFrame:
    rows = t.dealt(extraction(t, chosen(["all"], registered())).members(), "encounter").groupBy("cohort")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("encounter").alias("encounters"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives"))
