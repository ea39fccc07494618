"""Cohort definitions: who is in, and the outcome. Each is a function of the tables and of its parameters.

``stays`` and ``encounters`` carry the attributes of their entity (age, gender, dod) and of their encounter. Every
result has a row for each member with ``label``; unknown flags count as false, also where they are negated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import baseline_creatinine, days, hours, plus_days
from strandline.operators import codes as C
from strandline.operators import intervals, labels
from strandline.operators.firsts import eligible, first_row, first_ties

#: Code lists of the published cohort definitions.
ALCOHOLIC_CIRRHOSIS = ("5712", "K7030", "K7031")
KIDNEY_DISEASE = ("585",)
ATRIAL_FIBRILLATION = ("42731", "42732", "I48")
CARDIAC_SURGERY = ("361", "35", "0210", "02Q", "02R")
RHYTHM_PATTERN = r"(?i)(ATRIAL\s*FIB|A[\s\-]?FIB|AFIB|\bAF\b|ATRIAL\s*FLUTTER|A[\s\-]?FLUTTER|AFLUTTER|FIB\/FLUT|FIB-?FLUT)"
BONE_TUMOR = ("1985", "C7B03", "C795")
GI_BLEEDING = (
    "5307", "5693", "5780", "5781", "5789", "53021", "53082", "53100", "53101", "53120", "53121", "53140", "53141", "53160", "53161",
    "53200", "53201", "53220", "53221", "53240", "53241", "53260", "53261", "53300", "53301", "53320", "53321", "53340", "53341", "53360",
    "53361", "53400", "53401", "53420", "53421", "53440", "53441", "53460", "53461", "53501", "53511", "53521", "53531", "53541", "53551",
    "53561", "53571", "53784", "56202", "56203", "56212", "56213", "56985",
)
HEART_FAILURE = (
    "I5021", "I5023", "I5031", "I5033", "I5041", "I5043", "I50811", "I50813", "I5022", "I5032", "I5042", "I50812",
    "42821", "42823", "42831", "42833", "42841", "42843", "42822", "42832", "42842",
)
HF_AF_PREFIXES, HF_AF_EXACT = ("I480", "I481", "I482", "I4891"), ("42731",)
IMMUNOCOMPROMISED = (
    "D80", "D81", "D82", "D83", "D84", "D89", "279", "B20", "B21", "B22", "B23", "B24", "042", "043", "044",
    "C81", "C82", "C83", "C84", "C85", "C86", "C87", "C88", "C89", "C90", "C91", "C92", "C93", "C94", "C95", "C96",
    "200", "201", "202", "203", "204", "205", "206", "207", "208", "C77", "C78", "C79", "C80", "196", "197", "198", "199",
    "Z94", "T86", "V42", "9968", "Z7952", "Z7989", "Z9221", "Z5111", "Z5112", "V580", "V5811", "V5869",
)
MYOCARDIAL_INFARCTION = ("410", "I210", "I211", "I212", "I213", "I214")
PNEUMONIA = ("480", "481", "482", "483", "484", "485", "486", "J12", "J13", "J14", "J15", "J16", "J17", "J18")
URINARY_INFECTION = ("99664", "T83511", "T8351X")
CANCER = ("C", *(str(n) for n in range(140, 209)), "2090", "2091", "2092", "2093")
CANCER_HISTORY = ("Z85",)
VENOUS_THROMBOSIS = ("I26", "I80", "I81", "I82", "4151", "451", "452", "453")
ARTERIAL_THROMBOSIS = ("I74", "444")
PREGNANCY = ("O", *(str(n) for n in range(630, 680)), "V22", "V23", "V24", "V27", "V28")
BLACK_RACES = ("BLACK/AFRICAN AMERICAN", "BLACK/AFRICAN", "BLACK/CAPE VERDEAN", "BLACK/HAITIAN")
CREATININE, RENAL_REPLACEMENT = 50912, (225802,)
PRESSURE_ULCER_STAGE2 = (552, 553, 224965, 224966)
HEIGHT_ITEMS, WEIGHT_ITEMS = (226707, 1394), (226512, 763)


def code_mortality(stays: DataFrame, codes: DataFrame, rule: Column, died: Column, age: tuple[float, float] = (18, 120), min_los: float = 0, first_last: bool = False) -> DataFrame:
    """Stays with a code, of eligible age and length, first of the entity, labelled by death.

    first_last: pick the first stay after all other filters; otherwise before age and length are looked at.
    """
    rows = eligible(C.code_flags(stays, codes, {"has_code": rule}), *age, min_los).filter("has_code")
    good = F.col("is_age_eligible") & F.col("has_min_los")
    rows = first_ties(rows.filter(good), "entity", "intime") if first_last else first_ties(rows, "entity", "intime").filter(good)
    return rows.withColumn("label", died.cast("int"))


def alcoholic_cirrhosis(stays: DataFrame, codes: DataFrame, exact: tuple[str, ...] = ALCOHOLIC_CIRRHOSIS) -> DataFrame:
    return code_mortality(stays, codes, C.matches(exact=exact), labels.died_within(28), first_last=True)


def myocardial_infarction(stays: DataFrame, codes: DataFrame, prefixes: tuple[str, ...] = MYOCARDIAL_INFARCTION) -> DataFrame:
    return code_mortality(stays.filter(F.coalesce(F.col("unit").rlike("CCU|CORONARY"), F.lit(False))), codes, C.matches(prefixes), labels.died_within(30))


def urinary_infection(stays: DataFrame, codes: DataFrame, prefixes: tuple[str, ...] = URINARY_INFECTION) -> DataFrame:
    return code_mortality(stays, codes, C.matches(prefixes), labels.died_in_hospital(), first_last=True)


def immunocompromised(stays: DataFrame, codes: DataFrame, prefixes: tuple[str, ...] = IMMUNOCOMPROMISED, min_hours: float = 6) -> DataFrame:
    """The length of a stay is taken from its begin and end."""
    rows = stays.withColumn("los", days(F.col("intime"), F.col("outtime")))
    return code_mortality(rows, codes, C.matches(prefixes), labels.died_within(28), min_los=min_hours / 24, first_last=True)


def heart_failure_fibrillation(stays: DataFrame, codes: DataFrame, failure: tuple[str, ...] = HEART_FAILURE, prefixes: tuple[str, ...] = HF_AF_PREFIXES, exact: tuple[str, ...] = HF_AF_EXACT) -> DataFrame:
    """Both conditions have to hold."""
    rows = C.code_flags(stays, codes, {"has_hf": C.matches(exact=failure), "has_af": C.matches(prefixes, exact)}).filter("has_hf and has_af")
    rows = eligible(first_ties(rows, "entity", "intime"), min_los=1).filter("is_age_eligible and has_min_los")
    return rows.withColumn("label", labels.died_in_hospital().cast("int"))


def bone_tumor(stays: DataFrame, codes: DataFrame, prefixes: tuple[str, ...] = BONE_TUMOR) -> DataFrame:
    """Encounters with a death more than a day before a stay are left out; label: at least 31 days until death."""
    early = stays.filter(days(F.col("intime"), F.col("dod")) < -1).select("encounter").distinct()
    rows = stays.join(early, "encounter", "left_anti")
    horizons = {"survival_1m": 31, "survival_3m": 90, "survival_1y": 365, "survival_3y": 1095}
    rows = rows.withColumns({name: labels.survival(n) for name, n in horizons.items()})
    return code_mortality(rows, codes, C.matches(prefixes), labels.survival(31, among_dead=False), min_los=1)


def obesity_pneumonia(stays: DataFrame, codes: DataFrame, events: DataFrame, prefixes: tuple[str, ...] = PNEUMONIA, heights: tuple[int, ...] = HEIGHT_ITEMS, weights: tuple[int, ...] = WEIGHT_ITEMS) -> DataFrame:
    """First stay with a code, if its encounter has a height and a weight (medians)."""
    rows = C.code_flags(stays, codes, {"has_code": C.matches(prefixes)}).filter("has_code")
    rows = first_ties(rows, "entity", "intime").join(body_mass(events, heights, weights), "encounter", "left").filter("bmi is not null")
    return rows.withColumn("label", labels.died_within(90))


def body_mass(events: DataFrame, heights: tuple[int, ...] = HEIGHT_ITEMS, weights: tuple[int, ...] = WEIGHT_ITEMS) -> DataFrame:
    """(encounter, bmi) from the medians of an encounter's heights (cm) and weights (kg)."""
    own = events.filter(F.col("item").isin(*heights, *weights)).groupBy("encounter")
    own = own.agg(F.median(F.when(F.col("item").isin(*heights), F.col("value"))).alias("height"), F.median(F.when(F.col("item").isin(*weights), F.col("value"))).alias("weight"))
    return own.select("encounter", F.try_divide("weight", F.pow(F.col("height") / 100, F.lit(2))).alias("bmi"))


def pneumonia(stays: DataFrame, encounters: DataFrame, codes: DataFrame, prefixes: tuple[str, ...] = PNEUMONIA) -> DataFrame:
    """First encounter and first stay of all the entity's, with a code."""
    first = first_row(encounters, "entity", "admit", "encounter").select("encounter")
    rows = eligible(C.code_flags(stays, codes, {"has_code": C.matches(prefixes)}), min_los=1).join(first, "encounter", "left_semi")
    return rows.filter("has_code and is_first_stay and is_age_eligible and has_min_los").withColumn("label", labels.died_in_hospital().cast("int"))


@dataclass(frozen=True)
class KidneyLiverCodes:
    """Per condition: prefixes of version 10, exact codes of version 9. The defaults are fixed values too."""

    aki: tuple[tuple[str, ...], tuple[str, ...]] = (("N17",), ("5845", "5846", "5847", "5848", "5849"))
    cirrhosis: tuple[tuple[str, ...], tuple[str, ...]] = (("K703", "K717", "K74"), ("5712", "5715", "5716"))
    esrd: tuple[tuple[str, ...], tuple[str, ...]] = (("N186",), ("5856",))
    sepsis: tuple[tuple[str, ...], tuple[str, ...]] = (("A40", "A41", "R652"), ("99591", "99592", "78552"))
    replacement: tuple[str, ...] = ("5A1D", "3995")

    def rules(self) -> dict[str, Column]:
        pairs = {"has_aki": self.aki, "has_lc": self.cirrhosis, "has_esrd": self.esrd, "has_sepsis": self.sepsis}
        return {name: C.matches(prefixes=ten, version=10) | C.matches(exact=nine, version=9) for name, (ten, nine) in pairs.items()}


def liver_cirrhosis(stays: DataFrame, encounters: DataFrame, codes: DataFrame, procedures: DataFrame | None, rules: KidneyLiverCodes = KidneyLiverCodes(), min_hours: float = 24) -> DataFrame:
    """Kidney injury in the first encounter, its first stay; ``has_lc`` marks the second, smaller cohort."""
    first = first_row(encounters, "entity", "admit", "encounter").select("encounter")
    rows = C.code_flags(stays, codes, rules.rules()).join(first, "encounter", "left_semi").filter("has_aki")
    rows = eligible(first_row(rows, "entity", "intime", "stay"))
    own_hours = F.coalesce(F.col("los") * 24, hours(F.col("intime"), F.col("outtime")))
    rows = rows.filter((own_hours >= min_hours) & (hours(F.col("admit"), F.col("disch")) >= min_hours)).filter("is_age_eligible and not has_esrd and not has_sepsis")
    if procedures is not None:
        rows = C.without_codes(rows, procedures, C.matches(rules.replacement))
    return rows.withColumn("label", labels.died_within(28))


def thrombosis(stays: DataFrame, codes: DataFrame, cancer: tuple[str, ...] = CANCER, history: tuple[str, ...] = CANCER_HISTORY, clots: tuple[str, ...] = VENOUS_THROMBOSIS, pregnancy: tuple[str, ...] = PREGNANCY) -> DataFrame:
    rules = {"cancer_code": C.matches(cancer), "cancer_history": C.matches(history), "clot": C.matches(clots), "is_pregnant": C.matches(pregnancy)}
    rows = eligible(C.code_flags(stays, codes, rules), 18, 300, 1)
    rows = rows.filter("is_first_stay and is_age_eligible and has_min_los and cancer_code and not cancer_history and not is_pregnant")
    return rows.withColumn("label", F.col("clot").cast("int"))


def prostate(encounters: DataFrame, codes: DataFrame, cancer: str = "C61", hyperplasia: str = "N40", family: str = "C") -> DataFrame:
    """Men with one of two conditions, not both, and no other code of the cancer's family; earliest encounter."""
    mine, other = C.matches((cancer,), version=10), C.matches((hyperplasia,), version=10)
    rules = {"has_pc": mine, "has_bph": other, "has_other": C.matches((family,), version=10) & ~mine}
    rows = C.code_flags(encounters, codes, rules, level="entity").filter("has_pc <> has_bph and not has_other")
    rows = first_ties(rows, "entity", "admit").filter("age between 18 and 120 and gender = 'M'")
    return rows.withColumn("label", F.col("has_pc").cast("int"))


def everyone_else(encounters: DataFrame, cohorts: Sequence[DataFrame]) -> DataFrame:
    """All encounters of entities that are in none of the cohorts; label 0."""
    return C.without_entities(encounters, *cohorts).withColumn("label", F.lit(0))


@dataclass(frozen=True)
class KidneyInjury:
    item: int = CREATININE
    dialysis: tuple[int, ...] = RENAL_REPLACEMENT
    chronic: tuple[str, ...] = KIDNEY_DISEASE
    black: tuple[str, ...] = BLACK_RACES
    observe: float = 24.0
    predict: float = 72.0
    highest: float = 4.0
    rise: float = 0.3
    factor: float = 1.5


def creatinine_features(stays: DataFrame, events: DataFrame, p: KidneyInjury = KidneyInjury()) -> DataFrame:
    """(stay, first_value, max_before, max_after): first and largest value in [0, observe) and largest in [observe, predict] hours."""
    rows = intervals.anchored_events(events.filter(F.col("item") == p.item), stays, 0, p.predict)
    before, after = F.col("hours") < p.observe, F.col("hours") >= p.observe
    known = F.col("value").isNotNull()
    first = F.min_by("value", F.when(before & known, F.struct("ts", "value")))
    return rows.groupBy("stay").agg(first.alias("first_value"), F.max(F.when(before, F.col("value"))).alias("max_before"), F.max(F.when(after, F.col("value"))).alias("max_after"))


def acute_kidney_injury(stays: DataFrame, codes: DataFrame, encounters: DataFrame, events: DataFrame, procedures: DataFrame, p: KidneyInjury = KidneyInjury()) -> DataFrame:
    """A first value that is not high, then dialysis, a rise within 48 hours, or a value above a multiple of the baseline."""
    rows = eligible(stays, 18, 89, 1)
    rows = rows.join(C.first_code(codes, encounters, C.matches(p.chronic)), "entity", "left")
    rows = rows.join(creatinine_features(stays, events, p), "stay", "left")
    after = intervals.anchored_events(events.filter(F.col("item") == p.item), stays, -p.observe, p.predict)
    rows = rows.join(intervals.largest_rise(after, rise=p.rise), "stay", "left")
    inside = F.col("hours").between(p.observe, p.predict)
    rows = intervals.window_flags(rows, procedures.filter(F.col("item").isin(*p.dialysis)), {"dialysis": inside})
    ckd = F.coalesce(F.col("intime") >= F.col("first_at"), F.lit(False))
    baseline = baseline_creatinine(F.col("age"), F.col("gender") == "F", F.col("race").isin(*p.black), ckd, F.col("first_value"))
    above = F.coalesce(F.col("max_after") > baseline * p.factor, F.lit(False))
    rows = rows.filter("is_age_eligible and is_first_stay and has_min_los").filter(F.col("first_value") <= p.highest)
    return rows.withColumn("label", (F.col("dialysis") | F.coalesce("rises", F.lit(False)) | above).cast("int"))


def transfusion(stays: DataFrame, codes: DataFrame, inputs: DataFrame, items: DataFrame, exact: tuple[str, ...] = GI_BLEEDING, after_hours: float = 5) -> DataFrame:
    """Bleeding: first stay of its encounter; a transfusion in the stay later than some hours after its begin."""
    own = inputs.join(items.select("item").distinct(), "item", "left_semi")
    rows = eligible(C.code_flags(stays, codes, {"has_code": C.matches(exact=exact)})).filter("has_code and is_age_eligible")
    rows = first_ties_of_all(rows, stays)
    rows = intervals.window_flags(rows, own, {"late": F.col("hours") > after_hours}, inside="outtime")
    return rows.withColumn("label", F.col("late").cast("int"))


def first_ties_of_all(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """Rows that are at the earliest begin of all stays of their encounter."""
    least = stays.groupBy("encounter").agg(F.min("intime").alias("least"))
    return rows.join(least, "encounter").filter("intime = least").drop("least")


def pressure_ulcer(stays: DataFrame, events: DataFrame, items: tuple[int, ...] = PRESSURE_ULCER_STAGE2, observe: float = 24) -> DataFrame:
    """No such event in the stay's first hours; label: one later in the stay."""
    tests = {"early": F.col("hours") < observe, "late": F.col("hours") >= observe}
    rows = intervals.window_flags(eligible(stays, min_los=1), events.filter(F.col("item").isin(*items)), tests, inside="outtime")
    return rows.filter("is_age_eligible and has_min_los and not early").withColumn("label", F.col("late").cast("int"))


def new_fibrillation(stays: DataFrame, codes: DataFrame, procedures: DataFrame, rhythms: DataFrame, history: tuple[str, ...] = ATRIAL_FIBRILLATION, surgery: tuple[str, ...] = CARDIAC_SURGERY, pattern: str = RHYTHM_PATTERN, observe: float = 24) -> DataFrame:
    """rhythms: (stay, ts, text). First stay, no history of the entity, no surgery in the encounter, no early rhythm."""
    rows = C.code_flags(stays, codes, {"has_history": C.matches(history)}, level="entity")
    rows = eligible(C.code_flags(rows, procedures, {"has_surgery": C.matches(surgery)}), min_los=2)
    rows = rows.filter("is_first_stay and is_age_eligible and has_min_los and not has_history and not has_surgery")
    tests = {"early": F.col("hours") <= observe, "late": F.col("hours") > observe}
    rows = intervals.window_flags(rows, rhythms.filter(F.col("text").rlike(pattern)), tests, inside="outtime")
    return rows.filter("not early").withColumn("label", F.col("late").cast("int"))


@dataclass(frozen=True)
class Chemotherapy:
    """Which encounters are chemotherapy of an entity with cancer."""

    cancer: tuple[str, ...] = ("C",)
    procedure_parts: tuple[str, ...] = ()
    diagnosis: tuple[str, ...] = ("Z5111",)


def with_chemotherapy(encounters: DataFrame, codes: DataFrame, procedures: DataFrame, p: Chemotherapy) -> DataFrame:
    """Encounters of entities with cancer and at least one chemotherapy, with a flag ``chemo``."""
    rows = C.code_flags(encounters, codes, {"has_cancer": C.matches(p.cancer)}, level="entity").filter("has_cancer")
    rows = C.code_flags(rows, procedures, {"chemo_px": C.matches(parts=p.procedure_parts)})
    rows = C.code_flags(rows, codes, {"chemo_dx": C.matches(p.diagnosis)}).withColumn("chemo", F.col("chemo_px") | F.col("chemo_dx"))
    return C.entities_with(rows, "chemo")


def neutropenic_fever(
    encounters: DataFrame, codes: DataFrame, procedures: DataFrame, p: Chemotherapy = Chemotherapy(), fever: tuple[str, ...] = ("R50",), neutropenia: tuple[str, ...] = ("D70",), days_after: int = 30, readmitted_only: bool = False
) -> DataFrame:
    """Chemotherapy encounters without fever; label: a readmission with neutropenic fever before the next chemotherapy."""
    rows = C.code_flags(with_chemotherapy(encounters, codes, procedures, p), codes, {"fever": C.matches(fever), "neutropenia": C.matches(neutropenia)})
    return fever_labels(rows.withColumn("nf", F.col("fever") & F.col("neutropenia")), days_after, readmitted_only)


def fever_labels(rows: DataFrame, days_after: int = 30, readmitted_only: bool = False, deal: Callable[..., DataFrame] = lambda rows, *keys: rows) -> DataFrame:
    """For encounters with flags ``chemo`` and ``nf``: those with chemotherapy and without fever, with their label.

    Of the readmissions in the days after, only those before the first with chemotherapy decide. If none of these has
    fever, fever at or after that chemotherapy leaves the encounter out. Death without readmission leaves it out too.
    deal: deals rows by keys over as many tasks as a large input needs.
    """
    later = deal(intervals.followups(deal(rows, "entity"), days_after, ["chemo", "nf"]), "encounter")
    place = F.struct("next_admit", "next_encounter")
    per = later.groupBy("encounter").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("next_chemo"), place)).alias("chemo_at"),
        F.min(F.when(F.col("next_nf"), place)).alias("nf_first"),
        F.max(F.when(F.col("next_nf"), place)).alias("nf_last"),
    )
    own = deal(rows.filter("chemo and not nf and died = 0"), "encounter").join(per, "encounter", "left")
    none, split, any_nf = F.col("n").isNull(), F.col("chemo_at").isNotNull(), F.col("nf_first").isNotNull()
    before = F.coalesce(F.col("nf_first") < F.col("chemo_at"), F.lit(False))
    gone = none & F.coalesce(F.col("dod") <= plus_days(F.col("disch"), days_after), F.lit(False))
    label = (
        F.when(gone, None)
        .when(split & ~before, F.when(any_nf, None).otherwise(0))
        .when(any_nf, 1)
        .when(none & F.lit(readmitted_only), None)
        .otherwise(0)
    )
    return own.withColumn("label", label).filter("label is not null")


def aplasia(encounters: DataFrame, codes: DataFrame, procedures: DataFrame, events: DataFrame, low: Column, transfused: Column, p: Chemotherapy = Chemotherapy(), days_after: int = 45) -> DataFrame:
    """Chemotherapy encounters without aplasia; label: a low count or transfusion in the days after, before the next chemotherapy.

    low: test on events; transfused: test on procedure codes. One row for each encounter, however many procedures it has.
    """
    rows = C.code_flags(with_chemotherapy(encounters, codes, procedures, p), procedures, {"transfusion": transfused})
    return aplasia_labels(rows, events, low, days_after)


def aplasia_labels(rows: DataFrame, events: DataFrame, low: Column, days_after: int = 45, deal: Callable[..., DataFrame] = lambda rows, *keys: rows) -> DataFrame:
    """For encounters with flags ``chemo`` and ``transfusion``: those with chemotherapy and without aplasia, with their label.

    deal: deals rows by keys over as many tasks as a large input needs.
    """
    counts = events.filter(low).select("entity", "ts")
    of_entity = deal(rows, "entity")
    now = of_entity.select("encounter", "entity", "admit", "disch").join(deal(counts, "entity"), "entity").filter("ts between admit and disch").select("encounter")
    now = deal(now, "encounter").distinct().withColumn("low_now", F.lit(True))
    later_low = intervals.first_event_after(events, rows, days_after, low, deal)
    other = of_entity.select("entity", F.col("encounter").alias("e2"), F.col("admit").alias("a2"), F.col("chemo").alias("c2"), F.col("transfusion").alias("t2"))
    near = of_entity.select("entity", "encounter", "disch").join(other, "entity").filter((F.col("a2") >= F.col("disch")) & (F.col("a2") <= plus_days(F.col("disch"), days_after)))
    strange = F.col("e2") != F.col("encounter")
    per = deal(near, "encounter").groupBy("encounter").agg(F.count_if(strange).alias("n"), F.min(F.when(strange & F.col("c2"), F.col("a2"))).alias("chemo_at"), F.min(F.when(F.col("t2"), F.col("a2"))).alias("transfused_at"))
    own = deal(rows, "encounter").join(now, "encounter", "left").join(later_low, "encounter", "left").join(per, "encounter", "left")
    own = own.filter("chemo and died = 0 and not transfusion").filter(F.col("low_now").isNull())
    next_at = F.least("first_at", "transfused_at")
    empty = F.coalesce(F.col("n"), F.lit(0)) == 0
    gone = empty & F.coalesce(F.col("dod") <= plus_days(F.col("disch"), days_after), F.lit(False))
    label = (
        F.when(gone, None)
        .when(F.col("chemo_at").isNull(), next_at.isNotNull().cast("int"))
        .when(next_at.isNull(), 0)
        .when(next_at < F.col("chemo_at"), 1)
    )
    return own.withColumn("label", label).filter("label is not null")
