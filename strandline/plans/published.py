"""The published cohorts as specs; parameters are code lists, items and times, as in ``cohorts``.

Each says what the function of the same definition in ``cohorts`` says, for extraction in one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.scalar import baseline_creatinine, days, hours
from strandline.operators import codes as C
from strandline.operators import labels
from strandline.plans import cohorts as K
from strandline.plans.specs import CodeFlag, CohortSpec, Measure, Own


def of_age(least: float = 18, most: float = 120) -> Column:
    return F.col("age").between(least, most)


def first_stay(fits: Callable[[Own], Column] = lambda own: F.lit(True), key: str = "entity") -> Callable[[Own], dict[str, tuple[str, Column]]]:
    """The earliest begin of a fitting stay of an entity or encounter."""
    return lambda own: {"first": (key, F.min(F.when(fits(own), F.col("intime"))))}


def is_first(own: Own) -> Column:
    return F.col("intime") == own("first")


def code_mortality(name: str, flags: dict[str, Column], died: Column, good: Column | None = None, among: Column | None = None, first_last: bool = False) -> CohortSpec:
    """Stays with codes for all flags, the first of their entity before good is looked at (first_last: after it)."""
    good, among = of_age() if good is None else good, F.lit(True) if among is None else among

    def fits(own: Own) -> Column:
        test = among
        for flag in flags:
            test = test & own(flag)
        return test & good if first_last else test

    return CohortSpec(name, flags={n: CodeFlag(rule) for n, rule in flags.items()}, over=first_stay(fits), keep=lambda own: fits(own) & is_first(own) & good, label=lambda own: died)


def alcoholic_cirrhosis(exact: tuple[str, ...] = K.ALCOHOLIC_CIRRHOSIS) -> CohortSpec:
    return code_mortality("alc_cirrhosis", {"code": C.matches(exact=exact)}, labels.died_within(28), first_last=True)


def myocardial_infarction(prefixes: tuple[str, ...] = K.MYOCARDIAL_INFARCTION) -> CohortSpec:
    return code_mortality("mi", {"code": C.matches(prefixes)}, labels.died_within(30), among=F.coalesce(F.col("unit").rlike("CCU|CORONARY"), F.lit(False)))


def urinary_infection(prefixes: tuple[str, ...] = K.URINARY_INFECTION) -> CohortSpec:
    return code_mortality("uti", {"code": C.matches(prefixes)}, labels.died_in_hospital(), first_last=True)


def immunocompromised(prefixes: tuple[str, ...] = K.IMMUNOCOMPROMISED, min_hours: float = 6) -> CohortSpec:
    good = of_age() & (days(F.col("intime"), F.col("outtime")) >= min_hours / 24)
    return code_mortality("immunocompromised", {"code": C.matches(prefixes)}, labels.died_within(28), good, first_last=True)


def heart_failure_fibrillation(failure: tuple[str, ...] = K.HEART_FAILURE, prefixes: tuple[str, ...] = K.HF_AF_PREFIXES, exact: tuple[str, ...] = K.HF_AF_EXACT) -> CohortSpec:
    return code_mortality("hf_af", {"hf": C.matches(exact=failure), "af": C.matches(prefixes, exact)}, labels.died_in_hospital(), of_age() & (F.col("los") >= 1))


def bone_tumor(prefixes: tuple[str, ...] = K.BONE_TUMOR) -> CohortSpec:
    """Encounters with a death more than a day before a stay are left out."""

    def late(own: Own) -> Column:
        return own("code") & ~F.coalesce(days(F.col("last_intime"), F.col("dod")) < -1, F.lit(False))

    return CohortSpec(
        "bone_tumor",
        flags={"code": CodeFlag(C.matches(prefixes))},
        over=first_stay(late),
        keep=lambda own: late(own) & is_first(own) & of_age() & (F.col("los") >= 1),
        label=lambda own: labels.survival(31, among_dead=False),
    )


def obesity_pneumonia(prefixes: tuple[str, ...] = K.PNEUMONIA, heights: tuple[int, ...] = K.HEIGHT_ITEMS, weights: tuple[int, ...] = K.WEIGHT_ITEMS) -> CohortSpec:
    def middle(items: tuple[int, ...]) -> Measure:
        test = F.col("item").isin(*items)
        return Measure(test, lambda _: F.median(F.when(test, F.col("value"))))

    return CohortSpec(
        "obesity_pneumonia",
        flags={"code": CodeFlag(C.matches(prefixes))},
        measures={"height": middle(heights), "weight": middle(weights)},
        over=first_stay(lambda own: own("code")),
        keep=lambda own: own("code") & is_first(own) & F.try_divide(own("weight"), F.pow(own("height") / 100, F.lit(2))).isNotNull(),
        label=lambda own: labels.died_within(90),
    )


def pneumonia(prefixes: tuple[str, ...] = K.PNEUMONIA) -> CohortSpec:
    good = of_age() & (F.col("los") >= 1) & F.col("is_first_encounter")
    return CohortSpec("pneumonia", flags={"code": CodeFlag(C.matches(prefixes))}, over=first_stay(lambda own: F.col("known")), keep=lambda own: own("code") & is_first(own) & good, label=lambda own: labels.died_in_hospital())


def liver_cirrhosis(rules: K.KidneyLiverCodes = K.KidneyLiverCodes(), min_hours: float = 24) -> CohortSpec:
    flags = {n: CodeFlag(rule) for n, rule in rules.rules().items()} | {"replaced": CodeFlag(C.matches(rules.replacement), "procedures")}
    place = F.struct("intime", "stay")
    own_hours = F.coalesce(F.col("los") * 24, hours(F.col("intime"), F.col("outtime")))
    good = of_age() & (own_hours >= min_hours) & (hours(F.col("admit"), F.col("disch")) >= min_hours)

    def fits(own: Own) -> Column:
        return own("has_aki") & F.col("is_first_encounter")

    return CohortSpec(
        "liver_cirrhosis",
        flags=flags,
        over=lambda own: {"first": ("entity", F.min(F.when(fits(own) & F.col("known"), place)))},
        keep=lambda own: fits(own) & (place == own("first")) & good & ~own("has_esrd") & ~own("has_sepsis") & ~own("replaced"),
        label=lambda own: labels.died_within(28),
    )


def thrombosis(cancer: tuple[str, ...] = K.CANCER, history: tuple[str, ...] = K.CANCER_HISTORY, clots: tuple[str, ...] = K.VENOUS_THROMBOSIS, pregnancy: tuple[str, ...] = K.PREGNANCY) -> CohortSpec:
    rules = {"cancer": cancer, "history": history, "clot": clots, "pregnant": pregnancy}
    return CohortSpec(
        "thrombosis",
        flags={n: CodeFlag(C.matches(p)) for n, p in rules.items()},
        over=first_stay(lambda own: F.col("known")),
        keep=lambda own: is_first(own) & of_age(18, 300) & (F.col("los") >= 1) & own("cancer") & ~own("history") & ~own("pregnant"),
        label=lambda own: own("clot"),
    )


def acute_kidney_injury(p: K.KidneyInjury = K.KidneyInjury()) -> CohortSpec:
    test, value, at = F.col("item") == p.item, F.col("value"), F.col("hours")
    before, after = test & at.between(0, p.predict) & (at < p.observe), test & at.between(p.observe, p.predict)
    done = F.col("item").isin(*p.dialysis)

    def label(own: Own) -> Column:
        ckd = F.coalesce(F.col("intime") >= own("chronic"), F.lit(False))
        baseline = baseline_creatinine(F.col("age"), F.col("gender") == "F", F.col("race").isin(*p.black), ckd, own("first_value"))
        return F.coalesce(own("dialysis"), F.lit(False)) | F.coalesce(own("rises"), F.lit(False)) | F.coalesce(own("highest") > baseline * p.factor, F.lit(False))

    return CohortSpec(
        "aki",
        flags={"chronic": CodeFlag(C.matches(p.chronic), dated=True)},
        measures={
            "first_value": Measure(test, lambda _: F.min_by("value", F.when(before & value.isNotNull(), F.struct("ts", "value")))),
            "highest": Measure(test, lambda _: F.max(F.when(after, value))),
            "rises": Measure(test, lambda least: F.bool_or(F.when(after & value.isNotNull(), value - least >= p.rise)), within="INTERVAL 48 HOURS", part=after),
            "dialysis": Measure(done, lambda _: F.bool_or(done & at.between(p.observe, p.predict))),
        },
        over=first_stay(lambda own: F.col("known")),
        keep=lambda own: is_first(own) & of_age(18, 89) & (F.col("los") >= 1) & (own("first_value") <= p.highest),
        label=label,
    )


def transfusion(given: Column, exact: tuple[str, ...] = K.GI_BLEEDING, after_hours: float = 5) -> CohortSpec:
    """given: test on events, whether it is a transfusion."""
    return CohortSpec(
        "gi_bleed",
        flags={"code": CodeFlag(C.matches(exact=exact))},
        measures={"late": Measure(given, lambda _: F.bool_or(F.coalesce(given, F.lit(False)) & F.col("inside") & (F.col("hours") > after_hours)))},
        over=first_stay(key="encounter"),
        keep=lambda own: own("code") & of_age() & is_first(own),
        label=lambda own: F.coalesce(own("late"), F.lit(False)),
    )


def _early_and_late(test: Column, observe: float, at_bound_early: bool) -> dict[str, Measure]:
    own = F.coalesce(test, F.lit(False)) & F.col("inside")
    early = F.col("hours") <= observe if at_bound_early else F.col("hours") < observe
    return {"early": Measure(test, lambda _: F.bool_or(own & early)), "late": Measure(test, lambda _: F.bool_or(own & ~early))}


def pressure_ulcer(items: tuple[int, ...] = K.PRESSURE_ULCER_STAGE2, observe: float = 24) -> CohortSpec:
    return CohortSpec(
        "pressure_ulcer",
        measures=_early_and_late(F.col("item").isin(*items), observe, False),
        keep=lambda own: of_age() & (F.col("los") >= 1) & ~F.coalesce(own("early"), F.lit(False)),
        label=lambda own: F.coalesce(own("late"), F.lit(False)),
    )


def new_fibrillation(history: tuple[str, ...] = K.ATRIAL_FIBRILLATION, surgery: tuple[str, ...] = K.CARDIAC_SURGERY, pattern: str = K.RHYTHM_PATTERN, observe: float = 24) -> CohortSpec:
    """Events have the rhythm as ``text``."""
    return CohortSpec(
        "af",
        flags={"history": CodeFlag(C.matches(history), level="entity"), "surgery": CodeFlag(C.matches(surgery), "procedures")},
        measures=_early_and_late(F.col("text").rlike(pattern), observe, True),
        over=first_stay(lambda own: F.col("known")),
        keep=lambda own: is_first(own) & of_age() & (F.col("los") >= 2) & ~own("history") & ~own("surgery") & ~F.coalesce(own("early"), F.lit(False)),
        label=lambda own: F.coalesce(own("late"), F.lit(False)),
    )


def prostate(cancer: str = "C61", hyperplasia: str = "N40", family: str = "C") -> CohortSpec:
    mine, other = C.matches((cancer,), version=10), C.matches((hyperplasia,), version=10)
    rules = {"pc": mine, "bph": other, "other": C.matches((family,), version=10) & ~mine}

    def fits(own: Own) -> Column:
        return F.col("known") & (own("pc") != own("bph")) & ~own("other")

    return CohortSpec(
        "prostate_cancer",
        "encounter",
        flags={n: CodeFlag(rule, level="entity") for n, rule in rules.items()},
        over=lambda own: {"first": ("entity", F.min(F.when(fits(own), F.col("admit"))))},
        keep=lambda own: fits(own) & (F.col("admit") == own("first")) & of_age() & (F.col("gender") == "M"),
        label=lambda own: own("pc"),
    )


def _chemotherapy(p: K.Chemotherapy) -> dict[str, CodeFlag]:
    px, dx = C.matches(parts=p.procedure_parts), C.matches(p.diagnosis)
    return {
        "has_cancer": CodeFlag(C.matches(p.cancer), level="entity"),
        "chemo_px": CodeFlag(px, "procedures"),
        "chemo_dx": CodeFlag(dx),
        "ever_px": CodeFlag(px, "procedures", "entity"),
        "ever_dx": CodeFlag(dx, level="entity"),
    }


_WITH_CHEMOTHERAPY = "has_cancer and (ever_px or ever_dx)"


def neutropenic_fever(p: K.Chemotherapy = K.Chemotherapy(), fever: tuple[str, ...] = ("R50",), neutropenia: tuple[str, ...] = ("D70",), days_after: int = 30, readmitted_only: bool = False) -> CohortSpec:
    flags = _chemotherapy(p) | {"fever": CodeFlag(C.matches(fever)), "neutropenia": CodeFlag(C.matches(neutropenia))}

    def derive(rows, events, stays, deal):
        rows = rows.filter(_WITH_CHEMOTHERAPY).selectExpr("entity", "encounter", "admit", "disch", "died", "dod", "chemo_px or chemo_dx as chemo", "fever and neutropenia as nf")
        return K.fever_labels(rows, days_after, readmitted_only, deal)

    return CohortSpec("neutropenic_fever", "encounter", flags=flags, derive=derive)


def aplasia(low: Column, transfused: Column, p: K.Chemotherapy = K.Chemotherapy(), days_after: int = 45) -> CohortSpec:
    def derive(rows, events, stays, deal):
        rows = rows.filter(_WITH_CHEMOTHERAPY).selectExpr("entity", "encounter", "admit", "disch", "died", "dod", "chemo_px or chemo_dx as chemo", "transfusion")
        return K.aplasia_labels(rows, events, low, days_after, deal)

    return CohortSpec("aplasia", "encounter", flags=_chemotherapy(p) | {"transfusion": CodeFlag(transfused, "procedures")}, events=low, derive=derive)


def everyone_else() -> CohortSpec:
    """All encounters of entities without a stay and without a procedure; no label."""

    def derive(rows, events, stays, deal):
        return C.without_entities(rows.filter("not any_procedure"), stays).withColumn("label", F.lit(0))

    return CohortSpec("everyone_else", "encounter", flags={"any_procedure": CodeFlag(F.lit(True), "procedures", "entity")}, derive=derive, known=False)
