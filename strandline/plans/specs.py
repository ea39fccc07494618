"""Cohorts as data: what each asks of codes, events and stays, and one job that extracts all of them.

A spec names its flags (rules on codes), its measures (aggregates of a stay's events), what it compares over an entity or
encounter (such as the earliest fitting stay), who is kept, and the label. ``Extraction`` collects the flags of all
specs into one aggregate of codes and one of procedures, their event rows into one filter, and their measures into one
aggregate, so that each table is read once however many cohorts there are; what is left are rows of encounters and of
stays with a column for each flag, from which one pass makes the members of all cohorts.

Comparisons over an entity are aggregates with partial sums that are joined back, so no entity has to fit a task.
Column names of a spec are its own: two specs can use the same name for different rules. Unknown flags count as false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import hours
from strandline.sources.scratch import written

#: Flags that a packed column holds: the bits of a long but its sign.
WORD = 63

#: A spec's own column by its name.
Own = Callable[[str], Column]


@dataclass(frozen=True)
class CodeFlag:
    """Whether the row's encounter (or entity) has a code that fits; dated: the first admission of its entity with one."""

    rule: Column
    table: str = "codes"
    level: str = "encounter"
    dated: bool = False


@dataclass(frozen=True)
class Measure:
    """An aggregate of the events of a stay's encounter.

    rows: which events it needs, by their own columns. value: the aggregate, of events with ``hours`` since the stay's
    begin and ``inside``, whether they are in the stay; it gets the least ``value`` of the events of part in the time
    within before each event (or null).
    """

    rows: Column
    value: Callable[[Column], Column]
    within: str | None = None
    part: Column | None = None


@dataclass(frozen=True)
class CohortSpec:
    """One cohort of stays or of encounters.

    over: names and (key, aggregate) of what is compared among rows with one entity or encounter. derive: instead of keep
    and label, a function of (encounters with their flags under the spec's names, events, stays, deal) for cohorts that
    need joins of encounters; deal deals rows by keys, as ``Extraction``'s. known: only entities with attributes (adults) are members.
    """

    name: str
    level: str = "stay"
    flags: Mapping[str, CodeFlag] = field(default_factory=dict)
    measures: Mapping[str, Measure] = field(default_factory=dict)
    over: Callable[[Own], Mapping[str, tuple[str, Column]]] = lambda own: {}
    keep: Callable[[Own], Column] = lambda own: F.lit(True)
    label: Callable[[Own], Column] = lambda own: F.lit(None)
    events: Column | None = None
    derive: Callable[[DataFrame, DataFrame, DataFrame, Callable[..., DataFrame]], DataFrame] | None = None
    known: bool = True

    def own(self, name: str) -> Column:
        return F.col(self.column(name))

    def column(self, name: str) -> str:
        return f"{self.name}__{name}"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


class Extraction:
    """All members of some specs.

    encounters: entity, encounter, admit, ...; entities: entity with attributes; codes and procedures: encounter, code, ...;
    stays: encounter, stay, intime, outtime, ...; events: entity, encounter, item, ts, value, ...; deal: deals rows by keys
    over as many tasks as a large input needs.
    """

    def __init__(
        self, specs: Iterable[CohortSpec], encounters: DataFrame, entities: DataFrame, codes: DataFrame, procedures: DataFrame, stays: DataFrame, events: DataFrame, deal: Callable[..., DataFrame] = lambda rows, *keys: rows
    ):
        self.specs = list(specs)
        self.tables = {"codes": codes, "procedures": procedures}
        self.encounters, self.entities, self.stays, self.events, self.deal = encounters, entities, stays, events, deal
        self.places = {s.column(n): divmod(i, WORD) for i, (s, n) in enumerate((s, n) for s in self.specs for n in s.flags)}
        self.words = [f"__flags{i}" for i in range(-(-len(self.places) // WORD))]

    def words_of(self, rules: Mapping[str, Column]) -> list[Column]:
        """For each packed column the bits of the rules that hold; null is false."""
        bits: dict[int, list[Column]] = {}
        for name, rule in rules.items():
            word, bit = self.places[name]
            bits.setdefault(word, []).append(F.when(rule, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
        return [reduce(Column.bitwiseOR, bits.get(i, [F.lit(0).cast("long")])).alias(word) for i, word in enumerate(self.words)]

    def named(self, rows: DataFrame) -> DataFrame:
        """Packed rows with a column for each flag, under the specs' names."""
        own = {n: F.getbit(self.words[word], F.lit(bit)) == 1 for n, (word, bit) in self.places.items() if n not in rows.columns}
        return rows.select("*", *[test.alias(n) for n, test in own.items()]).drop(*self.words)

    def flags(self, table: str) -> DataFrame | None:
        """(encounter, packed flags) of all specs: one aggregate of a table of codes."""
        rules = {s.column(n): f.rule for s in self.specs for n, f in s.flags.items() if f.table == table}
        if not rules:
            return None
        rows = self.tables[table].filter(F.col("encounter").isNotNull()).select("encounter", *self.words_of(rules))
        return rows.groupBy("encounter").agg(*[F.bit_or(w).alias(w) for w in self.words])

    def flagged(self) -> DataFrame:
        """Encounters with the packed flags of their own codes."""
        rows = self.deal(self.encounters, "encounter")
        found = {table: own for table in self.tables if (own := self.flags(table)) is not None}
        for table, own in found.items():
            rows = rows.join(own.select("encounter", *[F.col(w).alias(f"{w}_{table}") for w in self.words]), "encounter", "left")
        held = {w: reduce(Column.bitwiseOR, [F.coalesce(f"{w}_{table}", F.lit(0).cast("long")) for table in found], F.lit(0).cast("long")) for w in self.words}
        return rows.select(*self.encounters.columns, *[bits.alias(w) for w, bits in held.items()])

    @cached_property
    def packed_encounters(self) -> DataFrame:
        """Encounters with their entity's attributes (``known`` if there are any) and the packed flags of all specs, written.

        Flags are packed, as a written table and a join cost by their columns. What is aggregated by entity is dealt by it.
        """
        rows = self.deal(written(self.flagged(), "flagged"), "entity")
        of_entity, dated = [0] * len(self.words), {}
        for s in self.specs:
            for n, f in s.flags.items():
                word, bit = self.places[s.column(n)]
                if f.dated:
                    dated[s.column(n)] = F.min(F.when(F.getbit(self.words[word], F.lit(bit)) == 1, F.col("admit")))
                elif f.level == "entity":
                    of_entity[word] |= 1 << bit
        every = [F.bit_or(w).alias(f"{w}_entity") for w, mask in zip(self.words, of_entity) if mask]
        found = rows.groupBy("entity").agg(F.min(F.struct("admit", "encounter")).alias("__first"), *every, *[a.alias(n) for n, a in dated.items()])
        wide = rows.join(self.entities.withColumn("known", F.lit(True)), "entity", "left").join(found, "entity")
        words = [(F.col(w).bitwiseOR(F.col(f"{w}_entity").bitwiseAND(F.lit(mask))) if mask else F.col(w)).alias(w) for w, mask in zip(self.words, of_entity)]
        first = F.struct("admit", "encounter") == F.col("__first")
        kept = [c for c in wide.columns if c not in ("known", *self.words) and not c.startswith("__")]
        wide = wide.select(*kept, F.coalesce("known", F.lit(False)).alias("known"), first.alias("is_first_encounter"), *words)
        return written(self.compared(wide, [s for s in self.specs if s.level == "encounter"]), "encounters")

    @cached_property
    def wide_encounters(self) -> DataFrame:
        """Encounters with the flags of all specs."""
        return self.named(self.packed_encounters)

    @cached_property
    def used_events(self) -> DataFrame:
        """Events that some spec needs, written: the one scan of events."""
        tests = [m.rows for s in self.specs for m in s.measures.values()] + [s.events for s in self.specs if s.events is not None]
        return written(self.events.filter(_any(tests)), "events")

    @cached_property
    def wide_stays(self) -> DataFrame:
        """Stays with their encounter's columns, the measures of all specs, and what these compare."""
        own = [c for c in self.packed_encounters.columns if c == "encounter" or c not in self.stays.columns]
        rows = written(self.deal(self.stays, "encounter").join(self.packed_encounters.select(own), "encounter"), "stays")
        rows = self.deal(rows, "encounter")
        wide = rows.join(rows.groupBy("encounter").agg(F.max("intime").alias("last_intime")), "encounter")
        if any(s.measures for s in self.specs):
            wide = wide.join(self.measured(rows.select("encounter", "stay", "intime", "outtime")), ["encounter", "stay"], "left")
        return self.named(written(self.compared(wide, [s for s in self.specs if s.level == "stay"]), "stays"))

    def measured(self, stays: DataFrame) -> DataFrame:
        """(encounter, stay, measure...) of all specs: one aggregate of events, by encounter and stay as they are dealt by encounter."""
        rows = self.deal(self.used_events.drop("entity"), "encounter").join(stays, "encounter")
        rows = rows.withColumns({"hours": hours(F.col("intime"), F.col("ts")), "inside": (F.col("ts") >= F.col("intime")) & (F.col("ts") <= F.col("outtime"))})
        lagged = {s.column(n): m for s in self.specs for n, m in s.measures.items() if m.within}
        for name, m in lagged.items():
            rows = rows.withColumn(f"__part_{name}", F.when(m.part, F.col("value")))
            rows = rows.withColumn(f"__least_{name}", F.expr(f"min(`__part_{name}`) over (partition by encounter, stay order by ts range between {m.within} preceding and current row)"))
        every = {s.column(n): m for s in self.specs for n, m in s.measures.items()}
        return rows.groupBy("encounter", "stay").agg(*[m.value(F.col(f"__least_{n}") if m.within else F.lit(None)).alias(n) for n, m in every.items()])

    def compared(self, rows: DataFrame, specs: list[CohortSpec]) -> DataFrame:
        """Packed rows with the aggregates that the specs compare: one aggregate for each key."""
        wanted: dict[str, list[Column]] = {}
        for s in specs:
            for name, (key, value) in s.over(s.own).items():
                wanted.setdefault(key, []).append(value.alias(s.column(name)))
        if not wanted:
            return rows
        plain = rows = written(rows, "compared")
        for key, values in wanted.items():
            rows = self.deal(rows, key).join(self.named(self.deal(plain, key)).groupBy(key).agg(*values), key, "left")
        return rows

    def members(self) -> DataFrame:
        """(cohort, entity, encounter, stay, label) of all specs."""
        parts = []
        for level, rows in (("stay", lambda: self.wide_stays), ("encounter", lambda: self.wide_encounters)):
            specs = [s for s in self.specs if s.level == level and s.derive is None]
            if specs:
                parts.append(_kept(rows(), specs, F.col("stay") if level == "stay" else F.lit(None).cast(self.stays.schema["stay"].dataType)))
        for s in self.specs:
            if s.derive is not None:
                renamed = {s.column(n): n for n in s.flags}
                rows = self.wide_encounters.filter("known") if s.known else self.wide_encounters
                found = s.derive(rows.withColumnsRenamed(renamed), self.used_events, self.wide_stays, self.deal)
                parts.append(found.select(F.lit(s.name).alias("cohort"), "entity", "encounter", F.lit(None).cast(self.stays.schema["stay"].dataType).alias("stay"), F.col("label").cast("int").alias("label")))
        return reduce(DataFrame.unionByName, parts)


def _kept(rows: DataFrame, specs: list[CohortSpec], stay: Column) -> DataFrame:
    """Members of all specs from one pass: each row once for each cohort that keeps it."""
    found = []
    for s in specs:
        inside = F.coalesce(s.keep(s.own), F.lit(False))
        inside = inside & F.col("known") if s.known else inside
        found.append(F.when(inside, F.struct(F.lit(s.name).alias("cohort"), s.label(s.own).cast("int").alias("label"))))
    every = rows.select("entity", "encounter", stay.alias("stay"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    return every.select("x.cohort", "entity", "encounter", "stay", "x.label")


def chosen(names: list[str], specs: Mapping[str, CohortSpec]) -> list[CohortSpec]:
    """Specs by name; ``all`` names every one."""
    wanted = list(specs) if names == ["all"] else names
    if unknown := [n for n in wanted if n not in specs]:
        raise ValueError(f"no such cohorts: {unknown}; there are {sorted(specs)}")
    return [specs[n] for n in wanted]
