"""Entity, encounter, code and event tables derived from the benchmark tables, for queries, tests and measurements."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that a task of a join or aggregate of lines takes, about.
LINES_A_TASK = 500_000


class Tables:
    """The derived tables of a data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Tasks for all lines, counted from the footers: a task's sorts and maps stay as large however many lines there are."""
        return -(-self.raw("lineitem").count() // LINES_A_TASK)

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """rows by keys over so many tasks as all lines need; few lines are left to the session's number of partitions."""
        return rows.repartition(self.parts, *keys) if self.parts > self.spark.sparkContext.defaultParallelism else rows

    def lines(self, *columns: str) -> DataFrame:
        """Columns of the lines with their encounter, dealt by it."""
        return self.dealt(self.raw("lineitem").selectExpr("l_orderkey as encounter", *columns), "encounter")

    @cached_property
    def encounters(self) -> DataFrame:
        hour = "make_dt_interval(0, {}, 0, 0)"
        return (
            self.raw("orders")
            .selectExpr("o_custkey as entity", "o_orderkey as encounter", f"cast(o_orderdate as timestamp_ntz) + {hour.format('cast(o_orderkey % 24 as int)')} as admit")
            .selectExpr("*", f"admit + {hour.format('cast(24 * (1 + encounter % 12) + 6 as int)')} as disch", "cast(encounter % 37 = 0 as int) as died")
            .selectExpr("*", "if(died = 1, disch, null) as death", "(24 * (1 + encounter % 12) + 6) / 24.0D as los", "if(entity % 5 = 0, 'BLACK', 'OTHER') as race")
        )

    @cached_property
    def entities(self) -> DataFrame:
        last = self.dealt(self.encounters, "entity").groupBy("entity").agg(F.max("disch").alias("last"))
        return (
            self.raw("customer")
            .selectExpr("c_custkey as entity", "cast(15 + (c_custkey * 7) % 80 as int) as age", "if(c_custkey % 2 = 0, 'M', 'F') as gender")
            .filter("age >= 18")
            .join(last, "entity", "left")
            .selectExpr("entity", "age", "gender", "if(entity % 6 = 0, cast(date_add(cast(last as date), cast(entity % 400 as int)) as timestamp_ntz), null) as dod")
        )

    @cached_property
    def codes(self) -> DataFrame:
        orders = self.raw("orders").selectExpr("o_orderkey as encounter", "o_custkey as entity")
        lines = self.lines(
            "cast(if(l_partkey % 3 = 0, 9, 10) as int) as version",
            "concat(char(cast(65 + l_partkey % 8 as int)), lpad(cast((l_partkey div 8) % 5 as string), 2, '0'), cast(l_suppkey % 10 as string)) as code",
        )
        return lines.join(orders, "encounter").select("entity", "encounter", "code", "version")

    @cached_property
    def procedures(self) -> DataFrame:
        orders = self.raw("orders").selectExpr("o_orderkey as encounter", "o_custkey as entity")
        lines = self.lines("lpad(cast(l_partkey % 400 as string), 4, '0') as code").filter("cast(code as int) < 60")
        return lines.join(orders, "encounter").select("entity", "encounter", "code")

    @cached_property
    def stays(self) -> DataFrame:
        hours = "make_dt_interval(0, cast({} as int), 0, 0)"
        return (
            self.encounters.filter("encounter % 3 = 0")
            .selectExpr("entity", "encounter", "encounter * 10 + 1 as stay", f"admit + {hours.format('4')} as intime", f"least(disch, admit + {hours.format('4 + 12 * (1 + encounter % 9)')}) as outtime", "disch", "death")
            .selectExpr(
                "entity", "encounter", "stay", "intime", "outtime", "timestampdiff(MICROSECOND, intime, outtime) / 8.64e10D as los",
                "case encounter % 4 when 0 then 'Medical ICU' when 1 then 'CCU' when 2 then 'CORONARY CARE' end as unit", "death",
            )
        )

    @cached_property
    def events(self) -> DataFrame:
        lines = self.lines(
            "50800 + l_partkey % 12 as item",
            "cast((l_partkey * 37 + l_linenumber * 101) % 20160 as int) as minutes",
            "if(l_partkey % 50 = 0, null, l_quantity / 10) as value",
        )
        own = self.encounters.select("entity", "encounter", "admit")
        return lines.join(own, "encounter").selectExpr("entity", "encounter", "item", "admit + make_dt_interval(0, -48, minutes, 0) as ts", "value")

    @cached_property
    def proc_events(self) -> DataFrame:
        """Procedures of stays: events of the even items."""
        return self.events.filter("item % 2 = 0").join(self.stays.select("encounter", "stay"), "encounter").select("stay", "item", "ts")

    @cached_property
    def input_events(self) -> DataFrame:
        """What stays were given: events of every third item."""
        return self.events.filter("item % 3 = 0").join(self.stays.select("encounter", "stay"), "encounter").select("stay", "item", "ts", "value")

    @cached_property
    def items(self) -> DataFrame:
        found = self.raw("part").selectExpr("50800 + p_partkey % 12 as item", "p_type").groupBy("item").agg(F.min("p_type").alias("kind"))
        return found.selectExpr("item", "concat(if(item % 3 = 0, 'Packed RBC ', 'Creatinine '), cast(item as string), ' ', kind) as label")

    @cached_property
    def edges(self) -> DataFrame:
        """An edge between two code groups, with relative risk and fractional days, for each nation."""
        group = "concat(char(cast(65 + ({0}) % 8 as int)), lpad(cast(({1}) % 5 as string), 2, '0'))"
        one, two = group.format("n_nationkey", "n_nationkey"), group.format("3 * n_nationkey + 1", "2 * n_nationkey + 1")
        return self.raw("nation").selectExpr(f"{one} as d1", f"{two} as d2", "1 + n_nationkey / 10D as rr", "90.5D + 37.25D * n_nationkey as diff_days")

    @cached_property
    def people(self) -> DataFrame:
        """Encounters with the attributes of their adult entity."""
        return self.dealt(self.encounters, "entity").join(self.entities, "entity")

    @cached_property
    def stay_people(self) -> DataFrame:
        """Stays with the attributes of their encounter and adult entity."""
        own = self.encounters.select("encounter", "admit", "disch", "died", "race")
        return self.stays.join(own, "encounter", "left").join(self.entities, "entity")

    @cached_property
    def series(self) -> DataFrame:
        """(series, item, minute, value) of the event stream, 30 days."""
        return self.raw("events").selectExpr("user_id as series", "event_type as item", "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 6e7D as minute", "value")

    @cached_property
    def series_labels(self) -> DataFrame:
        return self.series.select("series").distinct().selectExpr("series", "cast(series % 4 = 0 as int) as label", "if(series % 5 < 4, 'train', 'test') as split")

    @cached_property
    def scores(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderpriority as cohort", "cast(o_orderstatus = 'F' as int) as label", "((o_orderkey * 7919) % 1000) / 1000.0D as score", "o_orderkey as id")

    @cached_property
    def results(self) -> DataFrame:
        """Scores of models by cohort and fold, under one of two prefixes and with a parameter that can be null."""
        rows = self.raw("orders").selectExpr(
            "o_custkey % 40 as cohort", "o_orderpriority as model", "o_orderkey % 5 as fold", "if(o_custkey % 3 = 0, 'new', 'old') as prefix", "nullif(o_orderkey % 3, 0) as depth",
            "(o_orderkey * 7919) % 1000 as a", "(o_orderkey * 104729) % 1000 as b", "o_orderkey % 50 as e",
        )
        return rows.groupBy("cohort", "model", "fold", "prefix", "depth").agg(*[(F.sum(c) / (F.count("*") * n)).alias(name) for c, n, name in (("a", 1009, "auroc"), ("b", 1009, "auprc"), ("e", 1, "epoch"))])

    @cached_property
    def catalog(self) -> DataFrame:
        """A cohort for each nation and market segment of the customers."""
        rows = self.raw("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 6000).alias("n_pos"), F.count_if(F.col("c_acctbal") <= 6000).alias("n_neg"))
        return rows.selectExpr(
            "concat(c_nationkey, '-', c_mktsegment) as cohort", "concat(char(cast(65 + c_nationkey % 20 as int)), '00') as d1", "concat(char(cast(65 + (length(c_mktsegment) + c_nationkey) % 18 as int)), '01') as d2",
            "1 + c_nationkey * 0.15D as rr", "365.25D * (30 + c_nationkey) as age_days", "100D + 20 * c_nationkey as diff_days", "n_pos", "n_neg",
        )

    @cached_property
    def splits(self) -> DataFrame:
        return self.encounters.selectExpr("entity", "encounter", "concat('c', cast(encounter % 5 as string)) as cohort", "died as label", "case when entity % 10 < 7 then 'train' when entity % 10 < 9 then 'val' else 'test' end as split")


#: The same tables as DuckDB common table expressions, written from their definition.
BASE_SQL = """WITH enc AS (SELECT o_custkey AS entity, o_orderkey AS encounter, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) AS admit,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_hours(24 * (1 + o_orderkey % 12) + 6) AS disch, CAST(o_orderkey % 37 = 0 AS INT) AS died,
    CASE WHEN o_orderkey % 37 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_hours(24 * (1 + o_orderkey % 12) + 6) END AS death,
    CAST(24 * (1 + o_orderkey % 12) + 6 AS DOUBLE) / 24 AS los, CASE WHEN o_custkey % 5 = 0 THEN 'BLACK' ELSE 'OTHER' END AS race FROM orders),
ent AS (SELECT c_custkey AS entity, CAST(15 + (c_custkey * 7) % 80 AS INT) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
    CASE WHEN c_custkey % 6 = 0 THEN date_trunc('day', l.last) + to_days(CAST(c_custkey % 400 AS INT)) END AS dod
    FROM customer LEFT JOIN (SELECT entity, max(disch) AS last FROM enc GROUP BY entity) l ON l.entity = c_custkey WHERE 15 + (c_custkey * 7) % 80 >= 18),
cod AS (SELECT o_custkey AS entity, l_orderkey AS encounter, chr(CAST(65 + l_partkey % 8 AS INT)) || lpad(CAST((l_partkey // 8) % 5 AS VARCHAR), 2, '0') || CAST(l_suppkey % 10 AS VARCHAR) AS code,
    CASE WHEN l_partkey % 3 = 0 THEN 9 ELSE 10 END AS version FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
px AS (SELECT o_custkey AS entity, l_orderkey AS encounter, lpad(CAST(l_partkey % 400 AS VARCHAR), 4, '0') AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 400 < 60),
st AS (SELECT entity, encounter, encounter * 10 + 1 AS stay, admit + INTERVAL 4 HOUR AS intime, least(disch, admit + to_hours(4 + 12 * (1 + encounter % 9))) AS outtime,

    CAST(epoch_us(least(disch, admit + to_hours(4 + 12 * (1 + encounter % 9)))) - epoch_us(admit + INTERVAL 4 HOUR) AS DOUBLE) / 8.64e10 AS los,
    CASE encounter % 4 WHEN 0 THEN 'Medical ICU' WHEN 1 THEN 'CCU' WHEN 2 THEN 'CORONARY CARE' END AS unit, death FROM enc WHERE encounter % 3 = 0),
ev AS (SELECT enc.entity, enc.encounter, 50800 + l_partkey % 12 AS item, admit - INTERVAL 48 HOUR + to_minutes((l_partkey * 37 + l_linenumber * 101) % 20160) AS ts,
    CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity / 10 END AS value FROM lineitem JOIN enc ON l_orderkey = enc.encounter),
pev AS (SELECT stay, item, ts FROM ev JOIN st USING (encounter) WHERE item % 2 = 0),
iev AS (SELECT stay, item, ts, value FROM ev JOIN st USING (encounter) WHERE item % 3 = 0),
itm AS (SELECT 50800 + p_partkey % 12 AS item, CASE WHEN any_value(50800 + p_partkey % 12) % 3 = 0 THEN 'Packed RBC ' ELSE 'Creatinine ' END || any_value(50800 + p_partkey % 12) || ' ' || min(p_type) AS label FROM part GROUP BY 50800 + p_partkey % 12),
edg AS (SELECT chr(CAST(65 + n_nationkey % 8 AS INT)) || lpad(CAST(n_nationkey % 5 AS VARCHAR), 2, '0') AS d1, chr(CAST(65 + (3 * n_nationkey + 1) % 8 AS INT)) || lpad(CAST((2 * n_nationkey + 1) % 5 AS VARCHAR), 2, '0') AS d2,
    1 + CAST(n_nationkey AS DOUBLE) / 10 AS rr, 90.5 + 37.25 * CAST(n_nationkey AS DOUBLE) AS diff_days FROM nation),
ppl AS (SELECT enc.*, age, gender, dod FROM enc JOIN ent USING (entity)),
sp AS (SELECT st.*, admit, disch, died, race, age, gender, dod FROM st JOIN enc USING (entity, encounter) JOIN ent USING (entity)),
ser AS (SELECT user_id AS series, event_type AS item, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 6e7 AS minute, value FROM events),
lab AS (SELECT DISTINCT series, CAST(series % 4 = 0 AS INT) AS label, CASE WHEN series % 5 < 4 THEN 'train' ELSE 'test' END AS split FROM ser),
sco AS (SELECT o_orderpriority AS cohort, CAST(o_orderstatus = 'F' AS INT) AS label, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0 AS score, o_orderkey AS id FROM orders),
res AS (SELECT o_custkey % 40 AS cohort, o_orderpriority AS model, o_orderkey % 5 AS fold, CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS prefix, nullif(o_orderkey % 3, 0) AS depth,
    CAST(sum((o_orderkey * 7919) % 1000) AS DOUBLE) / (count(*) * 1009) AS auroc, CAST(sum((o_orderkey * 104729) % 1000) AS DOUBLE) / (count(*) * 1009) AS auprc, CAST(sum(o_orderkey % 50) AS DOUBLE) / count(*) AS epoch FROM orders GROUP BY ALL),
cat AS (SELECT c_nationkey || '-' || c_mktsegment AS cohort, chr(CAST(65 + c_nationkey % 20 AS INT)) || '00' AS d1, chr(CAST(65 + (length(c_mktsegment) + c_nationkey) % 18 AS INT)) || '01' AS d2, 1 + c_nationkey * CAST(0.15 AS DOUBLE) AS rr,
    CAST(365.25 AS DOUBLE) * (30 + c_nationkey) AS age_days, CAST(100 + 20 * c_nationkey AS DOUBLE) AS diff_days, count(*) FILTER (WHERE c_acctbal > 6000) AS n_pos, count(*) FILTER (WHERE c_acctbal <= 6000) AS n_neg FROM customer GROUP BY c_nationkey, c_mktsegment),
spl AS (SELECT entity, encounter, 'c' || (encounter % 5) AS cohort, died AS label, CASE WHEN entity % 10 < 7 THEN 'train' WHEN entity % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM enc)
"""
