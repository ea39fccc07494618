"""Queries: aggregates over events, profiles, grids and irregular series, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import ratio
from strandline.operators import profiles as P
from strandline.operators import series as S
from strandline.plans.registry import query
from strandline.sources.fixtures import Tables


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def in_us(df: DataFrame, *columns: str) -> DataFrame:
    """Minutes as whole microseconds, which both engines give alike."""
    return df.withColumns({c: F.round(F.col(c) * 6e7).cast("long") for c in columns})


def members(t: Tables) -> DataFrame:
    """Encounters with a cohort and a chapter of their own."""
    return t.encounters.selectExpr("entity", "encounter", "admit", "disch", "concat('c', cast(encounter % 5 as string)) as cohort", "char(cast(65 + encounter % 4 as int)) as chapter", "died as label")


MEM = ", mem AS (SELECT entity, encounter, admit, disch, 'c' || (encounter % 5) AS cohort, chr(CAST(65 + encounter % 4 AS INT)) AS chapter, died AS label FROM enc)"

# --- aggregates ----------------------------------------------------------------------------------------------------


@query("agg_dup_max", "SELECT entity, encounter, item, ts, max(value) AS value FROM ev GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("entity", "encounter", "item", "ts").agg(F.max("value").alias("value"))


@query("agg_dup_mean", "SELECT encounter, item, ts, round(avg(value), 6) AS value FROM ev GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rounded(S.mean_duplicates(t.events, ["encounter", "item", "ts"]), "value")


@query(
    "agg_counts_all_vs_first",
    MEM + """, f AS (SELECT *, row_number() OVER (PARTITION BY cohort, entity ORDER BY admit, encounter) AS k FROM mem)
    SELECT cohort, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, count(*) FILTER (WHERE k = 1) AS n_first,
    count(*) FILTER (WHERE k = 1 AND label = 1) AS n_pos_first, count(*) FILTER (WHERE k = 1 AND label = 0) AS n_neg_first FROM f GROUP BY cohort""",
)
def _(t: Tables) -> DataFrame:
    return P.all_and_first(members(t))


@query(
    "join_suffix_compare",
    MEM + """, f AS (SELECT *, row_number() OVER (PARTITION BY cohort, entity ORDER BY admit, encounter) AS k FROM mem), a AS (SELECT cohort, count(*) AS n FROM f GROUP BY cohort), b AS (SELECT cohort, count(*) AS n FROM f WHERE k = 1 GROUP BY cohort)
    SELECT cohort, a.n, b.n AS n_b, round(CAST(b.n AS DOUBLE) / a.n, 6) AS n_ratio, b.n - a.n AS n_delta FROM a JOIN b USING (cohort)""",
)
def _(t: Tables) -> DataFrame:
    both = P.all_and_first(members(t))
    return rounded(P.compare_variants(both.select("cohort", "n"), both.select("cohort", F.col("n_first").alias("n")), "cohort", ["n"]), "n_ratio")


PRO = ", bef AS (SELECT c.encounter, c.admit, c.disch, e.encounter AS oe, e.item, e.ts, date_diff('microsecond', e.ts, c.disch) / 8.64e10 AS ago FROM mem c JOIN ev e ON c.entity = e.entity AND e.ts <= c.disch)"
PROFILE = (
    MEM + PRO + """, pro AS (SELECT encounter, min(ts) AS first_event, max(ts) AS last_event, any_value(date_diff('microsecond', admit, disch)) / 8.64e10 AS los, max(ago) AS lod,
    greatest(date_diff('microsecond', min(ts), any_value(admit)) / 8.64e10, 0) AS pre_days, count(DISTINCT oe) AS n_encounters, count(DISTINCT item) AS n_items, count(*) AS n_events,
    count(*) FILTER (WHERE ts < admit) AS n_before, count(*) FILTER (WHERE ts >= admit) AS n_during"""
    + "".join(f", count(*) FILTER (WHERE ago <= {w}) AS n_events_{w}, count(DISTINCT item) FILTER (WHERE ago <= {w}) AS n_items_{w}" for w in P.WINDOWS)
    + " FROM bef GROUP BY encounter)"
)


def profiled(t: Tables, window_items: bool = True) -> DataFrame:
    """Profiles of encounters, from events and encounters dealt by entity."""
    return P.encounter_profile(t.dealt(t.events, "entity"), t.dealt(t.encounters, "entity"), window_items=window_items)


@query("agg_enc_profile", PROFILE + "SELECT * REPLACE (round(los, 6) AS los, round(lod, 6) AS lod, round(pre_days, 6) AS pre_days) FROM pro")
def _(t: Tables) -> DataFrame:
    return rounded(profiled(t), "los", "lod", "pre_days")


COUNTS = MEM + PRO + ", w AS (SELECT unnest([15, 90]) AS window_days), cnt AS (SELECT encounter, window_days, item, count(*) AS n FROM bef JOIN w ON ago <= window_days GROUP BY ALL)"


@query("agg_item_counts_window", COUNTS + "SELECT * FROM cnt")
def _(t: Tables) -> DataFrame:
    return P.item_counts(t.events, t.encounters, (15, 90)).withColumnRenamed("window", "window_days")


COHORT = (
    PROFILE + ", cop AS (SELECT cohort"
    + "".join(f", round(avg(CAST(n_events_{w} >= 10 AS INT)) * 100, 6) AS cov_{w}" for w in P.WINDOWS)
    + """, round(median(los), 6) AS median_los, round(median(lod), 6) AS median_lod, round(median(n_events), 6) AS median_events, round(median(n_items), 6) AS median_items,
    round(median(n_encounters), 6) AS median_encounters, round(median(pre_days), 6) AS median_pre_days, count(*) AS n FROM mem JOIN pro USING (encounter) GROUP BY cohort)"""
)


@query("agg_cohort_profile", COHORT + "SELECT * FROM cop")
def cohort_profile(t: Tables) -> DataFrame:
    rows = P.cohort_profile(profiled(t, window_items=False), t.dealt(members(t), "encounter"), enough=10)
    return rounded(rows, *[c for c in rows.columns if c not in ("cohort", "n")])


@query(
    "agg_chapter_medians_scaled",
    COHORT + """, ch AS (SELECT CAST(substr(cohort, 2) AS INT) % 3 AS chapter, median(median_los) AS a, median(cov_90) AS b FROM cop GROUP BY 1)
    SELECT chapter, round((a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0), 6) AS median_los, round((b - min(b) OVER ()) / nullif(max(b) OVER () - min(b) OVER (), 0), 6) AS cov_90 FROM ch""",
)
def _(t: Tables) -> DataFrame:
    own = cohort_profile(t).withColumn("chapter", F.substring("cohort", 2, 1).cast("int") % 3)
    return rounded(P.minmax(own.groupBy("chapter").agg(F.median("median_los").alias("median_los"), F.median("cov_90").alias("cov_90")), ["median_los", "cov_90"]), "median_los", "cov_90")


COVERAGE = PROFILE + "".join(
    f"{' UNION ALL ' if k else ''} SELECT {w} AS window_days, round(median(n_events_{w}), 6) AS median, round(quantile_cont(n_events_{w}, 0.25), 6) AS p25, round(quantile_cont(n_events_{w}, 0.75), 6) AS p75, "
    + ", ".join(f"round(avg(CAST(n_events_{w} >= {n} AS INT)) * 100, 6) AS cov_{n}" for n in (5, 20))
    + " FROM pro"
    for k, w in enumerate(P.WINDOWS)
)


@query("agg_coverage_quantiles", COVERAGE)
def _(t: Tables) -> DataFrame:
    rows = P.coverage(profiled(t, window_items=False), thresholds=(5, 20)).withColumnRenamed("window", "window_days")
    return rounded(rows, *rows.columns[1:])


PREV = COUNTS + """, ps AS (SELECT chapter, count(DISTINCT encounter) AS size FROM cnt JOIN mem USING (encounter) WHERE window_days = 90 GROUP BY chapter),
prv AS (SELECT chapter, item, CAST(sum(n) AS DOUBLE) / any_value(size) AS prevalence FROM cnt JOIN mem USING (encounter) JOIN ps USING (chapter) WHERE window_days = 90 GROUP BY chapter, item)"""  # fmt: skip


def prevalence(t: Tables) -> DataFrame:
    return P.prevalence(P.item_counts(t.events, t.encounters, (90,)), members(t))


@query("agg_item_prevalence", PREV + "SELECT chapter, item, round(prevalence, 6) AS prevalence FROM prv")
def _(t: Tables) -> DataFrame:
    return rounded(prevalence(t), "prevalence")


@query(
    "topk_items_chapter",
    PREV + """, tk AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY prevalence DESC, item) AS k FROM prv), a AS (SELECT item, max(prevalence) AS p FROM tk WHERE k <= 5 GROUP BY item), g AS (SELECT item FROM itm WHERE item % 4 = 0)
    SELECT coalesce(a.item, g.item) AS item, round(p, 6) AS max_prevalence, CAST(g.item IS NOT NULL AS INT) AS is_global FROM a FULL JOIN g ON a.item = g.item""",
)
def _(t: Tables) -> DataFrame:
    return rounded(P.top_items(prevalence(t), 5, globals_=t.items.filter("item % 4 = 0")), "max_prevalence")


@query("topk_items_least", PREV + "SELECT item, round(max(prevalence), 6) AS max_prevalence FROM prv WHERE prevalence >= 0.3 GROUP BY item")
def _(t: Tables) -> DataFrame:
    return rounded(P.top_items(prevalence(t), least=0.3), "max_prevalence")


@query("fs_global_top", "SELECT item, n FROM (SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS k FROM ev GROUP BY item) WHERE k <= 5")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(5)


@query("agg_jaccard", """, m AS (SELECT DISTINCT substr(code, 1, 1) AS g, encounter FROM cod), s AS (SELECT g, count(*) AS n FROM m GROUP BY g), p AS (SELECT a.g AS a, b.g AS b, count(*) AS k FROM m a JOIN m b ON a.encounter = b.encounter AND a.g < b.g GROUP BY ALL)
    SELECT a, b, round(CAST(k AS DOUBLE) / (x.n + y.n - k), 6) AS jaccard FROM p JOIN s x ON x.g = a JOIN s y ON y.g = b""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return rounded(P.jaccard(t.codes.select("encounter", F.substring("code", 1, 1).alias("chapter"))), "jaccard")


@query("agg_lab_frequency", "SELECT item, round(avg(n), 6) AS frequency FROM (SELECT encounter, item, count(*) AS n FROM ev GROUP BY ALL) GROUP BY item")
def _(t: Tables) -> DataFrame:
    counts = t.events.groupBy("encounter", "item").agg(F.count("*").alias("n"))
    return counts.groupBy("item").agg(F.round(F.avg("n"), 6).alias("frequency"))


@query(
    "agg_static_labs",
    """, f AS (SELECT item, avg(n) AS q FROM (SELECT encounter, item, count(*) AS n FROM ev GROUP BY ALL) GROUP BY item)
    SELECT encounter, item, round(avg(value), 6) AS mean FROM ev JOIN f USING (item) WHERE q <= (SELECT median(q) FROM f) GROUP BY encounter, item""",
)
def _(t: Tables) -> DataFrame:
    counts = t.events.groupBy("encounter", "item").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    often = counts.groupBy("item").agg(F.avg("n").alias("q"))
    rare = often.crossJoin(F.broadcast(often.agg(F.median("q").alias("m")))).filter("q <= m")  # one row
    return counts.join(rare.select("item"), "item", "left_semi").select("encounter", "item", F.round("mean", 6).alias("mean"))


TRAIN = "series IN (SELECT series FROM lab WHERE split = 'train')"


def train(t: Tables) -> DataFrame:
    return t.series_labels.filter("split = 'train'")


@query("agg_item_mean_std", f"SELECT item, round(avg(value), 6) AS mean, round(CASE WHEN coalesce(stddev_samp(value), 0) = 0 THEN 1 ELSE stddev_samp(value) END, 6) AS std FROM ser WHERE {TRAIN} GROUP BY item")
def _(t: Tables) -> DataFrame:
    own = t.series.join(train(t), "series", "left_semi").groupBy("item").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return rounded(own.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))), "mean", "std")


@query("agg_class_weight", "SELECT split, round((1 - avg(label)) / nullif(avg(label), 0), 6) AS weight FROM lab GROUP BY split")
def _(t: Tables) -> DataFrame:
    return t.series_labels.groupBy("split").agg(F.round(F.try_divide(1 - F.avg("label"), F.avg("label")), 6).alias("weight"))


@query("agg_missingness", MEM + """, n AS (SELECT cohort, count(*) AS n FROM mem GROUP BY cohort), k AS (SELECT cohort, item, 1 - CAST(count(DISTINCT encounter) AS DOUBLE) / any_value(n) AS miss FROM mem JOIN ev USING (encounter) JOIN n USING (cohort) GROUP BY cohort, item)
    SELECT cohort, round(avg(miss), 6) AS missing_mean, round(var_samp(miss), 6) AS missing_var FROM k GROUP BY cohort""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    own = members(t)
    sizes = own.groupBy("cohort").agg(F.count("*").alias("size"))
    seen = own.join(t.events.select("encounter", "item"), "encounter").groupBy("cohort", "item").agg(F.countDistinct("encounter").alias("k"))
    miss = seen.join(sizes, "cohort").withColumn("miss", 1 - ratio(F.col("k"), F.col("size")))
    return rounded(miss.groupBy("cohort").agg(F.avg("miss").alias("missing_mean"), F.var_samp("miss").alias("missing_var")), "missing_mean", "missing_var")


# --- grids ---------------------------------------------------------------------------------------------------------

GRID = """, bnd AS (SELECT series, item, CAST(floor(minute / 1440) AS INT) AS bin, minute, value FROM ser), tt AS (SELECT max(bin) + 1 AS t FROM bnd),
dsc AS (SELECT series, item, bin, arg_max(value, (minute, value)) AS last, avg(value) AS mean, sum(value) AS total, count(*) AS n FROM bnd GROUP BY ALL),
g AS (SELECT s.series, i.item, CAST(b.bin AS INT) AS bin, t FROM (SELECT DISTINCT series FROM ser) s, (SELECT DISTINCT item FROM ser) i, (SELECT t, unnest(range(t)) AS bin FROM tt) b),
x AS (SELECT g.series, g.item, g.bin, g.t, last, mean, total, coalesce(n, 0) AS n, CAST(n IS NOT NULL AS INT) AS obs FROM g LEFT JOIN dsc d ON d.series = g.series AND d.item = g.item AND d.bin = g.bin),
dl AS (SELECT *, max(CASE WHEN obs = 1 THEN bin END) OVER w AS seen FROM x WINDOW w AS (PARTITION BY series, item ORDER BY bin)),
de AS (SELECT *, CAST(CASE WHEN obs = 1 THEN 0 WHEN seen IS NOT NULL THEN bin - seen ELSE bin + 1 END AS DOUBLE) / t AS delta FROM dl),
fi AS (SELECT *, coalesce((SELECT q.mean FROM x q WHERE q.series = de.series AND q.item = de.item AND q.obs = 1 AND q.bin = de.seen),
    (SELECT q.mean FROM x q WHERE q.series = de.series AND q.item = de.item AND q.obs = 1 AND q.bin = (SELECT min(bin) FROM x z WHERE z.series = de.series AND z.item = de.item AND z.obs = 1 AND z.bin > de.bin)), 0) AS filled FROM de),
sd AS (SELECT item, avg(filled) AS m, CASE WHEN stddev_pop(filled) = 0 THEN 1 ELSE stddev_pop(filled) END AS s FROM fi WHERE series IN (SELECT series FROM lab WHERE split = 'train') GROUP BY item),
sc AS (SELECT fi.*, (filled - m) / s AS scaled FROM fi JOIN sd USING (item)),
vr AS (SELECT series, bin, item, 'V' AS kind, 1 AS block, scaled AS x FROM sc UNION ALL SELECT series, bin, item, 'M', 2, CAST(obs AS DOUBLE) FROM sc UNION ALL SELECT series, bin, item, 'D', 3, delta FROM sc)
"""


def grid(t: Tables) -> DataFrame:
    return S.discretise(S.with_bins(t.series))


def scaled(t: Tables) -> DataFrame:
    return S.standardise(S.fill(S.grid_delta(grid(t))), train(t))


@query("ts_bin", GRID + "SELECT series, item, bin, count(*) AS n, any_value(t) AS bins FROM bnd, tt GROUP BY series, item, bin")
def _(t: Tables) -> DataFrame:
    return grid(t).filter("n > 0").select("series", "item", "bin", "n", "bins")


@query("cross_grid", GRID + "SELECT series, item, bin FROM g")
def _(t: Tables) -> DataFrame:
    return S.full_grid(S.with_bins(t.series)).select("series", "item", "bin")


@query("ts_discretise", GRID + "SELECT series, item, bin, last, round(mean, 6) AS mean, round(total, 6) AS total, n, obs FROM x")
def _(t: Tables) -> DataFrame:
    return rounded(grid(t), "mean", "total").drop("bins")


@query("ts_delta", GRID + "SELECT series, item, bin, round(delta, 6) AS delta FROM de")
@query("win_delta_grid", GRID + "SELECT series, item, bin, round(delta, 6) AS delta FROM de")
def _(t: Tables) -> DataFrame:
    return rounded(S.grid_delta(grid(t)), "delta").select("series", "item", "bin", "delta")


@query("ts_impute_fill", GRID + "SELECT series, item, bin, round(filled, 6) AS filled FROM fi")
@query("win_ffill", GRID + "SELECT series, item, bin, round(filled, 6) AS filled FROM fi")
def _(t: Tables) -> DataFrame:
    return rounded(S.fill(grid(t)), "filled").select("series", "item", "bin", "filled")


@query("ts_impute_mean", GRID + f", m AS (SELECT item, avg(mean) AS m FROM x WHERE {TRAIN} GROUP BY item) SELECT series, item, bin, round(coalesce(mean, m, 0), 6) AS filled FROM x LEFT JOIN m USING (item)")
def _(t: Tables) -> DataFrame:
    return rounded(S.fill_mean(grid(t), train(t)), "filled").select("series", "item", "bin", "filled")


@query("agg_grid_mean_std", GRID + "SELECT item, round(m, 6) AS mean, round(s, 6) AS std FROM sd")
def _(t: Tables) -> DataFrame:
    own = S.fill(grid(t)).join(train(t), "series", "left_semi").groupBy("item").agg(F.avg("filled").alias("mean"), F.stddev_pop("filled").alias("std"))
    return rounded(own.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))), "mean", "std")


@query("ts_standardise", GRID + "SELECT series, item, bin, round(scaled, 6) AS scaled FROM sc")
def _(t: Tables) -> DataFrame:
    return rounded(scaled(t), "scaled").select("series", "item", "bin", "scaled")


@query("ts_variant", GRID + "SELECT series, bin, kind, item, round(x, 6) AS x FROM vr WHERE kind <> 'V'")
def _(t: Tables) -> DataFrame:
    return rounded(S.variant(scaled(t), "MD"), "x")


FLAT = GRID + ", o AS (SELECT series, x, row_number() OVER (PARTITION BY series ORDER BY bin, block, item) - 1 AS place FROM vr) SELECT series, place, round(x, 6) AS x FROM o"


@query("ts_flatten_concat", FLAT)
@query("ts_flatten_concat_all", FLAT)
def _(t: Tables) -> DataFrame:
    own = S.flatten(scaled(t))
    return rounded(own.select("series", F.posexplode("features").alias("place", "x")), "x").withColumn("place", F.col("place").cast("long"))


@query("ts_feature_names", GRID + ", o AS (SELECT DISTINCT bin, block, item, kind FROM vr) SELECT row_number() OVER (ORDER BY bin, block, item) - 1 AS place, item || '_' || kind || '_Bin' || bin AS name FROM o")
def _(t: Tables) -> DataFrame:
    return S.feature_names(grid(t)).withColumn("place", F.col("place").cast("long"))


@query("ts_flatten_mean", GRID + "SELECT series, kind, item, round(avg(x), 6) AS x FROM vr GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rounded(S.flatten_mean(scaled(t)), "x")


@query("index_map", "SELECT item, row_number() OVER (ORDER BY item) - 1 AS ind FROM (SELECT DISTINCT item FROM ser)")
def _(t: Tables) -> DataFrame:
    return S.item_index(t.series).withColumn("ind", F.col("ind").cast("long"))


@query("ts_day_only", "SELECT series, item, CAST(floor(minute / 1440) * 1440 * 60000000 AS BIGINT) AS minute, value FROM ser")
def _(t: Tables) -> DataFrame:
    return in_us(S.day_only(t.series), "minute").select("series", "item", "minute", "value")


# --- irregular -----------------------------------------------------------------------------------------------------

MAT = """, tm AS (SELECT DISTINCT series, minute FROM ser), cl AS (SELECT series, minute, item, avg(value) AS value FROM ser GROUP BY ALL),
mx AS (SELECT tm.series, tm.minute, i.item, coalesce(value, 0) AS value, CAST(value IS NOT NULL AS INT) AS mask FROM tm, (SELECT DISTINCT item FROM ser) i LEFT JOIN cl ON cl.series = tm.series AND cl.minute = tm.minute AND cl.item = i.item),
ir AS (SELECT *, (minute - coalesce(max(CASE WHEN mask = 1 THEN minute END) OVER (PARTITION BY series, item ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(minute) OVER (PARTITION BY series))) / (31 * 1440) AS delta FROM mx)
"""


@query("ts_matrix", MAT + "SELECT series, CAST(round(minute * 6e7) AS BIGINT) AS minute, item, round(value, 6) AS value, mask FROM mx")
def _(t: Tables) -> DataFrame:
    return in_us(rounded(S.observed_matrix(t.series), "value"), "minute")


@query("ts_delta_matrix", MAT + "SELECT series, CAST(round(minute * 6e7) AS BIGINT) AS minute, item, round(delta, 6) AS delta FROM ir")
@query("win_delta_irregular", MAT + "SELECT series, CAST(round(minute * 6e7) AS BIGINT) AS minute, item, round(delta, 6) AS delta FROM ir")
def _(t: Tables) -> DataFrame:
    return in_us(rounded(S.irregular_delta(S.observed_matrix(t.series), 30), "delta"), "minute").select("series", "minute", "item", "delta")


RATE = """, lg AS (SELECT *, minute - lag(minute) OVER w AS gap, value - lag(value) OVER w AS dv FROM ser WINDOW w AS (PARTITION BY series, item ORDER BY minute, value)),
rt AS (SELECT series, item, minute, value, CAST(abs(dv / CASE WHEN gap = 0 THEN 1e-6 ELSE gap END) > 0.001 AS INT) AS significant FROM lg)"""


@query("win_rate_of_change", RATE + "SELECT series, item, CAST(round(minute * 6e7) AS BIGINT) AS minute, value, significant FROM rt")
def _(t: Tables) -> DataFrame:
    return in_us(S.rate_of_change(t.series, 0.001), "minute").select("series", "item", "minute", "value", "significant")


@query("ts_event_mask", RATE + "SELECT series, item, CAST(round(minute * 6e7) AS BIGINT) AS minute, CASE WHEN item <> 'click' THEN significant END AS significant FROM rt")
def _(t: Tables) -> DataFrame:
    return in_us(S.event_mask(t.series, 0.001, skip_item="click"), "minute").select("series", "item", "minute", "significant")


HASHED = "(CAST(floor(minute) AS BIGINT) * 7919) % 10007, minute, item"


def hashed():
    return F.struct((F.floor("minute") * 7919) % 10007, "minute", "item")


@query("win_cap_rows", f"SELECT series, item, CAST(round(minute * 6e7) AS BIGINT) AS minute FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY {HASHED}) AS k FROM ser) WHERE k <= 20")
def _(t: Tables) -> DataFrame:
    return in_us(S.cap_rows(t.series, 20, ["series"], hashed()), "minute").select("series", "item", "minute")


HOLD = f"SELECT series, item, CAST(round(minute * 6e7) AS BIGINT) AS minute, CAST(row_number() OVER (PARTITION BY series, item ORDER BY {HASHED}) <= floor(0.2 * count(*) OVER (PARTITION BY series, item)) AS INT) AS held_out FROM ser"


@query("win_holdout_mask", HOLD)
@query("ts_holdout", HOLD)
def _(t: Tables) -> DataFrame:
    return in_us(S.holdout(t.series, 0.2, hashed()), "minute").select("series", "item", "minute", "held_out")


@query("ts_interpolation_inputs", MAT + "SELECT series, CAST(round(minute * 6e7) AS BIGINT) AS minute, item, CASE WHEN minute = min(minute) OVER (PARTITION BY series) THEN 1 ELSE mask END AS mask FROM mx")
def _(t: Tables) -> DataFrame:
    return in_us(S.interpolation_inputs(S.observed_matrix(t.series)), "minute").select("series", "minute", "item", "mask")


IND = ", ind AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS ind FROM (SELECT DISTINCT item FROM ser))"


@query("ts_triplets", IND + "SELECT series, row_number() OVER (PARTITION BY series ORDER BY minute, ind, value) - 1 AS place, ind, value, round(minute / (31 * 1440) * 2 - 1, 6) AS time FROM ser JOIN ind USING (item)")
def _(t: Tables) -> DataFrame:
    rows = S.triplets(t.series, 30).select("series", F.posexplode("obs").alias("place", "o"))
    return rows.select("series", F.col("place").cast("long").alias("place"), F.col("o.ind").cast("long").alias("ind"), "o.value", F.round("o.time", 6).alias("time"))


@query("ts_pad", ", n AS (SELECT series, count(*) AS n FROM ser GROUP BY series) SELECT series, (SELECT max(n) FROM n) AS length, n AS observed FROM n")
def _(t: Tables) -> DataFrame:
    rows = S.pad(S.triplets(t.series))
    return rows.select("series", F.size("values").cast("long").alias("length"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("observed"))


ANC = ", an AS (SELECT series, minute AS t1 FROM (SELECT DISTINCT series, minute FROM ser) s WHERE minute >= 720 AND minute < (SELECT max(minute) FROM ser q WHERE q.series = s.series))"


@query("ts_anchor_times", ANC + "SELECT series, CAST(round(t1 * 6e7) AS BIGINT) AS t1 FROM an")
def _(t: Tables) -> DataFrame:
    return in_us(S.anchors(t.series), "t1")


@query(
    "ts_fixed_windows",
    """, w AS (SELECT unnest(range(20, 360, 24)) AS w) SELECT DISTINCT s.series, w FROM (SELECT DISTINCT series FROM ser) s, w
    WHERE EXISTS (SELECT 1 FROM ser e WHERE e.series = s.series AND minute / 60 >= w - 24 AND minute / 60 < w) AND EXISTS (SELECT 1 FROM ser e WHERE e.series = s.series AND minute / 60 >= w AND minute / 60 <= w + 24)""",
)
def _(t: Tables) -> DataFrame:
    return S.fixed_windows(t.series).withColumn("w", F.col("w").cast("long"))


SAMPLES = ANC + """, i AS (SELECT p.series, p.t1, minute, row_number() OVER (PARTITION BY p.series, p.t1 ORDER BY minute DESC, item DESC, value DESC) AS k FROM ser JOIN an p ON p.series = ser.series AND minute BETWEEN t1 - 10080 AND t1)
    SELECT series, CAST(round(t1 * 6e7) AS BIGINT) AS t1, count(*) AS n, round(sum((minute - greatest(t1 - 10080, 0)) / 10080 * 2 - 1), 5) AS times FROM i WHERE k <= 1000 GROUP BY series, t1"""


@query("ts_forecast_sample", SAMPLES)
@query("ts_forecast_sample_all", SAMPLES)
def _(t: Tables) -> DataFrame:
    inputs, _targets = S.forecast_samples(t.series, S.anchors(t.series))
    return inputs.groupBy("series", "t1").agg(F.count("*").alias("n"), F.round(F.sum("time"), 5).alias("times")).withColumn("t1", F.round(F.col("t1") * 6e7).cast("long"))


TARGETS = ANC + "SELECT p.series, CAST(round(t1 * 6e7) AS BIGINT) AS t1, item, arg_min(value, (minute, value)) AS target FROM ser JOIN an p ON p.series = ser.series AND minute > t1 AND minute <= t1 + 1440 GROUP BY p.series, t1, item"


@query("ts_forecast_target", TARGETS)
@query("ts_forecast_target_all", TARGETS)
def _(t: Tables) -> DataFrame:
    return in_us(S.forecast_samples(t.series, S.anchors(t.series))[1], "t1")


@query(
    "ts_forecast_sample_fixed",
    """, w AS (SELECT unnest(range(20, 360, 24)) * 60.0 AS w), f AS (SELECT DISTINCT s.series, w FROM (SELECT DISTINCT series FROM ser) s, w
    WHERE EXISTS (SELECT 1 FROM ser e WHERE e.series = s.series AND minute >= w - 1440 AND minute < w) AND EXISTS (SELECT 1 FROM ser e WHERE e.series = s.series AND minute >= w AND minute <= w + 1440))
    SELECT f.series, CAST(round(w * 6e7) AS BIGINT) AS t1, item, arg_min(value, (minute, value)) AS target FROM ser JOIN f ON f.series = ser.series AND minute >= w AND minute <= w + 1440 GROUP BY f.series, w, item""",
)
def _(t: Tables) -> DataFrame:
    at = S.fixed_windows(t.series).select("series", (F.col("w") * 60).cast("double").alias("t1"))
    return in_us(S.forecast_samples(t.series, at, length=1440, most=880, closed=False, earliest_first=True)[1], "t1")


@query(
    "ts_kernel_resample",
    """, r AS (SELECT CAST(unnest(range(0, 11)) * 72 AS INT) AS r), k AS (SELECT series, item, r, exp(-0.001 * pow(minute / 60 - r, 2)) AS a, exp(-0.01 * pow(minute / 60 - r, 2)) AS b, value FROM ser, r)
    SELECT series, item, r, round(sum(a), 6) AS weight, round(sum(a * value) / greatest(sum(a), 1), 6) AS value, round(sum(b * value) / greatest(sum(b), 1), 6) AS sharp FROM k GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return rounded(S.kernel_resample(t.series, 72, 720, 0.001), "weight", "value", "sharp").withColumn("r", F.col("r").cast("int"))


@query(
    "static_vector",
    """, sv AS (SELECT encounter, avg(value) FILTER (WHERE item = 50801) AS a, avg(value) FILTER (WHERE item = 50802) AS b FROM ev GROUP BY encounter),
    v AS (SELECT ppl.encounter, CAST(age AS DOUBLE) AS age, a, b, ppl.encounter % 5 < 4 AS tr FROM ppl LEFT JOIN sv ON sv.encounter = ppl.encounter),
    z AS (SELECT avg(age) FILTER (WHERE tr) AS ma, stddev_pop(age) FILTER (WHERE tr) AS sa, avg(a) FILTER (WHERE tr) AS mb, stddev_pop(a) FILTER (WHERE tr) AS sb, avg(b) FILTER (WHERE tr) AS mc, stddev_pop(b) FILTER (WHERE tr) AS sc FROM v)
    SELECT encounter, round((age - ma) / sa, 6) AS age_z, 1 AS age_known, round(coalesce((a - mb) / sb, 0), 6) AS a_z, CAST(a IS NOT NULL AS INT) AS a_known, round(coalesce((b - mc) / sc, 0), 6) AS b_z, CAST(b IS NOT NULL AS INT) AS b_known FROM v, z""",
)
def _(t: Tables) -> DataFrame:
    wide = t.events.groupBy("encounter").pivot("item", [50801, 50802]).avg("value").toDF("encounter", "a", "b")
    rows = t.people.select("encounter", "age").join(wide, "encounter", "left")
    return rounded(S.static_vector(rows, ["age", "a", "b"], F.col("encounter") % 5 < 4, "encounter"), "age_z", "a_z", "b_z")


@query("target_vector", "SELECT series, label, round(CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) / count(*) OVER (), 6) AS share FROM lab")
def _(t: Tables) -> DataFrame:
    return rounded(S.targets(t.series_labels), "share")
