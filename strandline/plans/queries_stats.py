"""Queries: metrics, splits, catalog, result tables, selection, statistics and models, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import band
from strandline.operators import catalog as G
from strandline.operators import batched, metrics, models, selection, splits
from strandline.operators import series as S
from strandline.plans.queries_series import rounded
from strandline.plans.registry import query
from strandline.sources import readers
from strandline.sources.fixtures import Tables
from strandline.sources.scratch import scratch, written

# --- metrics -------------------------------------------------------------------------------------------------------

CURVE = """, bs AS (SELECT cohort, score, sum(label) AS pos, sum(1 - label) AS neg FROM sco GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY cohort) AS p, sum(neg) OVER (PARTITION BY cohort) AS n FROM bs WINDOW d AS (PARTITION BY cohort ORDER BY score DESC)),
pr AS (SELECT cohort, score, CAST(tp AS DOUBLE) / (tp + fp) AS pre, CAST(tp AS DOUBLE) / p AS rec FROM cu), pl AS (SELECT *, coalesce(lag(rec) OVER d, 0) AS r0, coalesce(lag(pre) OVER d, 1) AS p0 FROM pr WINDOW d AS (PARTITION BY cohort ORDER BY score DESC)),
ap AS (SELECT cohort, sum((rec - r0) * (pre + p0) / 2) AS auprc, max(least(pre, rec)) AS minrp FROM pl GROUP BY cohort),
au AS (SELECT a.cohort, CAST(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.pos * b.neg) AS DOUBLE) / (any_value(a.p) * any_value(a.n)) AS auroc FROM cu a JOIN cu b ON a.cohort = b.cohort GROUP BY a.cohort),
lo AS (SELECT cohort, avg(CASE WHEN label = 1 THEN -ln(least(greatest(score, 1e-7), 1 - 1e-7)) ELSE -ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)) END) AS loss FROM sco GROUP BY cohort),
ce AS (SELECT cohort, CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE score < 0.5 AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE score < 0.5 AND label = 0) AS DOUBLE) AS tn FROM sco GROUP BY cohort),
th AS (SELECT cohort, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_acc, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, 2 * tp / (2 * tp + fn + fp) AS f1, 5 * tp / (5 * tp + 4 * fn + fp) AS f2 FROM ce)
"""
SIX = ["precision", "recall", "balanced_acc", "mcc", "f1", "f2"]


def six(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in SIX)


@query("ev_logloss", CURVE + "SELECT cohort, round(loss, 6) AS loss FROM lo")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.log_loss(t.scores, ["cohort"]), "loss")


@query("ev_auroc", CURVE + "SELECT cohort, round(auroc, 6) AS auroc FROM au")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.auroc(t.scores, ["cohort"]), "auroc")


@query("ev_auprc", CURVE + "SELECT cohort, round(auprc, 6) AS auprc FROM ap")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.auprc(t.scores, ["cohort"]), "auprc").select("cohort", "auprc")


@query("ev_minrp", CURVE + "SELECT cohort, round(minrp, 6) AS minrp FROM ap")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.auprc(t.scores, ["cohort"]), "minrp").select("cohort", "minrp")


@query("ev_threshold", CURVE + f"SELECT cohort, {six()} FROM th")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.at_threshold(t.scores, ["cohort"]), *SIX)


FULL = f"SELECT cohort, round(loss, 6) AS loss, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(minrp, 6) AS minrp, {six()} FROM lo JOIN au USING (cohort) JOIN ap USING (cohort) JOIN th USING (cohort)"


@query("ev_results_row", CURVE + FULL)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.all_metrics(t.scores, ["cohort"]), "loss", "auroc", "auprc", "minrp", *SIX)


@query("ev_single_class", CURVE + "SELECT cohort || '+' AS cohort, CAST(NULL AS DOUBLE) AS auroc, CAST(NULL AS DOUBLE) AS f1, round(avg(-ln(least(greatest(score, 1e-7), 1 - 1e-7))), 6) AS loss FROM sco WHERE label = 1 GROUP BY cohort")
def _(t: Tables) -> DataFrame:
    rows = t.scores.filter("label = 1").withColumn("cohort", F.concat("cohort", F.lit("+")))
    return rounded(metrics.all_metrics(rows, ["cohort"]), "loss").select("cohort", F.col("auroc").cast("double").alias("auroc"), F.col("f1").cast("double").alias("f1"), "loss")


# --- splits --------------------------------------------------------------------------------------------------------

#: A rank that SQL can compute too: an arithmetic key in place of the hash; buckets are ranges of it.
def arithmetic() -> dict:
    key = F.pmod(F.col("entity") * 7919, F.lit(1_000_003))
    return {"key": key, "bucket": F.floor(key / 50_000)}


RANK = ", ce2 AS (SELECT cohort, entity, max(label) AS label FROM spl GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY cohort, label ORDER BY (entity * 7919) % 1000003) - 1 AS place FROM ce2)"
FOLDS = RANK + """, fo AS (SELECT cohort, entity, label, place, CAST(fold AS BIGINT) AS fold, place - (place + (4 - fold)) // 5 AS rest FROM rk, (SELECT unnest(range(5)) AS fold)),
kf AS (SELECT cohort, entity, label, fold, CASE WHEN place % 5 = fold THEN 'test' WHEN rest % 5 = fold % 5 THEN 'val' ELSE 'train' END AS split FROM fo)
"""  # fmt: skip


def folds(t: Tables) -> DataFrame:
    return splits.kfold(t.splits.select("cohort", "entity", "label"), **arithmetic()).withColumn("fold", F.col("fold").cast("long"))


@query("split_kfold_entity", FOLDS + "SELECT * FROM kf")
def _(t: Tables) -> DataFrame:
    return folds(t)


@query("split_sink", FOLDS + "SELECT * FROM kf")
def _(t: Tables) -> DataFrame:
    return readers.write_splits(folds(t), scratch(t.spark, "splits"))


@query("split_kfold_sizes", FOLDS + "SELECT cohort, fold, split, label, count(*) AS n FROM kf GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return folds(t).groupBy("cohort", "fold", "split", "label").agg(F.count("*").alias("n"))


@query("split_group_holdout", ", e AS (SELECT DISTINCT entity FROM enc), r AS (SELECT entity, row_number() OVER (ORDER BY (entity * 7919) % 1000003) - 1 AS place, count(*) OVER () AS n FROM e) SELECT entity, CASE WHEN place < round(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM r")
def _(t: Tables) -> DataFrame:
    return splits.group_holdout(t.encounters, **arithmetic())


@query("split_inner_groupfold", FOLDS + "SELECT cohort, entity, label, (row_number() OVER (PARTITION BY cohort, label ORDER BY (entity * 7919) % 1000003) - 1) % 3 AS inner_fold FROM kf WHERE fold = 0 AND split <> 'test'")
def _(t: Tables) -> DataFrame:
    return splits.inner_folds(folds(t).filter("fold = 0"), **arithmetic()).withColumnRenamed("inner", "inner_fold")


@query("split_final", "SELECT encounter, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split FROM spl")
def _(t: Tables) -> DataFrame:
    return splits.final(t.splits).select("encounter", "split")


@query("set_leak_check", ", m AS (SELECT entity, CASE WHEN encounter % 7 = 0 THEN 'test' ELSE split END AS split FROM spl) SELECT entity, count(DISTINCT split) AS splits FROM m GROUP BY entity HAVING count(DISTINCT split) > 1")
def _(t: Tables) -> DataFrame:
    rows = t.splits.withColumn("split", F.when(F.col("encounter") % 7 == 0, "test").otherwise(F.col("split")))
    return splits.leaks(rows, ["entity"], [])


SUM = """, su AS (SELECT cohort, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test,
count(*) FILTER (WHERE split = 'train' AND label = 1) AS pos_train, count(*) FILTER (WHERE split = 'val' AND label = 1) AS pos_val, count(*) FILTER (WHERE split = 'test' AND label = 1) AS pos_test FROM spl GROUP BY cohort)
"""


@query("split_counts", SUM + "SELECT *, " + ", ".join(f"round(n_{g} * 100.0 / n, 6) AS {g}_pct, round(CAST(pos_{g} AS DOUBLE) / nullif(n_{g}, 0), 6) AS pos_rate_{g}" for g in splits.GROUPS) + " FROM su")
def _(t: Tables) -> DataFrame:
    rows = splits.counts(t.splits)
    return rounded(rows, *[c for g in splits.GROUPS for c in (f"{g}_pct", f"pos_rate_{g}")])


def dev_sql(parts: str, whole: str) -> str:
    return " + ".join(f"abs({r} - CAST({parts.format(g)} AS DOUBLE) / {whole})" for g, r in zip(splits.GROUPS, (0.8, 0.1, 0.1)))


@query("split_objective", SUM + f"SELECT cohort, round(CASE WHEN n_pos >= 10 AND n - n_pos >= 10 THEN {dev_sql('pos_{}', 'n_pos')} + {dev_sql('(n_{0} - pos_{0})', '(n - n_pos)')} ELSE {dev_sql('n_{}', 'n')} END, 6) AS deviation FROM su")
def _(t: Tables) -> DataFrame:
    return rounded(splits.objective(splits.counts(t.splits)), "deviation")


WORST = "greatest(abs(n_train * 100.0 / n - 80), abs(n_val * 100.0 / n - 10), abs(n_test * 100.0 / n - 10))"
BANDS = "CASE WHEN {0} <= 1 THEN '≤1%' WHEN {0} <= 2 THEN '≤2%' WHEN {0} <= 3 THEN '≤3%' WHEN {0} <= 5 THEN '≤5%' WHEN {0} <= 10 THEN '≤10%' ELSE '>10%' END"


@query("split_deviation", SUM + f"SELECT cohort, round({WORST}, 6) AS max_dev, {BANDS.format(WORST)} AS band FROM su")
@query("scalar_deviation_bands", SUM + f"SELECT cohort, round({WORST}, 6) AS max_dev, {BANDS.format(WORST)} AS band FROM su")
def _(t: Tables) -> DataFrame:
    return rounded(splits.deviation_band(splits.counts(t.splits)), "max_dev").select("cohort", "max_dev", "band")


@query("split_cohort_folds", ", g AS (SELECT DISTINCT entity, split FROM spl) SELECT encounter, split FROM enc JOIN g USING (entity)")
def _(t: Tables) -> DataFrame:
    return splits.project(t.splits.select("entity", "split").distinct(), t.encounters).select("encounter", "split")


@query("split_overlap", ", a AS (SELECT DISTINCT entity, split FROM spl), b AS (SELECT entity, CASE WHEN entity % 4 = 0 THEN 'test' ELSE split END AS split FROM a WHERE entity % 9 > 0) SELECT coalesce(a.split, '-') AS a, coalesce(b.split, '-') AS b, count(*) AS n FROM a FULL JOIN b ON a.entity = b.entity GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    one = t.splits.select("entity", "split").distinct()
    two = one.filter("entity % 9 > 0").withColumn("split", F.when(F.col("entity") % 4 == 0, "test").otherwise(F.col("split")))
    return splits.overlap(one, two)


@query("split_optimise")
def _(t: Tables) -> DataFrame:
    """The group of every entity, balanced over the cohorts of its codes, and the objective that was reached."""
    members = t.codes.select(F.substring("code", 1, 3).alias("cohort"), "entity")
    groups, history = splits.optimise(members)
    return groups.withColumn("objective", F.round(F.lit(history[-1]), 6))


@query("split_global")
def _(t: Tables) -> DataFrame:
    own = splits.initial_groups(t.stays)
    return splits.extend_to_all(own, t.encounters).groupBy("split").agg(F.count("*").alias("n"))


@query("sample_oversample", ", c AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM lab) SELECT label, greatest(p, n) AS n FROM c, (SELECT DISTINCT label FROM lab)")
def _(t: Tables) -> DataFrame:
    return splits.oversample(t.series_labels).groupBy("label").agg(F.count("*").alias("n"))


@query("item_select", "SELECT entity, encounter, item, ts, value FROM ev WHERE item IN (SELECT item FROM itm WHERE item % 3 = 0)")
def _(t: Tables) -> DataFrame:
    return t.events.join(t.items.filter("item % 3 = 0").select("item"), "item", "left_semi").select("entity", "encounter", "item", "ts", "value")


@query("item_in_train", "SELECT series, item, count(*) AS n FROM ser WHERE item IN (SELECT item FROM ser JOIN lab USING (series) WHERE split = 'train' AND series % 3 = 0) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    own = t.series_labels.withColumn("split", F.when(F.col("series") % 3 == 0, F.col("split")).otherwise("test"))
    return splits.seen_in_train(t.series, own).groupBy("series", "item").agg(F.count("*").alias("n"))


@query("ids_in_data", ", d AS (SELECT DISTINCT encounter FROM ev WHERE item = 50801) SELECT split, count(d.encounter) AS with_data, count(*) FILTER (WHERE d.encounter IS NULL) AS missing FROM spl LEFT JOIN d ON d.encounter = spl.encounter GROUP BY split")
def _(t: Tables) -> DataFrame:
    return splits.with_data(t.splits, t.events.filter("item = 50801"))


# --- catalog and results -------------------------------------------------------------------------------------------


@query("catalog_query", "SELECT cohort, rr, n_pos FROM cat WHERE rr >= 1.5 AND n_pos >= 3 AND n_pos + n_neg >= 8 AND age_days <= 365.25 * 50 AND d1 <> 'E00'")
def _(t: Tables) -> DataFrame:
    rows = t.catalog.withColumn("n_total", F.col("n_pos") + F.col("n_neg")).filter("d1 <> 'E00'")
    return G.query(rows, {"rr": (1.5, None), "n_pos": (3, None), "n_total": (8, None), "age_days": (None, 365.25 * 50)}).select("cohort", "rr", "n_pos")


@query("sort_catalog", "SELECT cohort, rr FROM cat ORDER BY rr DESC, cohort")
def _(t: Tables) -> DataFrame:
    return G.query(t.catalog).select("cohort", "rr")


MAP = "CASE substr({}, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.CATALOG_CHAPTERS.items()) + " END"
CHAR = f""", chx AS (SELECT *, n_pos + n_neg AS n_total, CAST(n_pos AS DOUBLE) / (n_pos + n_neg) AS target_rate, CAST(n_neg AS DOUBLE) / nullif(n_pos, 0) AS imbalance, {MAP.format('d1')} AS d1_type, {MAP.format('d2')} AS d2_type FROM cat),
chy AS (SELECT *, CASE WHEN target_rate > 0 THEN ln(target_rate) END AS log_target_rate, ln(n_total) AS log_n_total, ln(rr) AS log_rr, CASE WHEN imbalance > 0 THEN ln(imbalance) END AS log_imbalance FROM chx)"""


@query("catalog_characterise", CHAR + "SELECT cohort, n_total, d1_type, d2_type, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("target_rate", "imbalance", "log_target_rate", "log_n_total", "log_rr", "log_imbalance")) + " FROM chy")
def _(t: Tables) -> DataFrame:
    numbers = ["target_rate", "imbalance", "log_target_rate", "log_n_total", "log_rr", "log_imbalance"]
    return rounded(G.characterise(t.catalog), *numbers).select("cohort", "n_total", "d1_type", "d2_type", *numbers)


@query("catalog_reliable", "SELECT cohort, CAST(n_pos * 0.5 >= 3 AND n_neg * 0.5 >= 3 AS INT) AS reliable FROM cat")
def _(t: Tables) -> DataFrame:
    return G.reliable(t.catalog, 0.5, 3).select("cohort", "reliable")


@query("catalog_sink", CHAR + "SELECT cohort, d1_type FROM chy WHERE n_pos * 0.5 >= 3 AND n_neg * 0.5 >= 3")
def _(t: Tables) -> DataFrame:
    summary, reliable = readers.write_catalog(G.reliable(G.characterise(t.catalog), 0.5, 3), scratch(t.spark, "catalog"))
    return summary.join(reliable, "cohort", "left_semi").select("cohort", "d1_type")


@query("catalog_scan", "SELECT DISTINCT cohort FROM spl")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "cohorts")
    readers.write_cohorts(t.splits, path)
    return readers.cohorts_on_disk(t.spark, path)


EQUAL = ", ba AS (SELECT cohort, n_pos + n_neg AS n, min(n_pos + n_neg) OVER () AS lo, CAST(max(n_pos + n_neg) OVER () - min(n_pos + n_neg) OVER () AS DOUBLE) / 4 AS s FROM cat), bb AS (SELECT cohort, n, CASE WHEN n <= lo + s THEN 'very_low' WHEN n <= lo + s * 2 THEN 'low' WHEN n <= lo + s * 3 THEN 'medium' ELSE 'high' END AS band FROM ba)"


def banded(t: Tables) -> DataFrame:
    return G.equal_bands(t.catalog.select("cohort", (F.col("n_pos") + F.col("n_neg")).alias("n")), "n", "band")


@query("scalar_bands", EQUAL + "SELECT * FROM bb")
def _(t: Tables) -> DataFrame:
    return banded(t)


@query("scalar_fixed_bands", "SELECT encounter, CASE WHEN los <= 2.25 THEN 'short' WHEN los <= 6.25 THEN 'middle' ELSE 'long' END AS band FROM enc")
def _(t: Tables) -> DataFrame:
    return t.encounters.select("encounter", band(F.col("los"), (2.25, 6.25, float("inf")), ("short", "middle", "long")).alias("band"))


@query("sample_per_band", EQUAL + "SELECT cohort, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY cohort) AS k FROM bb) WHERE k <= 10")
def _(t: Tables) -> DataFrame:
    return G.first_per_band(banded(t), "band", 10, "cohort").select("cohort", "band")


@query("agg_type_counts", ", a AS (SELECT d1 AS type, count(*) AS n FROM cat GROUP BY d1), b AS (SELECT d2 AS type, count(*) AS n FROM cat GROUP BY d2) SELECT coalesce(a.type, b.type) AS type, coalesce(a.n, 0) AS n_one, coalesce(b.n, 0) AS n_two FROM a FULL JOIN b ON a.type = b.type")
def _(t: Tables) -> DataFrame:
    return G.type_counts(t.catalog, "d1", "d2")


@query("agg_distinct_pairs", "SELECT substr(d1, 1, 1) AS one, count(DISTINCT substr(d2, 1, 1)) AS partners, string_agg(DISTINCT substr(d2, 1, 1), ',' ORDER BY substr(d2, 1, 1)) AS list FROM cat GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.catalog.groupBy(F.substring("d1", 1, 1).alias("one")).agg(F.sort_array(F.collect_set(F.substring("d2", 1, 1))).alias("s"))
    return rows.select("one", F.size("s").cast("long").alias("partners"), F.array_join("s", ",").alias("list"))


DESC = "count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0}) AS least, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75, max({0}) AS largest"


@query("agg_describe", f"SELECT race, {DESC.format('los')} FROM enc GROUP BY race")
def _(t: Tables) -> DataFrame:
    from strandline.operators.profiles import describe

    return rounded(describe(t.encounters, "los", ["race"]), "mean", "std", "p25", "p50", "p75")


@query("agg_label_size", "SELECT substr(code, 1, 3) AS grp, min(code) AS title, count(DISTINCT entity) AS n FROM cod GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.codes.groupBy(F.substring("code", 1, 3).alias("grp")).agg(F.min_by("code", "code").alias("title"), F.countDistinct("entity").alias("n"))


@query("agg_crosstab_norm", ", c AS (SELECT race, died, count(*) AS n FROM enc GROUP BY ALL) SELECT race, died, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY race), 6) AS share FROM c")
def _(t: Tables) -> DataFrame:
    return rounded(G.crosstab_shares(t.encounters, "race", "died"), "share")


@query("largest_cohort", "SELECT cohort, n_pos + n_neg AS n FROM cat WHERE n_pos > 0.01 * (n_pos + n_neg) ORDER BY n_pos + n_neg DESC, cohort LIMIT 5")
def _(t: Tables) -> DataFrame:
    rows = t.catalog.withColumn("n", F.col("n_pos") + F.col("n_neg")).filter("n_pos > 0.01 * n")
    return rows.orderBy(F.desc("n"), "cohort").limit(5).select("cohort", "n")


@query("topk_cohorts", "SELECT cohort, model, round(avg(auroc), 6) AS auroc FROM res GROUP BY ALL ORDER BY avg(auroc) DESC, cohort, model LIMIT 50")
def _(t: Tables) -> DataFrame:
    means = t.results.groupBy("cohort", "model").agg(F.avg("auroc").alias("auroc"))
    return rounded(means.orderBy(F.desc("auroc"), "cohort", "model").limit(50), "auroc")


IMP = ", im AS (SELECT model AS variant, 'f' || cohort AS feature, max(auroc) AS importance FROM res GROUP BY ALL)"


@query("topk_importance", IMP + ", k AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY importance DESC, feature) AS place FROM im) SELECT CAST(place AS INT) AS place, max(feature) FILTER (WHERE variant = '1-URGENT') AS urgent, max(feature) FILTER (WHERE variant = '5-LOW') AS low FROM k WHERE place <= 10 GROUP BY place")
def _(t: Tables) -> DataFrame:
    rows = t.results.groupBy(F.col("model").alias("variant"), F.concat(F.lit("f"), F.col("cohort").cast("string")).alias("feature")).agg(F.max("auroc").alias("importance"))
    wide = G.top_side_by_side(rows, 10, variants=["1-URGENT", "5-LOW"])
    return wide.select("place", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


RATES = ", rt AS (SELECT o_custkey % 40 AS cohort, avg(CAST(o_orderstatus = 'F' AS INT)) AS target_rate FROM orders GROUP BY 1)"


@query("agg_result_means", RATES + ", m AS (SELECT cohort, model, avg(auroc) AS auroc, avg(auprc) AS auprc FROM res GROUP BY ALL) SELECT cohort, model, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(auprc - target_rate, 6) AS lift, round(auprc / target_rate, 6) AS gain FROM m JOIN rt USING (cohort)")
def _(t: Tables) -> DataFrame:
    rates = t.raw("orders").groupBy((F.col("o_custkey") % 40).alias("cohort")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("target_rate"))
    return rounded(G.result_means(t.results, rates), "auroc", "auprc", "lift", "gain").drop("target_rate")


@query("agg_best_params", ", m AS (SELECT cohort, model, depth, avg(auroc) AS auroc, avg(epoch) AS epoch FROM res GROUP BY ALL) SELECT cohort, model, depth, round(auroc, 6) AS auroc, round(epoch, 6) AS epoch FROM (SELECT *, row_number() OVER (PARTITION BY cohort, model ORDER BY auroc DESC, depth NULLS FIRST) AS k FROM m) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return rounded(G.best_params(t.results, ["cohort", "model"], ["depth"]), "auroc", "epoch")


@query("agg_grid_complete", ', g AS (SELECT cohort, model, count(*) AS "rows", (count(DISTINCT coalesce(depth, -1)) * 5) AS expected FROM res WHERE prefix = \'old\' GROUP BY ALL) SELECT * FROM g WHERE "rows" <> expected')
def _(t: Tables) -> DataFrame:
    rows = t.results.filter("prefix = 'old'").withColumn("depth", F.coalesce("depth", F.lit(-1)))
    return G.incomplete_grids(rows, ["cohort", "model"], ["depth"], 5)


@query("ml_param_grid", ", a AS (SELECT DISTINCT model FROM res), b AS (SELECT DISTINCT fold FROM res), c AS (SELECT DISTINCT prefix FROM res) SELECT model, fold, prefix FROM a, b, c")
def _(t: Tables) -> DataFrame:
    return G.param_grid(t.results, ["model", "fold", "prefix"])


@query("ml_random_search", ", a AS (SELECT DISTINCT model FROM res), b AS (SELECT DISTINCT fold FROM res) SELECT model, fold FROM a, b ORDER BY (fold * 3) % 5, model LIMIT 7")
def _(t: Tables) -> DataFrame:
    return G.random_params(G.param_grid(t.results, ["model", "fold"]), 7, order=F.struct((F.col("fold") * 3) % 5, "model"))


FIRSTP = ", ff AS (SELECT *, rank() OVER (PARTITION BY cohort, model, fold ORDER BY CASE prefix WHEN 'new' THEN 1 ELSE 2 END) AS k FROM res) SELECT cohort, model, prefix, fold, depth, round(auroc, 6) AS auroc FROM ff WHERE k = 1"


RESULT = ["cohort", "model", "prefix", "fold", "depth", "auroc"]


def stored_results(t: Tables) -> str:
    """Results of two runs in one folder, one appended to the other."""
    path, runs = scratch(t.spark, "results"), t.results.select(RESULT)
    for prefix in ("old", "new"):
        readers.append_results(runs.filter(F.col("prefix") == prefix), path)
    return path


@query("results_sink", "SELECT cohort, model, prefix, fold, depth, round(auroc, 6) AS auroc FROM res")
def _(t: Tables) -> DataFrame:
    return rounded(readers.read_results(t.spark, stored_results(t), t.results.select(RESULT).schema), "auroc")


@query("results_scan", FIRSTP)
def _(t: Tables) -> DataFrame:
    rows = readers.read_results(t.spark, stored_results(t), t.results.select(RESULT).schema, ["new", "old"], ["auroc"])
    return rounded(rows, "auroc").select(RESULT)


@query("agg_set_overlap", ", w AS (SELECT cohort, avg(auroc) FILTER (WHERE model = '1-URGENT') AS a, avg(auroc) FILTER (WHERE model = '5-LOW') AS b FROM res GROUP BY cohort) SELECT count(*) FILTER (WHERE a > b) AS better, count(*) FILTER (WHERE a = b) AS equal, count(*) FILTER (WHERE a < b) AS worse FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return G.better_sets(t.results, "cohort", "model", "auroc", "1-URGENT", "5-LOW")


@query("agg_cluster_describe", "SELECT cohort % 6 AS cluster, round(avg(auroc), 6) AS mean, round(stddev_samp(auroc), 6) AS std, count(*) AS n FROM res GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.results.groupBy((F.col("cohort") % 6).alias("cluster")).agg(F.avg("auroc").alias("mean"), F.stddev_samp("auroc").alias("std"), F.count("*").alias("n"))
    return rounded(rows, "mean", "std")


@query("win_pair_rank", "SELECT encounter, row_number() OVER (PARTITION BY entity ORDER BY encounter) - 1 AS place FROM enc")
def _(t: Tables) -> DataFrame:
    return t.encounters.select("encounter", (F.expr("row_number() over (partition by entity order by encounter)") - 1).cast("long").alias("place"))


@query("win_group_avg", "SELECT cohort, model, fold, prefix, depth, round(avg(auroc) OVER (PARTITION BY cohort, model), 6) AS mean FROM res")
def _(t: Tables) -> DataFrame:
    return t.results.select("cohort", "model", "fold", "prefix", "depth", F.round(F.expr("avg(auroc) over (partition by cohort, model)"), 6).alias("mean"))


@query("set_union_cohorts", "SELECT entity FROM ent WHERE age > 80 UNION SELECT entity FROM st WHERE unit = 'CCU'")
def _(t: Tables) -> DataFrame:
    return t.entities.filter("age > 80").select("entity").unionByName(t.stays.filter("unit = 'CCU'").select("entity")).distinct()


@query("set_intersect", "SELECT entity FROM ent WHERE age > 60 INTERSECT SELECT entity FROM st")
def _(t: Tables) -> DataFrame:
    return t.entities.filter("age > 60").select("entity").intersect(t.stays.select("entity"))


@query("set_except", "SELECT entity FROM ent EXCEPT SELECT entity FROM st")
def _(t: Tables) -> DataFrame:
    return t.entities.select("entity").subtract(t.stays.select("entity"))


# --- selection and statistics --------------------------------------------------------------------------------------

MEANS = """, tm AS (SELECT cohort, encounter, item, avg(value) AS value, any_value(label) AS label FROM spl JOIN ev USING (encounter) WHERE split = 'train' AND value IS NOT NULL GROUP BY cohort, encounter, item),
cr AS (SELECT cohort, item, count(*) AS n, corr(value, label) AS r, count(DISTINCT value) AS v, count(DISTINCT label) AS l FROM tm GROUP BY cohort, item),
cx AS (SELECT cohort, item, n, CASE WHEN n < 60 THEN 'min_count' WHEN v < 2 THEN 'value_const' WHEN l < 2 THEN 'label_const' END AS reason, r FROM cr)"""


def means(t: Tables) -> DataFrame:
    return selection.item_means(t.events, t.splits.select("cohort", "encounter", "label", "split"))


def tests(t: Tables) -> DataFrame:
    return selection.with_pvalues(selection.correlations(means(t), 60)).filter("reason is null")


@query("fs_corr", MEANS + "SELECT cohort, item, n, round(CASE WHEN reason IS NULL THEN r END, 6) AS r, reason FROM cx")
def _(t: Tables) -> DataFrame:
    return rounded(selection.correlations(means(t), 60), "r")


@query("fs_corr_pvalues")
def _(t: Tables) -> DataFrame:
    return rounded(tests(t), "r", "p")


#: P-values that SQL has too: the same test on a score in place of p.
PSEUDO = MEANS + ", pv AS (SELECT cohort, item, (1 - abs(r)) * (1 - abs(r)) * 0.2 AS p FROM cx WHERE reason IS NULL)"


def pseudo(t: Tables) -> DataFrame:
    own = selection.correlations(means(t), 60).filter("reason is null")
    return own.select("cohort", "item", ((1 - F.abs("r")) * (1 - F.abs("r")) * 0.2).alias("p"))


@query("fs_bh_fdr", PSEUDO + """, rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p) AS i, count(*) OVER (PARTITION BY cohort) AS m FROM pv), ct AS (SELECT cohort, max(p) AS cut FROM rk WHERE p <= 0.19 * i / m GROUP BY cohort)
    SELECT cohort, item, CAST(coalesce(p <= cut, false) AS INT) AS selected FROM pv LEFT JOIN ct USING (cohort)""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return selection.benjamini_hochberg(pseudo(t), 0.19).select("cohort", "item", "selected")


@query("fs_topk", PSEUDO + "SELECT cohort, item, CAST(row_number() OVER (PARTITION BY cohort ORDER BY p, item) <= 3 AS INT) AS selected FROM pv")
def _(t: Tables) -> DataFrame:
    return selection.top_k(pseudo(t), 3).select("cohort", "item", "selected")


@query("fs_summary", PSEUDO + ", s AS (SELECT cohort, row_number() OVER (PARTITION BY cohort ORDER BY p, item) <= 3 AS s FROM pv) SELECT cohort, count(*) AS tested, count(*) FILTER (WHERE s) AS selected FROM s GROUP BY cohort")
def _(t: Tables) -> DataFrame:
    return selection.top_k(pseudo(t), 3).groupBy("cohort").agg(F.count("*").alias("tested"), F.count_if(F.col("selected") == 1).alias("selected"))


@query("st_holm", PSEUDO + """, rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p, item) AS i, count(*) OVER (PARTITION BY cohort) AS m FROM pv)
    SELECT cohort, item, round(least(max(p * (m - i + 1)) OVER (PARTITION BY cohort ORDER BY i), 1), 6) AS adjusted FROM rk""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return rounded(selection.holm(pseudo(t), ["cohort"]), "adjusted").select("cohort", "item", "adjusted")


@query("fs_mrmr")
def _(t: Tables) -> DataFrame:
    return selection.mrmr(means(t), 5)


FSTAT = MEANS + """, sz AS (SELECT cohort, count(DISTINCT encounter) FILTER (WHERE label = 1) AS p, count(DISTINCT encounter) FILTER (WHERE label = 0) AS q FROM tm GROUP BY cohort),
full_ AS (SELECT e.cohort, e.label, i.item, coalesce(tm.value, 0) AS x FROM (SELECT DISTINCT cohort, encounter, label FROM tm) e JOIN (SELECT DISTINCT cohort, item FROM tm) i USING (cohort) LEFT JOIN tm ON tm.cohort = e.cohort AND tm.encounter = e.encounter AND tm.item = i.item),
gm AS (SELECT cohort, item, avg(x) AS m, avg(x) FILTER (WHERE label = 1) AS mp, avg(x) FILTER (WHERE label = 0) AS mq, var_pop(x) * count(*) AS ss, count(*) AS k FROM full_ GROUP BY ALL)"""  # fmt: skip


@query("fs_f_statistic", FSTAT + "SELECT cohort, item, round((p * (mp - m) * (mp - m) + q * (mq - m) * (mq - m)) / ((ss - p * (mp - m) * (mp - m) - q * (mq - m) * (mq - m)) / (k - 2)), 5) AS f FROM gm JOIN sz USING (cohort) WHERE p > 0 AND q > 0")
def _(t: Tables) -> DataFrame:
    return selection.f_statistics(means(t)).filter("f is not null").select("cohort", "item", F.round("f", 5).alias("f"))


ENT = MEANS + """, lim AS (SELECT cohort, label, item, min(value) AS lo, max(value) AS hi FROM tm GROUP BY ALL), bn AS (SELECT cohort, label, item, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 10), 9) ELSE 5 END AS INT) AS bin FROM tm JOIN lim USING (cohort, label, item)),
gr AS (SELECT l.cohort, l.label, l.item, b.bin FROM lim l, (SELECT unnest(range(10)) AS bin) b), hc AS (SELECT g.cohort, g.label, g.item, g.bin, count(bn.bin) + 1 AS c FROM gr g LEFT JOIN bn ON bn.cohort = g.cohort AND bn.label = g.label AND bn.item = g.item AND bn.bin = g.bin GROUP BY ALL),
hp AS (SELECT *, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY cohort, label, item) AS p FROM hc), ht AS (SELECT cohort, label, item, -sum(p * ln(p)) AS h FROM hp GROUP BY ALL),
dd AS (SELECT cohort, item, abs(avg(value) FILTER (WHERE label = 1) - avg(value) FILTER (WHERE label = 0)) / (stddev_samp(value) + 1e-8) AS d FROM tm GROUP BY ALL)
"""  # fmt: skip


@query("agg_entropy_hist", ENT + "SELECT cohort, label, item, round(h, 6) AS h FROM ht")
def _(t: Tables) -> DataFrame:
    return rounded(selection.entropy(means(t), ["cohort", "label"]), "h")


@query("agg_cohens_d", ENT + "SELECT cohort, item, round(d, 6) AS d FROM dd")
def _(t: Tables) -> DataFrame:
    return rounded(selection.cohens_d(means(t)), "d")


@query(
    "st_feature_stats",
    ENT + """, ns AS (SELECT cohort, count(DISTINCT encounter) AS n FROM spl WHERE split = 'train' GROUP BY cohort), mi AS (SELECT cohort, item, 1 - CAST(count(DISTINCT encounter) AS DOUBLE) / any_value(n) AS miss FROM tm JOIN ns USING (cohort) GROUP BY cohort, item),
    m2 AS (SELECT cohort, avg(miss) AS mm, var_samp(miss) AS mv FROM mi GROUP BY cohort), h2 AS (SELECT cohort, avg(h) FILTER (WHERE label = 1) AS hp, avg(h) FILTER (WHERE label = 0) AS hn FROM ht GROUP BY cohort), d2 AS (SELECT cohort, avg(d) AS d FROM dd GROUP BY cohort)
    SELECT cohort, round(mm, 6) AS missing_mean, round(mv, 6) AS missing_var, round(hp, 6) AS h_pos, round(hn, 6) AS h_neg, round(d, 6) AS d, round(ln(hn / hp), 6) AS log_ratio FROM m2 JOIN h2 USING (cohort) JOIN d2 USING (cohort)""",
)
def _(t: Tables) -> DataFrame:
    rows = selection.feature_stats(means(t), t.splits.filter("split = 'train'"))
    return rounded(rows, *[c for c in rows.columns if c != "cohort"])


@query("st_pearson", "SELECT model, round(corr(auroc, auprc), 6) AS r FROM res GROUP BY model")
def _(t: Tables) -> DataFrame:
    return t.results.groupBy("model").agg(F.round(selection.pearson(F.col("auroc"), F.col("auprc")), 6).alias("r"))


AVGRANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"


@query("st_spearman", f", k AS (SELECT model, {AVGRANK.format('model', 'auroc')} AS x, {AVGRANK.format('model', 'auprc')} AS y FROM res) SELECT model, count(*) AS n, round(corr(x, y), 6) AS r FROM k GROUP BY model")
def _(t: Tables) -> DataFrame:
    return rounded(selection.spearman(t.results, "auroc", "auprc", ["model"]), "r")


PAIRS = ", pa AS (SELECT cohort, model, avg(auroc) FILTER (WHERE prefix = 'new') AS a, avg(auroc) FILTER (WHERE prefix = 'old') AS b FROM res GROUP BY ALL), pq AS (SELECT *, round(a - b, 12) AS d FROM pa WHERE a IS NOT NULL AND b IS NOT NULL)"


def paired(t: Tables) -> DataFrame:
    return t.results.groupBy("cohort", "model").agg(F.avg(F.when(F.col("prefix") == "new", F.col("auroc"))).alias("a"), F.avg(F.when(F.col("prefix") == "old", F.col("auroc"))).alias("b"))


@query("st_paired_t", PAIRS + "SELECT model, count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM pq GROUP BY model")
def _(t: Tables) -> DataFrame:
    return rounded(selection.paired_t(paired(t), "a", "b", ["model"]), "mean_diff", "t")


@query("st_wilcoxon", PAIRS + f", z AS (SELECT model, d, abs(d) AS a FROM pq WHERE d <> 0), k AS (SELECT model, d, {AVGRANK.format('model', 'a')} AS r FROM z) SELECT model, count(*) AS n, CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS w FROM k GROUP BY model")
def _(t: Tables) -> DataFrame:
    return selection.wilcoxon(paired(t), "a", "b", ["model"])


KRUSKAL = f""", k AS (SELECT model, cohort % 4 AS grp, floor(auroc * 50) AS x FROM res), r AS (SELECT *, {AVGRANK.format('model', 'x')} AS r FROM k), g AS (SELECT model, grp, count(*) AS n, sum(r) AS s FROM r GROUP BY ALL),
ti AS (SELECT model, sum(t) AS n, sum(t * t * t - t) AS ties FROM (SELECT model, x, count(*) AS t FROM k GROUP BY ALL) GROUP BY model)"""


def by_group(t: Tables) -> DataFrame:
    return t.results.select("model", (F.col("cohort") % 4).alias("grp"), F.floor(F.col("auroc") * 50).alias("x"))


@query("st_kruskal", KRUSKAL + "SELECT g.model, round((12.0 / (any_value(ti.n) * (any_value(ti.n) + 1)) * sum(s * s / g.n) - 3 * (any_value(ti.n) + 1)) / (1 - CAST(any_value(ties) AS DOUBLE) / (pow(any_value(ti.n), 3) - any_value(ti.n))), 5) AS h, count(*) - 1 AS df FROM g JOIN ti ON ti.model = g.model GROUP BY g.model")
def _(t: Tables) -> DataFrame:
    return selection.kruskal(by_group(t), "x", "grp", ["model"]).withColumn("h", F.round("h", 5))


@query("st_dunn", KRUSKAL + "SELECT a.model, a.grp AS a, b.grp AS b, round(abs(a.s / a.n - b.s / b.n) / sqrt((ti.n * (ti.n + 1) - CAST(ties AS DOUBLE) / (ti.n - 1)) / 12 * (1.0 / a.n + 1.0 / b.n)), 5) AS z FROM g a JOIN g b ON a.model = b.model AND a.grp < b.grp JOIN ti ON ti.model = a.model")
def _(t: Tables) -> DataFrame:
    return selection.dunn(by_group(t), "x", "grp", ["model"]).withColumn("z", F.round("z", 5))


# --- models --------------------------------------------------------------------------------------------------------


def features(t: Tables) -> DataFrame:
    """(series, features, label, split) of the event series, as vectors."""
    train = t.series_labels.filter("split = 'train'")
    grid = S.standardise(S.fill(S.grid_delta(S.discretise(S.with_bins(t.series, 72)))), train)
    return written(models.as_vector(S.flatten(grid)).join(t.series_labels, "series"), "features")


def scored(t: Tables, kind: str, **params: float) -> DataFrame:
    return rounded(models.fit_score(features(t), kind, **params)[0], "score")


@query("ml_random_forest")
def _(t: Tables) -> DataFrame:
    return scored(t, "random_forest", numTrees=20)


@query("ml_logistic")
def _(t: Tables) -> DataFrame:
    return scored(t, "logistic")


@query("ml_fit_protocol")
def _(t: Tables) -> DataFrame:
    """Both branches of the protocol; a quarter of the training series are for validation."""
    rows = features(t).withColumn("split", F.when((F.col("split") == "train") & (F.col("series") % 5 == 3), "val").otherwise(F.col("split")))
    parts = [models.fit_protocol(rows, "logistic", grid)[0].withColumn("branch", F.lit("grid" if grid else "final")) for grid in (True, False)]
    return rounded(parts[0].unionByName(parts[1]), "score")


@query("ml_gbt")
def _(t: Tables) -> DataFrame:
    return scored(t, "gbt", maxIter=5)


@query("ml_mlp")
def _(t: Tables) -> DataFrame:
    return scored(t, "mlp", maxIter=20)


@query("ml_importance")
def _(t: Tables) -> DataFrame:
    _scores, model = models.fit_score(features(t), "random_forest", numTrees=20)
    return models.importances(model, [f"f{k}" for k in range(model.numFeatures)])


@query("ml_nested_cv")
def _(t: Tables) -> DataFrame:
    """Test scores by the penalty that three inner folds choose for each cohort: all series, and each third of them."""
    rows = features(t).withColumn("features", vector_to_array("features")).withColumn("inner", F.pmod(F.xxhash64("series"), F.lit(3)).cast("int"))
    cohorts = F.array(F.lit("all"), F.concat(F.lit("part"), (F.col("series") % 3).cast("string")))
    scores, _chosen = batched.train(rows.withColumn("cohort", F.explode(cohorts)), "nested", [0.1, 1.0])
    return rounded(scores.select("cohort", "series", "label", "score"), "score")


@query("st_kmeans")
def _(t: Tables) -> DataFrame:
    return models.clusters(features(t), 4)[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query("st_silhouette")
def _(t: Tables) -> DataFrame:
    """Inertia and silhouette for several numbers of clusters."""
    rows = features(t)
    found = [(k, *models.clusters(rows, k)[1:]) for k in range(2, 11)]
    return t.spark.createDataFrame(found, "k long, inertia double, silhouette double")


@query("st_medoids")
def _(t: Tables) -> DataFrame:
    return models.medoids(models.clusters(features(t), 100)[0])


@query("st_pca")
def _(t: Tables) -> DataFrame:
    return models.principal(features(t)).select("series", F.round(F.abs(F.col("components")[0]), 6).alias("first"), F.round(F.abs(F.col("components")[1]), 6).alias("second"))
