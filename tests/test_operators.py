"""Operators on frames of a few rows: boundaries, nulls, ties, and independent recomputation."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import pvalues, scalar
from strandline.operators import catalog, codes, firsts, intervals, labels, metrics, models, selection, series, splits, trajectory
from strandline.plans import cohorts, queries_cohorts, specs
from strandline.schemas import conform
from strandline.sources import readers
from strandline.sources.fixtures import Tables
from strandline.streaming import incremental

T0 = dt.datetime(2020, 1, 1)


def day(n, h=0):
    return T0 + dt.timedelta(days=n, hours=h)


def test_code_flags_dots_versions_and_missing(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "entity long, encounter long")
    own = spark.createDataFrame([(1, 10, "I21.4", 10), (1, 10, "410", 9), (2, 20, "V221", 9), (2, None, "C61", 10)], "entity long, encounter long, code string, version int")
    rules = {"mi": codes.matches(("I214",)), "nine": codes.matches(exact=("410",), version=9), "ten": codes.matches(exact=("410",), version=10), "part": codes.matches(parts=("22",))}
    found = {r.encounter: r for r in codes.code_flags(rows, own, rules).collect()}
    assert (found[10].mi, found[10].nine, found[10].ten) == (True, True, False)
    assert found[20].part and not found[30].mi and not found[30].part
    assert {r.entity for r in codes.code_flags(rows, own, {"c": codes.matches(("C",))}, "entity").filter("c").collect()} == {2}


def test_firsts_keep_or_break_ties(spark):
    rows = spark.createDataFrame([(1, 11, day(0)), (1, 12, day(0)), (1, 13, day(1)), (2, 21, day(5))], "entity long, stay long, intime timestamp_ntz")
    assert {r.stay for r in firsts.first_ties(rows, "entity", "intime").collect()} == {11, 12, 21}
    assert {r.stay for r in firsts.first_row(rows, "entity", "intime", "stay").collect()} == {11, 21}


def test_death_before_begin_and_without_date(spark):
    rows = spark.createDataFrame(
        [(1, day(0, 5), None, day(0)), (2, day(0), None, day(28)), (3, day(0), None, day(29)), (4, day(0), None, None), (5, day(0), day(3), day(90))],
        "stay long, intime timestamp_ntz, death timestamp_ntz, dod timestamp_ntz",
    )
    assert [r.l for r in rows.select(labels.died_within(28).alias("l"), "stay").orderBy("stay").collect()] == [0, 1, 0, 0, 1]
    assert [r.l for r in rows.select(labels.survival(31).alias("l"), "stay").orderBy("stay").collect()] == [0, 0, 0, 0, 1]


def test_lookback_edges_and_two_encounters(spark):
    enc = spark.createDataFrame([(1, 10, day(20, 6)), (1, 11, day(25))], "entity long, encounter long, disch timestamp_ntz")
    ev = spark.createDataFrame([(1, 5, day(6, 6), 1.0), (1, 5, day(6, 5), 2.0), (1, 5, day(20, 6), 3.0), (1, 5, day(20), None), (2, 5, day(20), 4.0)], "entity long, item long, ts timestamp_ntz, value double")
    for by_day in (False, True):
        got = sorted((r.encounter, r.value, r.minute) for r in intervals.lookback_events(ev, enc, by_day=by_day).collect())
        assert got == [(10, 1.0, 360.0), (10, 3.0, 14 * 1440 + 360.0), (11, 3.0, 9 * 1440 + 360.0)]


def test_window_flags_boundaries(spark):
    stays = spark.createDataFrame([(1, day(0), day(4))], "stay long, intime timestamp_ntz, outtime timestamp_ntz")
    ev = spark.createDataFrame([(1, day(1)), (1, day(5))], "stay long, ts timestamp_ntz")
    tests = {"early": F.col("hours") < 24, "late": F.col("hours") >= 24, "after": F.col("hours") > 100}
    row = intervals.window_flags(stays, ev, tests, inside="outtime").first()
    assert (row.early, row.late, row.after) == (False, True, False)


def test_rise_equals_pair_loop(spark):
    rng = random.Random(1)
    rows = [(s, day(0) + dt.timedelta(hours=h), round(rng.random() * 2, 2)) for s in range(30) for h in sorted(rng.sample(range(200), 6))]
    got = {r.stay: r.rises for r in intervals.largest_rise(spark.createDataFrame(rows, "stay long, ts timestamp_ntz, value double"), rise=0.9).collect()}
    for s in range(30):
        own = [(t, v) for k, t, v in rows if k == s]
        assert got[s] == any(b - a >= 0.9 and dt.timedelta(0) <= u - t <= dt.timedelta(hours=48) for t, a in own for u, b in own)


def test_trajectory_unknown_death_is_kept(spark):
    enc = spark.createDataFrame([(1, 10, day(1), "F", 50, None), (1, 11, day(9), "F", 50, None), (2, 20, day(1), "M", 60, day(2)), (2, 21, day(9), "M", 60, day(2))], "entity long, encounter long, admit timestamp_ntz, gender string, age int, dod timestamp_ntz")
    dates = spark.createDataFrame([(1, "A00", day(1)), (2, "A00", day(1)), (1, "B01", day(400))], "entity long, grp string, first_at timestamp_ntz")
    edges = spark.createDataFrame([("A00", "B01", 5.5), ("A00", "B01", 5.5)], "d1 string, d2 string, diff_days double")
    rows = trajectory.trajectory_rows(firsts.with_next(enc), dates, edges).collect()
    assert [(r.encounter, r.label) for r in rows] == [(10, 1)]  # 20: died without d2; 11, 21: no next encounter
    assert trajectory.edge_stats(trajectory.trajectory_rows(firsts.with_next(enc), dates, edges)).first().mean_days == 399


def ser(spark, rows):
    return spark.createDataFrame(rows, "series long, item string, minute double, value double")


def test_grid_delta_and_fill_equal_recurrences(spark):
    rng = random.Random(2)
    rows = [(s, i, b * 1440 + 5.0, rng.random()) for s in range(6) for i in "ab" for b in range(8) if rng.random() < 0.4] + [(0, "a", 7 * 1440.0, 1.0)]
    grid = series.fill(series.grid_delta(series.discretise(series.with_bins(ser(spark, rows)))))
    cells = {(r.series, r.item, r.bin): r for r in grid.collect()}
    for s in {r[0] for r in rows}:
        for i in "ab":
            since, last, seen = 0, None, [cells[s, i, b] for b in range(8)]
            for b, c in enumerate(seen):
                since = 0 if c.obs else (1 if b == 0 else since + 1)
                assert abs(c.delta - since / 8) < 1e-12
                last = c.mean if c.obs else last
                assert c.filled == (last if last is not None else next((x.mean for x in seen[b:] if x.obs), 0.0))


def test_irregular_delta_equals_recurrence(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice("abc"), float(m), 1.0) for m in sorted(rng.sample(range(5000), 25))]
    got = sorted((r.item, r.minute, r.delta) for r in series.irregular_delta(series.observed_matrix(ser(spark, rows)), 3).collect())
    times = sorted({m for _, _, m, _ in rows})
    want = []
    for item in sorted({i for _, i, _, _ in rows}):
        seen, gap = {m for _, i, m, _ in rows if i == item}, 0.0
        for k, m in enumerate(times):
            gap = 0.0 if k == 0 else m - times[k - 1] + (0 if times[k - 1] in seen else gap)
            want.append((item, m, gap / (4 * 1440)))
    assert [(i, m, round(d, 9)) for i, m, d in got] == [(i, m, round(d, 9)) for i, m, d in want]


def test_single_point_series(spark):
    rows = ser(spark, [(1, "a", 800.0, 1.0)])
    assert series.anchors(rows).count() == 0
    assert series.rate_of_change(rows, 0.1).first().significant is None
    assert series.pad(series.triplets(rows), 3).first()["mask"] == [1, 0, 0]


def test_holdout_share_and_determinism(spark):
    rows = ser(spark, [(1, "a", float(m), 0.5) for m in range(14)])
    got = series.holdout(rows).collect()
    assert sum(r.held_out for r in got) == 2
    again = {(r.minute, r.held_out) for r in series.holdout(rows.repartition(7)).collect()}
    assert again == {(r.minute, r.held_out) for r in got}


def test_event_mask_rates(spark):
    rows = ser(spark, [(s, "a", float(m), float(m % 3)) for s in range(200) for m in range(10)])
    got = series.event_mask(rows, 0.001).collect()
    assert not any(r["mask"] for r in got if r.significant is None)
    share = np.mean([r["mask"] for r in got if r.significant == 1])
    assert 0.5 < share < 0.7


def test_metrics_equal_pairs_and_steps(spark):
    rng = random.Random(4)
    rows = [("g%d" % (k % 3), int(rng.random() < 0.4), round(rng.random(), 1)) for k in range(120)]
    got = {r.g: r for r in metrics.all_metrics(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    for g in got:
        own = [(y, p) for k, y, p in rows if k == g]
        pos, neg = [p for y, p in own if y], [p for y, p in own if not y]
        assert abs(got[g].auroc - np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])) < 1e-9
        points = [(1.0, 0.0)]
        for cut in sorted({p for _, p in own}, reverse=True):
            tp, fp = sum(p >= cut for p in pos), sum(p >= cut for p in neg)
            points.append((tp / (tp + fp), tp / len(pos)))
        assert abs(got[g].auprc - sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(points, points[1:]))) < 1e-9
        assert abs(got[g].minrp - max(min(p) for p in points[1:])) < 1e-9


def test_one_class_has_only_a_loss(spark):
    row = metrics.all_metrics(spark.createDataFrame([("g", 1, 0.9), ("g", 1, 0.2)], "g string, label int, score double"), ["g"]).first()
    assert row.auroc is None and row.f1 is None and row.loss > 0


def test_kfold_invariants(spark):
    rows = spark.createDataFrame([("c", e, int(e % 4 == 0)) for e in range(400)], "cohort string, entity long, label int")
    got = splits.kfold(rows).collect()
    assert splits.leaks(splits.kfold(rows), ["entity"], ["cohort", "fold"]).count() == 0
    assert Counter(r.entity for r in got if r.split == "test").most_common(1)[0][1] == 1
    assert len({r.entity for r in got if r.split == "test"}) == 400
    for fold in range(5):
        own = [r for r in got if r.fold == fold]
        sizes = Counter(r.split for r in own)
        assert sizes["test"] == 80 and abs(sizes["val"] - 64) <= 2
        assert sum(r.label for r in own if r.split == "test") == 20


def serial_search(groups, membership, size, ratios, seed):
    """Entities in random order, each to the group that is best now, until a sweep changes nothing; the objective."""
    rng, count = random.Random(seed), {s: Counter() for s in size}
    for e, g in groups.items():
        for s in membership[e]:
            count[s][g] += 1

    def deviation(s, shift=()):
        c = Counter(count[s])
        c.update(dict(shift))
        return sum(abs(r - c[g] / size[s]) for g, r in zip(splits.GROUPS, ratios))

    order, groups = list(groups), dict(groups)
    while True:
        rng.shuffle(order)
        moved = 0
        for e in order:
            here = groups[e]
            gains = {to: sum(deviation(s) - deviation(s, ((here, -1), (to, 1))) for s in membership[e]) for to in splits.GROUPS if to != here}
            to = max(gains, key=gains.get)
            if gains[to] > 1e-12:
                for s in membership[e]:
                    count[s].update({here: -1, to: 1})
                groups[e], moved = to, moved + 1
        if not moved:
            return sum(deviation(s) for s in size)


def test_exploded_windows_are_not_broadcast(spark, sf_dir):
    """A plan's sizes leave out that windows are exploded to many pieces: these have to be shuffled, not sent to the driver."""
    t = Tables(spark, sf_dir)
    after = intervals.first_event_after(t.events, t.encounters, 90, F.col("item") == 50801)
    for rows in (intervals.lookback_events(t.events, t.encounters, by_day=True), intervals.lookback_events(t.events, t.encounters), after):
        lines = rows._jdf.queryExecution().simpleString().splitlines()
        assert any("SortMergeJoin" in x and "__piece" in x for x in lines) and not any("BroadcastHashJoin" in x and "__piece" in x for x in lines)


@pytest.mark.parametrize("stratified", [False, True])
def test_optimiser_is_as_good_as_a_serial_search(spark, stratified):
    rng, ratios = random.Random(5), (0.8, 0.1, 0.1)
    rows = [("c%d" % c, e, int(rng.random() < (0.02 if c == 3 else 0.4))) for c in range(14) for e in rng.sample(range(900), 40 + 20 * c)]
    rows += [("all", e, e % 2) for e in range(900)] + rows[:5] + [(None, 1, 1), ("c1", None, 0)]
    members = spark.createDataFrame(rows, "cohort string, entity long, label int").cache()
    groups, history = splits.optimise(members, ratios, stratified=stratified)
    assert all(b < a - 1e-6 for a, b in zip(history, history[1:])) and len(history) > 1
    membership, size = {}, Counter()
    for r in splits.strata(members, ratios, stratified).collect():
        membership.setdefault(r.entity, []).append(r.stratum)
        size[r.stratum] += 1
    assert len(size) == (29 if stratified else 15)  # one cohort has too few of one class to be split
    found = {r.entity: r.split for r in groups.collect()}
    assert found.keys() == membership.keys()
    reached = sum(abs(r - sum(found[e] == g for e, own in membership.items() if s in own) / size[s]) for s in size for g, r in zip(splits.GROUPS, ratios))
    assert abs(reached - history[-1]) < 1e-6
    begin = {r.entity: r.split for r in splits.initial_groups(spark.createDataFrame([(e,) for e in membership], "entity long"), ratios).collect()}
    assert reached <= 1.05 * min(serial_search(begin, membership, size, ratios, seed) for seed in range(3)) + 0.02
    everyone = spark.range(2000).select(F.col("id").alias("entity"))
    sizes = {r.split: r["count"] for r in splits.extend_to_all(groups, everyone).groupBy("split").count().collect()}
    assert sum(sizes.values()) == 2000 and abs(sizes["train"] - 1600) <= 5


def test_moves_made_together_do_not_overshoot(spark):
    """One cohort: two passes are enough, since as many move as are needed; no members give no groups."""
    members = spark.createDataFrame([("c", e) for e in range(500)], "cohort string, entity long")
    start = splits.initial_groups(members, (0.2, 0.4, 0.4))
    before, splits.initial_groups = splits.initial_groups, lambda *_: start
    try:
        groups, history = splits.optimise(members, patience=1)
    finally:
        splits.initial_groups = before
    assert len(history) <= 3 and history[-1] < 1e-9
    assert {r.split: r["count"] for r in groups.groupBy("split").count().collect()} == {"train": 400, "val": 50, "test": 50}
    nothing, history = splits.optimise(members.limit(0), patience=1)
    assert nothing.collect() == [] and history == [0.0]


def test_optimiser_needs_few_passes(spark, monkeypatch):
    """Blocks searched together get near the end in three passes, and no row's place in a partition matters."""
    monkeypatch.setattr(splits, "BLOCK", 400, raising=False)
    rng = random.Random(8)
    members = spark.createDataFrame([("c%d" % c, e) for c in range(20) for e in rng.sample(range(4000), 1500)], "cohort string, entity long")
    groups, history = splits.optimise(members, passes=3)
    assert history[-1] < 0.25 * history[0]
    again, same = splits.optimise(members.repartition(7, F.rand(1)), passes=3)
    assert same == history and sorted(again.collect()) == sorted(groups.collect())


def test_oversample_balances(spark):
    rows = spark.createDataFrame([(k, int(k < 7)) for k in range(40)], "id long, label int")
    assert {r.label: r["count"] for r in splits.oversample(rows).groupBy("label").count().collect()} == {0: 33, 1: 33}


def test_tail_probabilities(spark):
    assert abs(float(pvalues.t_two_sided(np.array([2.0]), np.array([10.0]))[0]) - 0.07338803) < 1e-7
    assert abs(float(pvalues.t_two_sided(np.array([0.0]), np.array([3.0]))[0]) - 1) < 1e-12
    assert np.allclose(pvalues.chi2_tail(np.array([3.841459, 18.307038]), np.array([1.0, 10.0])), [0.05, 0.05], atol=1e-6)


def test_selection_reasons_and_mrmr(spark):
    rng = random.Random(6)
    rows = []
    for e in range(60):
        y = e % 2
        rows += [("c", e, 1, y + rng.random(), y), ("c", e, 2, y + rng.random(), y), ("c", e, 3, rng.random() + 0.3 * y, y), ("c", e, 4, 7.0, y)]
    rows += [("c", e, 5, rng.random(), e % 2) for e in range(4)] + [("c", e, 6, rng.random(), 0) for e in range(0, 60, 2)]
    own = spark.createDataFrame(rows, "cohort string, encounter long, item long, value double, label int")
    found = {r.item: r for r in selection.with_pvalues(selection.correlations(own)).collect()}
    assert {k: found[k].reason for k in (4, 5, 6)} == {4: "value_const", 5: "min_count", 6: "label_const"}
    assert found[1].p < 1e-6 < found[1].r
    taken = [r.item for r in selection.mrmr(own, 3).orderBy("place").collect()]
    assert taken[0] in (1, 2) and 4 not in taken and 5 not in taken


def test_bands_are_right_closed(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (10.0,), (10.5,), (None,)], "x double")
    got = [r.b for r in rows.select(scalar.band(F.col("x"), (1, 10, float("inf")), ("a", "b", "c"), lowest=0).alias("b")).collect()]
    assert got == ["a", "a", "b", "b", "c", None]
    assert spark.range(1).select(scalar.chapter(F.lit("U07")).alias("c")).first().c is None


def test_best_params_null_is_a_group(spark):
    rows = spark.createDataFrame([("a", None, 0.9, 3.0), ("a", None, 0.8, 5.0), ("a", 1, 0.7, 1.0)], "k string, depth int, auroc double, epoch double")
    best = catalog.best_params(rows, ["k"], ["depth"]).first()
    assert best.depth is None and best.epoch == 4
    assert catalog.best_params(rows, ["k"], ["depth"], largest=False).first().depth == 1


def test_readers_sinks_and_stream(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("icd_code;x\n0010;1\n0020;2\n0030;3\n")
    assert [r.code for r in readers.read_code_list(spark, str(tmp_path / "codes.csv"), first=2).collect()] == ["0010", "0020"]
    (tmp_path / "edges.tsv").write_text("D1\tD2\tRR\tCODE_DIFF_DAYS\nA00\tB01\t2.5\t10.25\n")
    assert readers.read_edges(spark, str(tmp_path / "edges.tsv"), {"d1": "D1", "d2": "D2", "rr": "RR", "diff_days": "CODE_DIFF_DAYS"}).first().diff_days == 10.25
    for name in ("train", "held_out"):
        (tmp_path / name).write_text("1\n2\n\n" if name == "train" else "3\n")
    lists = readers.read_split_lists(spark, {n: str(tmp_path / n) for n in ("train", "held_out")})
    assert {(r.split, r.entity) for r in lists.collect()} == {("train", 1), ("train", 2), ("held_out", 3)}
    rows = spark.createDataFrame([("a-b", 1, 10, 1, 0), ("a-b", 2, 20, 0, 0)], "cohort string, entity long, encounter long, label int, extra int")
    table = readers.write_cohorts(rows, str(tmp_path / "cohorts"))
    assert table.schema["cohort"].dataType.simpleString() == "string"
    assert readers.cohort_summary(table).first().percent == 50
    assert [r.cohort for r in readers.cohorts_on_disk(spark, str(tmp_path / "cohorts")).collect()] == ["a-b"]
    results = spark.createDataFrame([("c", "m", "old", 0, "0.5"), ("c", "m", "new", 0, "bad"), ("c", "m", "old", 1, "0.7")], "cohort string, model string, prefix string, fold int, auroc string")
    readers.append_results(results, str(tmp_path / "results"))
    back = readers.read_results(spark, str(tmp_path / "results"), results.schema, ["new", "old"], ["auroc"])
    assert {(r.fold, r.prefix, r.auroc) for r in back.collect()} == {(0, "new", None), (1, "old", 0.7)}
    ev = spark.createDataFrame([(1, 10, 5, day(0), 1.0), (1, 10, 6, day(0), None), (1, 10, 7, day(0), 2.0)], "entity long, encounter long, item long, ts timestamp_ntz, value double")
    ev.write.parquet(str(tmp_path / "in"))
    incremental.append_clean(incremental.follow_events(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck"), (7,)).awaitTermination()
    assert [r.item for r in spark.read.parquet(str(tmp_path / "store")).collect()] == [5]
    readers.write_event_store(ev, str(tmp_path / "clean"), (7,))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 1


@pytest.mark.parametrize("most", [0, 1000])
def test_event_store_of_some_entities(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(readers, "PUSHED_IDS", most)
    ev = spark.createDataFrame([(e, e * 10, 5, day(e), 1.0) for e in range(20)], "entity long, encounter long, item long, ts timestamp_ntz, value double")
    readers.write_event_store(ev, str(tmp_path / "store"))
    found = readers.read_event_store(spark, str(tmp_path / "store"), spark.createDataFrame([(3,), (7,), (None,), (99,)], "entity long"))
    assert sorted(r.entity for r in found.collect()) == [3, 7]
    assert readers.read_event_store(spark, str(tmp_path / "store"), spark.createDataFrame([], "entity long")).count() == 0


def test_curves_equal_plain_sums(spark):
    """Scores in one band, in many, beyond 0..1, and tied; a null group and one with a single class."""
    rng = random.Random(9)
    rows = [(g, 1 + rng.randint(-3, 3) / 1000 if g == "one" else rng.randint(-20, 120) / 100, rng.randint(0, 1)) for g in ("one", "many", None) for _ in range(300)]
    rows += [("single", rng.random(), 1) for _ in range(5)]
    frame = spark.createDataFrame(rows, "g string, score double, label int")
    areas = {r.g: r.auroc for r in metrics.auroc(frame, ["g"]).collect()}
    curves = {r.g: (r.auprc, r.minrp) for r in metrics.auprc(frame, ["g"]).collect()}
    for g in ("one", "many", None):
        pos, neg = ([s for h, s, y in rows if h == g and y == k] for k in (1, 0))
        assert abs(areas[g] - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-9
        points = [(0.0, 1.0)]
        for t in sorted({*pos, *neg}, reverse=True):
            tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
            points.append((tp / len(pos), tp / (tp + fp)))
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
        assert abs(curves[g][0] - area) < 1e-9 and abs(curves[g][1] - max(min(p) for p in points[1:])) < 1e-9
    assert areas["single"] is None and "single" not in curves


def test_protocol_branches(spark):
    rng = random.Random(8)
    rows = [(k, [float(k % 2) + rng.random(), rng.random()], k % 2, ("train", "train", "val", "test")[k // 2 % 4]) for k in range(80)]
    own = models.as_vector(spark.createDataFrame(rows, "series long, features array<double>, label int, split string"))
    turned = own.withColumn("label", F.when(F.col("split") == "val", 1 - F.col("label")).otherwise(F.col("label")))
    scores = {(grid, x is own): {r.series: r.score for r in models.fit_protocol(x, "logistic", grid)[0].collect()} for grid in (True, False) for x in (own, turned)}
    assert set(scores[True, True]) == {r[0] for r in rows if r[3] == "val"} and set(scores[False, True]) == {r[0] for r in rows if r[3] == "test"}
    assert scores[True, True] == scores[True, False]  # the grid's model has not seen the validation labels
    assert scores[False, True] != scores[False, False]


def test_registry_names(spark):
    with pytest.raises(ValueError, match="no such cohorts: \\['nothing'\\]"):
        specs.chosen(["mi", "nothing"], queries_cohorts.registered())
    assert tuple(queries_cohorts.registered()) == queries_cohorts.REGISTERED and len(specs.chosen(["all"], queries_cohorts.registered())) == 18


def test_conform(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "encounter long, entity long, other int")
    assert conform(rows, ["entity", "encounter", "label"]).columns == ["entity", "encounter"]
    with pytest.raises(ValueError):
        conform(rows.drop("entity"), ["entity"])


def test_models_learn(spark):
    rng = random.Random(7)
    rows = [(k, [float(k % 2) + rng.random() / 2, rng.random()], k % 2, "train" if k % 5 else "test") for k in range(200)]
    own = models.as_vector(spark.createDataFrame(rows, "series long, features array<double>, label int, split string"))
    for kind, params in (("random_forest", {"numTrees": 5}), ("logistic", {}), ("gbt", {"maxIter": 3}), ("mlp", {"maxIter": 50})):
        scored, _model = models.fit_score(own, kind, **params)
        assert metrics.auroc(scored.withColumn("g", F.lit(1)), ["g"]).first().auroc > 0.95
    clustered, inertia, silhouette = models.clusters(own, 2)
    assert inertia > 0 and -1 <= silhouette <= 1 and models.medoids(clustered).count() == 2


def test_whole_series_queries(spark, sf_dir):
    """All series are flattened and all anchors give inputs, more than twelve where there are more."""
    from strandline.plans import QUERIES

    rows = {name: QUERIES[name](spark, sf_dir).cache() for name in ("ts_standardise", "ts_flatten_concat_all", "ts_anchor_times", "ts_forecast_sample_all", "ts_forecast_target", "ts_forecast_target_all")}
    series = {r.series for r in rows["ts_standardise"].select("series").distinct().collect()}
    assert {r.series for r in rows["ts_flatten_concat_all"].select("series").distinct().collect()} == series
    anchors = {(r.series, r.t1) for r in rows["ts_anchor_times"].collect()}
    samples = {(r.series, r.t1): r.n for r in rows["ts_forecast_sample_all"].collect()}
    assert set(samples) == anchors and max(samples.values()) > 12
    assert set(rows["ts_forecast_target"].collect()) == set(rows["ts_forecast_target_all"].collect())
