"""Ranks, quantiles and curves of groups by bands: wherever the values lie, and however many are equal."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import bands, metrics, selection
from strandline.sources import fixtures

SHAPES = {
    "rare": lambda r: r.random() * 1e-3,
    "logits": lambda r: r.gauss(0, 8),
    "equal": lambda r: 0.25,
    "few": lambda r: float(r.randrange(3)),
    "narrow": lambda r: 0.5 + r.random() * 1e-9,
    None: lambda r: r.expovariate(1),
}


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(4)
    rows = [(g, shape(r), int(r.random() < 0.3)) for g, shape in SHAPES.items() for _ in range(1500)]
    rows += [("rare", None, 1), ("rare", math.nan, 1), ("logits", math.inf, 0), ("logits", -math.inf, 1), ("alone", 2.0, 1), ("nothing", None, 0)]
    return rows, spark.createDataFrame(rows, "g string, score double, label int").repartition(4).cache()


def of(rows, g):
    return [(v, y) for own, v, y in rows if own == g and v is not None and not math.isnan(v)]


def test_bands_hold_alike(values):
    rows, df = values
    sizes = bands.banded(bands.counted(df, "score", ["g"]), "score", ["g"]).groupBy("g", "__band").count().collect()
    for g in ("rare", "logits", "narrow", None):
        own = [r["count"] for r in sizes if r.g == g]
        assert len(own) > 50 and max(own) <= 4 * 1500 / bands.BANDS


def test_ranks(values):
    rows, df = values
    found = {(r.g, r.score): (r.n, r["rank"]) for r in bands.ranks(bands.counted(df, "score", ["g"]), "score", ["g"]).collect()}
    for g in (*SHAPES, "alone"):
        own = sorted(v for v, _ in of(rows, g))
        first = {}
        for k, v in enumerate(own):
            first.setdefault(v, k)
        for v, k in first.items():
            n = own.count(v) if g in ("equal", "few") else 1
            assert found[g, v] == (n, k + (n + 1) / 2)
    ranked = selection.average_ranks(df, "score", ["g"], "r")
    assert ranked.count() == len(rows) and ranked.filter("score is null or isnan(score)").filter("r is not null").count() == 0
    assert bands.ranks(bands.counted(df.limit(0), "score", ["g"]), "score", ["g"]).collect() == []


def test_quantiles(values):
    rows, df = values
    shares = [0.0, 0.25, 0.5, 0.901, 1.0]
    found = {r.g: [r[f"q{k}"] for k in range(len(shares))] for r in bands.quantiles(df, "score", ["g"], shares).collect()}
    assert found.keys() == {*SHAPES, "alone"}
    for g in found:
        own = [v for v, _ in of(rows, g)]
        want = np.quantile([v for v in own if not math.isinf(v)], shares) if g != "logits" else None
        if want is None:
            own.sort()
            want = [own[0], *[own[math.floor(q * (len(own) - 1))] + (own[math.ceil(q * (len(own) - 1))] - own[math.floor(q * (len(own) - 1))]) * (q * (len(own) - 1) % 1) for q in shares[1:-1]], own[-1]]
        assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(found[g][1:-1], want[1:-1]))
    whole = bands.quantiles(df.filter("abs(score) < 1e300"), "score", [], [0.5]).collect()
    assert abs(whole[0].q0 - np.median([v for g in SHAPES for v, _ in of(rows, g) if abs(v) < 1e300] + [2.0])) < 1e-12


def test_curves(values):
    rows, df = values
    found = {r.g: r for r in metrics.all_metrics(df, ["g"]).collect()}
    assert found.keys() == {r[0] for r in rows}
    assert found["alone"].auroc is None and found["nothing"].auprc is None
    for g in SHAPES:
        pos, neg = ([v for v, y in of(rows, g) if y == want] for want in (1, 0))
        won = np.sum(np.array(pos)[:, None] > np.array(neg)) + np.sum(np.array(pos)[:, None] == np.array(neg)) / 2
        assert abs(found[g].auroc - won / (len(pos) * len(neg))) < 1e-9
        area, best, p0, r0, tp, fp = 0.0, 0.0, 1.0, 0.0, 0, 0
        for v in sorted({v for v, _ in of(rows, g)}, reverse=True):
            tp, fp = tp + pos.count(v), fp + neg.count(v)
            p, r = tp / (tp + fp), tp / len(pos)
            area, best, p0, r0 = area + (r - r0) * (p + p0) / 2, max(best, min(p, r)), p, r
        assert abs(found[g].auprc - area) < 1e-9 and abs(found[g].minrp - best) < 1e-12
    single = {r.g: r for r in metrics.auroc(df, ["g"]).join(metrics.auprc(df, ["g"]), "g").collect()}
    assert all(abs(single[g].auroc - found[g].auroc) < 1e-12 and abs(single[g].auprc - found[g].auprc) < 1e-12 for g in ("rare", "logits", "few"))
    assert metrics.pr_curve(df.filter(F.col("g") == "equal"), ["g"]).count() == 1


def test_no_window_holds_a_group_of_an_entropy(spark):
    """The bounds of a histogram are no window over its whole group; null groups and constant values have their rows."""
    rows = [("c", y, i, float(v), e) for e, (y, i, v) in enumerate([(0, 1, 0), (0, 1, 10), (0, 1, 10), (1, 1, 3), (1, 1, 3), (None, 2, 1), (None, 2, 2)])]
    means = spark.createDataFrame(rows, "cohort string, label int, item int, value double, encounter long")
    h = selection.entropy(means, ["cohort", "label"])
    assert "Window" not in h._jdf.queryExecution().simpleString()
    x = {(r.label, r.item): r.h for r in h.collect()}
    want = {(0, 1): [2, 1], (1, 1): [2], (None, 2): [1, 1]}
    for key, counts in want.items():
        total = sum(counts) + 10
        assert abs(x.pop(key) - (math.log(total) - sum((c + 1) * math.log(c + 1) for c in counts) / total)) < 1e-12
    assert not x


@pytest.mark.parametrize("name", ["events", "codes", "procedures"])
def test_lines_are_dealt_over_tasks_by_their_number(spark, sf_dir, monkeypatch, name):
    """The session's number of partitions does not bound how many lines a task sorts and aggregates."""
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 100, raising=False)
    t = fixtures.Tables(spark, sf_dir)
    lines = t.raw("lineitem").count()
    assert getattr(t, name).rdd.getNumPartitions() == -(-lines // 100) > 4
