"""Centroids against a plain loop, conversation repair against exhaustive search and one serial pass."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import centroids, repair


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted(((i, j, d, sum(e for _, e, o in found if o == j), total, centres[j]) for i, d, j in found), key=repr)


def vectors(n, seed=1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, 64))
    return [(k, (middle[k % 6] + 0.3 * r.normal(size=64)).tolist()) for k in range(n)]


def clustered(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, lead int")
    found = centroids.cluster(df, **more)
    return sorted((tuple(r)[:6] for r in found.collect()), key=repr)


def test_clusters_of_odd_vectors(spark):
    same = [0.5] * 64
    rows = vectors(90) + [(200 + k, same) for k in range(40)] + [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63)]
    rows += [(305, [math.nan] + same[1:]), (306, [math.inf] + same[1:]), (307, [1e30] + same[1:]), (308, [130000.5] + same[1:]), (None, same), (7, vectors(90)[7][1]), (309, [-0.0001] * 64)]
    assert clustered(spark, rows, k=5, rounds=4) == plain_clusters(rows, 5, 4)


def test_clusters_of_few_and_no_vectors(spark):
    rows = vectors(3)
    assert clustered(spark, rows) == plain_clusters(rows, 8, 10)
    assert clustered(spark, [(1, None), (2, [1.0])]) == []
    assert clustered(spark, []) == []
    one = [(k, [1.25] * 64) for k in range(20)]  # all ties: the smaller number
    assert {r[1] for r in clustered(spark, one)} == {0}


def test_bounds_leave_little_to_measure_and_lose_nothing(spark):
    r = np.random.default_rng(3)
    middle = 1000 * r.normal(size=(8, 3)) @ r.normal(size=(3, 64))
    x = np.floor(middle[r.integers(0, 8, 4000)] + 50 * r.normal(size=(4000, 64))).astype(np.int64)
    c = np.floor(middle).astype(np.int64)
    _, axes = np.linalg.eigh(np.cov(x.T))
    turn = centroids.Axes(x.mean(axis=0), axes[:, ::-1])
    lead, rest = turn.split(x)
    number, least, measured = centroids.nearest(x, lead, rest, c, turn)
    every = ((x[:, None, :] - c) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert measured < 1.1 * len(x)
    # Axes that fit badly prune less and change nothing.
    other = centroids.Axes(np.zeros(64), np.linalg.qr(r.normal(size=(64, 64)))[0])
    again = centroids.nearest(x, *other.split(x), c, other)
    assert (again[0] == number).all() and (again[1] == least).all() and again[2] >= measured


SHAPE = re.compile(r"(s?(ua)+)?")


def every_repair(symbols, most=2):
    """(cost, audit) of the best of all edits, with up to so many inserts at each place."""
    options = []
    for s in symbols:
        initial, fault = divmod(s, 4)
        row = [(2, "D", "")]
        if fault < 2:
            row += [(5 * fault, "K", "suax"[initial]), (5 * fault + 1, "R", "u"), (5 * fault + 1, "R", "a")]
        options.append(row)
    inserts = [(5 * n, "I" * n, "".join(p)) for n in range(most + 1) for p in itertools.product("ua", repeat=n)]
    parts = [inserts]
    for row in options:
        parts += [row, inserts]
    best = None
    for choice in itertools.product(*parts):
        if SHAPE.fullmatch("".join(c[2] for c in choice)):
            new = (sum(c[0] for c in choice), "".join(c[1] for c in choice))
            best = new if best is None or new < best else best
    return best


def test_traces_are_the_best_of_all_edits():
    random.seed(5)
    costs = repair.Backward()
    for n in (0, 1, 2, 3):
        for _ in range(40 if n < 3 else 12):
            symbols = [random.choice([0, 1, 2, 4, 4, 5, 8, 8, 9, 10, 11, 12, 13, 15]) for _ in range(n)]
            text = "".join(f"{s:x}" for s in symbols)
            start, gained, _ = costs.run(text, repair.END)
            audit, state = costs.trace(text, repair.END, repair.EMPTY, True)
            assert (gained + start[repair.EMPTY], audit) == every_repair(symbols)
            assert state in (repair.EMPTY, repair.ASSISTANT)


def test_a_rerun_stops_where_vectors_differ_by_a_constant():
    random.seed(6)
    text = "".join(random.choice("01458899ae4848") for _ in range(5000))
    costs = repair.Backward()
    first = costs.run(text, repair.END)
    for end in ((7, 0, 3, 5), (0, 5, 0, 0), (12, 12, 0, 5)):
        plain = costs.run(text, end)
        steps = []
        original = costs.vectors
        costs.vectors = lambda s, e: (steps.append(1) or v for v in original(s, e))
        start, gained, marks = costs.run(text, end, first[2], first[1])
        costs.vectors = original
        assert (start or first[0]) == plain[0] and gained == plain[1] and (marks == plain[2]).all()
        assert start is None and len(steps) <= 4 * repair.MARK


def plain_report(rows):
    """Faults, cost, audit and repaired text of each conversation in one serial pass."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, symbols, faults = set(), "", [0] * 4
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1
            if bare:
                seen.add((role, text))
            faults[fault] += 1
            symbols += f"{4 * ('sua'.find(role[:1]) if role[:1] and role[0] in 'sua' else 3) + fault:x}"
        costs = repair.Backward()
        start, gained, _ = costs.run(symbols, repair.END)
        audit, _ = costs.trace(symbols, repair.END, repair.EMPTY, True)
        told, last, k = [], "", 0
        for letter in audit:
            if letter in "IR":
                last = "a" if last == "u" else "u"
                told.append(("assistant:" if last == "a" else "user:") + (mine[k][2] if letter == "R" else ""))
            elif letter == "K":
                last = mine[k][1][0]
                told.append(f"{mine[k][1]}:{mine[k][2]}")
            k += letter != "I"
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(a[1][:1], b[1][:1]) for a, b in zip(mine, mine[1:])]
        illegal = sum("".join(p) not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, faults[2], faults[3], faults[1], illegal, gained + start[0], audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def conversation(rng, conv, n):
    texts = ["Yes.", "No!", "", " \t\n", "cut off", "Why?  \n", "a b c.", None]
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(n * n)}.") for _ in range(n)]


@pytest.mark.parametrize("chunk_bits", [2, 14])
def test_reports_of_odd_conversations(spark, chunk_bits):
    rng = random.Random(chunk_bits)
    rows = [r for conv, n in ((1, 400), (2, 1), (3, 5), (None, 60), (4, 37)) for r in conversation(rng, conv, n)]
    rows += [(6, 1, "user", "word. " * 50_000), (6, 2, "assistant", "Ends " + "." + " " * 30_000), (7, 1, "user", None)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, place int, audit string").repartition(3)
    named = df.select("conv_id").union(spark.createDataFrame([(99,)], "conv_id long"))
    found = {r[0]: tuple(r)[1:] for r in repair.report(df, named, chunk_bits).collect()}
    assert found.pop(99) == (0, 0, 0, 0, 0, 0, "", repair.NOTHING)
    assert found == plain_report(rows)


def test_long_conversation_over_many_chunks(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant"]), f"text {k}" + rng.choice([".", ".", ""])) for k in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = repair.placed(df, 9)
    vectors, passes = repair.stitched(repair.chunked(placed))
    assert vectors.count() > 10 and 1 <= passes <= 3
    audits = repair.audited(placed)
    whole = plain_report(rows)[1]
    told = "".join(r.audit for r in audits.orderBy("chunk").collect())
    assert told == whole[6] and audits.agg(F.sum("paid")).first()[0] == whole[5]
    mended = repair.repaired(placed, audits).orderBy("place", "step").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mended).encode()).hexdigest() == whole[7]
    assert SHAPE.fullmatch("".join(r.role[0] for r in mended))


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (None, 0, 1)] + [(None, 1, None, None)]
    found = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        want += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(repair.damaged(empty), empty).collect() == []
