"""Splits of entities into groups: folds, hold-outs, and groups balanced over many overlapping cohorts.

Which entity goes where follows from a hash of its id and a seed, never from an order of rows: the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import band, ratio
from strandline.sources.scratch import written

GROUPS = ("train", "val", "test")


def spread_rank(rows: DataFrame, by: list[str], key: Column, bucket: Column | None = None, name: str = "place") -> DataFrame:
    """Adds the rank (from 0) of a row's key in its group, without a group having to fit one task.

    Keys are dealt to ordered buckets (the leading bits of a hash); ranks in a bucket follow its offset, a sum over
    the few buckets of each group.
    """
    rows = rows.withColumn("__key", key)
    rows = rows.withColumn("__bucket", F.shiftrightunsigned("__key", 56).cast("long") if bucket is None else bucket)
    sizes = rows.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__offset", F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket")) - F.col("__n")).drop("__n")
    inner = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__key")) - 1
    ranked = rows.withColumn("__inner", inner).join(offsets, [*by, "__bucket"])
    return ranked.withColumn(name, F.col("__offset") + F.col("__inner")).drop("__key", "__bucket", "__inner", "__offset")


def hashed(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def kfold(cohorts: DataFrame, folds: int = 5, val_share: float = 0.2, seed: int = 42, key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """(cohort, entity, label, fold, split): stratified folds of entities, and in each fold a stratified validation share.

    An entity's label is the largest of its rows. Fold k tests the entities of rank k modulo the folds; of the others
    the validation share is taken by a second rank.
    """
    own = cohorts.groupBy("cohort", "entity").agg(F.max("label").alias("label"))
    ranked = spread_rank(own, ["cohort", "label"], hashed(seed, "entity") if key is None else key, bucket).withColumn("home", F.col("place") % folds)
    spread = ranked.select("cohort", "entity", "label", "place", "home", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    # Of the ranks left to a fold every so-many-th is validation: ranks are as good as random.
    every = round(1 / val_share)
    rest = F.col("place") - F.floor((F.col("place") + (folds - 1 - F.col("fold"))) / folds)
    split = F.when(F.col("home") == F.col("fold"), "test").when(rest % every == F.col("fold") % every, "val").otherwise("train")
    return spread.select("cohort", "entity", "label", "fold", split.alias("split"))


def group_holdout(rows: DataFrame, train_share: float = 0.8, seed: int = 42, key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """(entity, split): train or val, by whole entities."""
    own = rows.select("entity").distinct().withColumn("__one", F.lit(1))
    ranked = spread_rank(own, ["__one"], hashed(seed, "entity") if key is None else key, bucket)
    total = own.agg(F.count("*").alias("__all"))
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    return ranked.select("entity", F.when(F.col("place") < F.round(F.col("__all") * train_share), "train").otherwise("val").alias("split"))


def inner_folds(splits: DataFrame, folds: int = 3, seed: int = 43, key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Stratified folds of the entities that are in train or validation: (cohort, entity, label, inner)."""
    dev = splits.filter("split <> 'test'")
    return spread_rank(dev, ["cohort", "label"], hashed(seed, "entity") if key is None else key, bucket).select("cohort", "entity", "label", (F.col("place") % folds).alias("inner"))


def final(splits: DataFrame) -> DataFrame:
    """Train and validation merged."""
    return splits.withColumn("split", F.when(F.col("split").isin("train", "val"), "train").otherwise(F.col("split")))


def leaks(splits: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Keys that are in more than one split of a fold: there should be none."""
    return splits.groupBy(*within, *keys).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def counts(members: DataFrame) -> DataFrame:
    """Per cohort: size, and size, percentage and positives of each group. members: (cohort, entity, label, split)."""
    rows = members.groupBy("cohort").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 1).alias("n_pos"),
        *[x for g in GROUPS for x in (F.count_if(F.col("split") == g).alias(f"n_{g}"), F.count_if((F.col("split") == g) & (F.col("label") == 1)).alias(f"pos_{g}"))],
    )
    return rows.withColumns({f"{g}_pct": ratio(F.col(f"n_{g}") * 100, F.col("n")) for g in GROUPS} | {f"pos_rate_{g}": ratio(F.col(f"pos_{g}"), F.col(f"n_{g}")) for g in GROUPS})


def _deviation(parts: Sequence[Column], whole: Column, ratios: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for r, n in zip(ratios, parts):
        out = out + F.abs(F.lit(r) - ratio(n, whole))
    return out


def objective(summary: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), stratified: bool = True) -> DataFrame:
    """(cohort, deviation): summed absolute differences from the ratios; of both classes apart where each has enough rows."""
    enough = -(-1 // min(ratios))
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    plain = _deviation([F.col(f"n_{g}") for g in GROUPS], F.col("n"), ratios)
    both = _deviation([F.col(f"pos_{g}") for g in GROUPS], pos, ratios) + _deviation([F.col(f"n_{g}") - F.col(f"pos_{g}") for g in GROUPS], neg, ratios)
    value = F.when((pos >= enough) & (neg >= enough), both).otherwise(plain) if stratified else plain
    return summary.select("cohort", value.alias("deviation"))


def deviation_band(summary: DataFrame, target: Sequence[float] = (80, 10, 10)) -> DataFrame:
    """Adds the largest difference of a group's percentage from the target, and its band."""
    worst = F.greatest(*[F.abs(F.col(f"{g}_pct") - t) for g, t in zip(GROUPS, target)])
    return summary.withColumn("max_dev", worst).withColumn("band", band(F.col("max_dev"), (1, 2, 3, 5, 10, float("inf")), ("≤1%", "≤2%", "≤3%", "≤5%", "≤10%", ">10%"), lowest=0))


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Of two assignments (entity, split): how many entities stay, move, or are in one only."""
    joined = one.select("entity", F.col("split").alias("a")).join(two.select("entity", F.col("split").alias("b")), "entity", "full")
    return joined.groupBy(F.coalesce("a", F.lit("-")).alias("a"), F.coalesce("b", F.lit("-")).alias("b")).agg(F.count("*").alias("n"))


def initial_groups(entities: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """(entity, split) at the ratios, by rank of a hash."""
    own = entities.select("entity").distinct().withColumn("__one", F.lit(1))
    total = own.agg(F.count("*").alias("__all"))
    ranked = spread_rank(own, ["__one"], hashed(seed, "entity")).crossJoin(F.broadcast(total))  # one row
    at = (F.col("place") + 0.5) / F.col("__all")
    return ranked.select("entity", F.when(at < ratios[0], "train").when(at < ratios[0] + ratios[1], "val").otherwise("test").alias("split"))


def strata(members: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), stratified: bool = False) -> DataFrame:
    """(stratum, entity): what has to meet the ratios: cohorts, or both classes of a cohort that has enough rows of each.

    members: (cohort, entity), and label if stratified (the largest of an entity's rows).
    """
    if not stratified:
        return members.select(F.col("cohort").cast("string").alias("stratum"), "entity").filter("stratum is not null and entity is not null").distinct()
    own = members.groupBy("cohort", "entity").agg(F.max("label").alias("label")).filter("cohort is not null and entity is not null")
    enough = -(-1 // min(ratios))
    sizes = own.groupBy("cohort").agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("__least"))
    name = F.when(F.col("__least") >= enough, F.concat(F.col("cohort").cast("string"), F.lit("\0"), F.coalesce(F.col("label").cast("string"), F.lit("")))).otherwise(F.col("cohort").cast("string"))
    return own.join(sizes, "cohort").select(name.alias("stratum"), "entity")


#: Entities of a block, about: a block is searched serially, in one task.
BLOCK = 4096


def _searched(ratios: Sequence[float], sizes: np.ndarray, counts: np.ndarray, active: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (block, entity, split, strata) sorted by block: those of the entities that move, with ``to`` before the strata.

    Each block has to mend an equal share of what every stratum has too much or too little of.
    """
    share, weight = (counts - sizes[:, None] * np.array(ratios)) / active, 1 / sizes

    def search(own: list[np.ndarray], split: list[int]) -> list[int]:
        excess, now, moved = share.copy(), list(split), True
        while moved:
            moved = False
            for i, s in enumerate(own):
                at, d = now[i], excess[s]
                gain = -(weight[s] @ (np.abs(d + 1) - np.abs(d))) - weight[s] @ (np.abs(d[:, at] - 1) - np.abs(d[:, at]))
                gain[at] = 0
                to = int(gain.argmax())
                if gain[to] > 1e-12:
                    excess[s, at] -= 1
                    excess[s, to] += 1
                    now[i], moved = to, True
        return now

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in (*batches, None):
            if batch is not None:
                held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
                cuts = np.flatnonzero(np.diff(held.column("block").to_numpy())) + 1
            elif held is None:
                return
            else:
                cuts = np.array([held.num_rows])
            for lo, hi in zip((0, *cuts), cuts):
                rows = held.slice(lo, hi - lo).combine_chunks()
                split = rows.column("split").to_pylist()
                now = search([np.array(x) for x in rows.column("strata").to_pylist()], split)
                yield from rows.append_column("to", pa.array(now, pa.int32())).select(["entity", "split", "to", "strata"]).filter(pa.array(np.array(now) != split)).to_batches()
            held = held.slice(cuts[-1]) if len(cuts) else held

    return blocks


def optimise(
    members: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), passes: int = 200, patience: int = 10, tol: float = 1e-6, stratified: bool = False, seed: int = 42
) -> tuple[DataFrame, list[float]]:
    """Groups that come close to the ratios in all cohorts: (entity, split), and the objective after each pass that lowered it.

    Entities are dealt to blocks by a hash that is new in each pass. In a block, one after the other moves to the group
    that lowers the summed deviation of its strata most, until none gains. Blocks are searched together, each with an
    equal share of every stratum's excess, so by the triangle inequality moves made together never raise the objective.
    The first pass takes all blocks, each later one a quarter as many, so that what their rounding left is mended; in
    the end it is one block with the whole excess. A pass that does not lower the objective by tol is undone. It ends
    after patience undone passes of one block in a row (one, if there is only one block), or after so many passes.

    A row is an entity with the numbers of its strata; a pass shuffles the rows of its blocks only and writes those that
    move. Counts are one row a stratum, on the driver.
    """
    own = written(strata(members, ratios, stratified), "strata")
    numbered = written(own.groupBy("stratum").agg(F.count("*").alias("n")).withColumn("id", F.row_number().over(Window.orderBy("stratum")) - 1), "sizes")  # one row a stratum
    numbers = own.join(numbered.select("stratum", "id"), "stratum").groupBy("entity").agg(F.sort_array(F.collect_list("id")).alias("strata"))
    code = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("split")).cast("int") - 1
    start = written(numbers.join(initial_groups(own, ratios, seed), "entity").select("entity", code.alias("split"), "strata"), "groups")
    kind = start.schema["entity"].dataType.simpleString()

    sizes = np.array([r.n for r in numbered.orderBy("id").collect()], float)
    counts = np.zeros((len(sizes), len(GROUPS)))
    for r in start.select("split", F.explode("strata").alias("id")).groupBy("id", "split").count().collect():
        counts[r["id"], r["split"]] = r["count"]

    def value(counts: np.ndarray) -> float:
        return float(np.abs(np.array(ratios) - counts / sizes[:, None]).sum())

    whole = active = max(1, -(-start.count() // BLOCK))
    moves, history, stale = None, [value(counts)], 0
    for k in range(passes if len(sizes) else 0):
        here = start.withColumns({"h": hashed(seed + k, "entity"), "block": F.pmod(hashed(seed + k, "entity"), F.lit(whole)).cast("int")}).filter(F.col("block") < active)
        if moves is not None:
            here = here.join(moves, "entity", "left").withColumn("split", F.coalesce("now", "split"))
        dealt = here.select("block", "h", "entity", "split", "strata").repartition(active, "block").sortWithinPartitions("block", "h", "entity").drop("h")
        tried = written(dealt.mapInArrow(_searched(ratios, sizes, counts, active), f"entity {kind}, split int, to int, strata array<int>"), "moves")
        recount = counts.copy()
        for r in tried.select("split", "to", F.explode("strata").alias("id")).groupBy("id", "split", "to").count().collect():
            recount[r["id"], r["split"]] -= r["count"]
            recount[r["id"], r["to"]] += r["count"]
        if value(recount) < history[-1] - tol:
            latest = tried.select("entity", F.col("to").alias("now"))
            moves = latest if moves is None else written(moves.join(latest, "entity", "left_anti").unionByName(latest), "moved")
            counts, stale = recount, 0
            history.append(value(counts))
        elif active == 1:
            stale += 1
            if stale >= patience or whole == 1:
                break
        active = max(1, active // 4)
    split = F.col("split") if moves is None else F.coalesce("now", "split")
    groups = start if moves is None else start.join(moves, "entity", "left")
    return groups.select("entity", F.element_at(F.array(*map(F.lit, GROUPS)), split + 1).alias("split")), history


def extend_to_all(groups: DataFrame, entities: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """(entity, split) of all entities: those outside the groups fill each group up to its share of all."""
    rest = entities.select("entity").distinct().join(groups.select("entity"), "entity", "left_anti").withColumn("__one", F.lit(1))
    total = entities.select("entity").distinct().agg(F.count("*").alias("__all"))
    have = groups.agg(*[F.count_if(F.col("split") == g).alias(f"__{g}") for g in GROUPS])
    ranked = spread_rank(rest, ["__one"], hashed(seed, "entity")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(have))  # one row each
    want = [F.greatest(F.round(F.col("__all") * r) - F.col(f"__{g}"), F.lit(0)) for g, r in zip(GROUPS, ratios)]
    split = F.when(F.col("place") < want[1], "val").when(F.col("place") < want[1] + want[2], "test").otherwise("train")
    return groups.select("entity", "split").unionByName(ranked.select("entity", split.alias("split")))


def project(groups: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Groups of entities as splits of every cohort's encounters."""
    return cohorts.join(groups, "entity")


def oversample(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows of the smaller class repeated until both classes are alike: whole copies, and a hashed part of one more."""
    sizes = rows.agg(F.count_if(F.col("label") == 1).alias("__p"), F.count_if(F.col("label") == 0).alias("__n"))
    joined = spread_rank(rows, ["label"], F.xxhash64(F.lit(seed), *rows.columns)).crossJoin(F.broadcast(sizes))  # one row
    small = F.when(F.col("label") == 1, F.col("__p")).otherwise(F.col("__n"))
    large = F.greatest("__p", "__n")
    copies = F.floor(large / small) + F.when(F.col("place") < large % small, 1).otherwise(0)
    return joined.select(*rows.columns, F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def seen_in_train(rows: DataFrame, splits: DataFrame, item: str = "item", key: str = "series") -> DataFrame:
    """Rows of the items that some training series has."""
    known = rows.join(splits.filter("split = 'train'").select(key), key, "left_semi").select(item).distinct()
    return rows.join(known, item, "left_semi")


def with_data(splits: DataFrame, rows: DataFrame, key: str = "encounter") -> DataFrame:
    """Per split: how many ids have data, how many have none."""
    there = rows.select(key).distinct().withColumn("__has", F.lit(1))
    joined = splits.join(there, key, "left")
    return joined.groupBy("split").agg(F.count("__has").alias("with_data"), F.count_if(F.col("__has").isNull()).alias("missing"))
