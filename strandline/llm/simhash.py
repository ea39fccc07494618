"""SimHash near-duplicates with pivot distance tables (operator 10).

A text's fingerprint is the bitwise majority of the XXH64 hashes of its three-word shingles. Two fingerprints link
when they differ in ``RADIUS`` bits at most; documents with linked fingerprints form components.

The Hamming distance is a metric, so fingerprints within the radius have distances to any third fingerprint that
differ by no more than the radius. A table of distances to many reference fingerprints (pivots) therefore discards
most pairs before they are compared. The pairs that meet at all come from groups that agree on half of the
fingerprint's blocks: of six blocks, three differing bits leave three untouched, so each linked pair shares at least
one of the twenty choices of three blocks. In a group the rows are sorted by their distance to the first pivot, and
only rows whose first distances are within the radius meet; the other columns of the table discard, and an exact
comparison verifies.

Equal fingerprints are one node, however many documents have them. A group above ``CHUNK`` fingerprints is dealt again by
the same rule: the 32 bits that its members need not share are cut into six blocks, of which three are untouched. So a
hot group costs twenty rows for each of its rows, whatever its size, and its parts agree on all but 16 bits or so. Parts
that are still above ``CHUNK`` are dealt by the pivot table: to cells of ``BAND`` distances to the first ``CELL_PIVOTS``
pivots, a row to its own band and the next of each, so that all pairs within the radius meet, and others do only if
their distances are near. From each group only the stars of its own components are emitted, never all its pairs.

Cases: null and empty texts have no words and fingerprint zero, which links like any other. Ties in the majority
give a zero bit. Repeated rows give repeated result rows. A null id is never the smallest of a component that has
other ids. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, written
from strandline.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
PIVOTS = 16
CHUNK = 2048
#: Rows of whole groups that a task compares at a time.
ROWS_AT_ONCE = 200_000


#: Bands are wider than the radius; so many pivots make cells.
BAND, CELL_PIVOTS = 4, 2


def _choices(bits: list[int]) -> list[int]:
    """Masks of the halves of some bits that RADIUS differing ones can leave untouched: RADIUS of twice as many blocks."""
    parts = 2 * RADIUS
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    blocks = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, RADIUS)]


MASKS = np.array(_choices(list(range(64))), np.uint64)
#: For each mask those of the bits outside it, for groups that are dealt again.
AGAIN = np.array([_choices([b for b in range(64) if not int(m) >> b & 1]) for m in MASKS], np.uint64)
PIVOT_FINGERPRINTS = np.random.default_rng(7).integers(0, 2**64, PIVOTS, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a text; only A-Z are lower-cased and only ASCII white space separates words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-size] + 1).tolist()]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())]
    return majority(np.array(hashes, "<u8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], [id_col, "fp"])

    return map_arrow(rows, fn, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row for each of n rows, given pairs of rows."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, hop := root[root]):
            root = hop
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


GROUP = ["mask", "part", "again", "subpart", "cell"]


def _linked_rows(group: np.ndarray, mask: np.ndarray, again: np.ndarray, own: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that link, for rows sorted by group and by distance to the first pivot.

    A pair is taken in the first mask it agrees on only, and of the cells where it meets in the last: there, for each
    pivot, one of the two rows is in its own band (a bit of own).
    """
    distances = np.bitwise_count(fps[:, None] ^ PIVOT_FINGERPRINTS[None, :]).astype(np.int8)
    first = distances[:, 0]
    left, right = [], []
    at = np.arange(len(fps))
    step = 1
    while len(at):
        at = at[at + step < len(fps)]
        other = at + step
        near = (group[at] == group[other]) & (first[other] - first[at] <= RADIUS)
        at, other = at[near], other[near]  # sorted: once a row is past its group or the radius, it stays so
        keep = (own[at] | own[other]) == (1 << CELL_PIVOTS) - 1
        i, j = at[keep], other[keep]
        for p in range(1, PIVOTS):
            keep = np.abs(distances[i, p] - distances[j, p]) <= RADIUS
            i, j = i[keep], j[keep]
        differ = fps[i] ^ fps[j]
        keep = np.bitwise_count(differ) <= RADIUS
        i, j, differ = i[keep], j[keep], differ[keep]
        if len(i):
            keep = np.argmax((differ[:, None] & MASKS[None, :]) == 0, axis=1) == mask[i]
            keep &= (again[i] < 0) | (np.argmax((differ[:, None] & AGAIN[mask[i]]) == 0, axis=1) == again[i])
            left.append(i[keep])
            right.append(j[keep])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _stars_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (GROUP..., own, fp) sorted by group: links (a, b) from rows to their group's roots."""

    def stars(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows.column(k).to_numpy() for k in GROUP]
        fps = rows.column("fp").to_numpy().view(np.uint64)
        new = np.ones(len(fps), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        group = np.cumsum(new)
        order = np.lexsort((np.bitwise_count(fps ^ PIVOT_FINGERPRINTS[0]), group))
        group, fps = group[order], fps[order]
        a, b = _linked_rows(group, keys[0][order], keys[2][order], rows.column("own").to_numpy()[order], fps)
        root = _roots(len(fps), a, b)
        hung = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[hung].view(np.int64)), pa.array(fps[root[hung]].view(np.int64))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < ROWS_AT_ONCE:
            continue
        rows = pa.Table.from_batches(held)
        keys = [rows.column(k).to_numpy() for k in GROUP]
        last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        if len(last):  # the last group may go on in the next batch
            yield stars(rows.slice(0, last[-1] + 1))
            held = rows.slice(last[-1] + 1).to_batches()
            count = sum(x.num_rows for x in held)
    if count:
        yield stars(pa.Table.from_batches(held))


def dealt(prints: DataFrame) -> DataFrame:
    """(GROUP..., own, fp): every fingerprint of a table of distinct ``fp`` once for each group it belongs to."""
    masks = F.array(*[F.lit(int(m)) for m in MASKS.view(np.int64)])
    keyed = prints.select("fp", F.posexplode(masks).alias("mask", "bits")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("part"))
    sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("size")).filter("size > 1")
    grouped = keyed.join(sizes, ["mask", "part"])
    every = (1 << CELL_PIVOTS) - 1
    small = grouped.filter(F.col("size") <= CHUNK).select("mask", "part", F.lit(-1).alias("again"), F.lit(0).cast("long").alias("subpart"), F.lit(0).alias("cell"), F.lit(every).alias("own"), "fp")
    # Hot groups again, by the bits outside their mask.
    inner = F.array(*[F.array(*[F.lit(int(m)) for m in row]) for row in AGAIN.view(np.int64)])
    hot = grouped.filter(F.col("size") > CHUNK).select("fp", "mask", "part", F.posexplode(F.element_at(inner, F.col("mask") + 1)).alias("again", "bits"))
    hot = hot.select("fp", "mask", "part", "again", F.col("fp").bitwiseAND(F.col("bits")).alias("subpart"))
    subkey = ["mask", "part", "again", "subpart"]
    counted = hot.join(hot.groupBy(*subkey).agg(F.count("*").alias("size")).filter("size > 1"), subkey)
    # Of parts that are still hot, cells of bands of pivot distances: a row is in its own band and the next of each pivot.
    bands = [F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))) / BAND).cast("int") for p in PIVOT_FINGERPRINTS.view(np.int64)[:CELL_PIVOTS]]
    cells = []
    for steps in product((0, 1), repeat=CELL_PIVOTS):
        cell, own = F.lit(0), 0
        for p, (band, step) in enumerate(zip(bands, steps)):
            cell, own = cell * 100 + band + step + 1, own | (1 - step) << p
        cells.append(F.struct(cell.alias("cell"), F.lit(own).alias("own")))
    whole = F.array(F.struct(F.lit(0).alias("cell"), F.lit(every).alias("own")))
    parts = counted.select("fp", *subkey, F.explode(F.when(F.col("size") <= CHUNK, whole).otherwise(F.array(*cells))).alias("x"))
    return small.unionByName(parts.select(*subkey, "x.cell", "x.own", "fp"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of a table of distinct ``fp`` that connect what the radius connects."""
    rows = dealt(prints).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return rows.mapInArrow(_stars_of_groups, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs; component_id is the smallest id of its component."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    of_node = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    component = of_node.join(least, "root").select("fp", "component_id")
    return prints.join(component, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, one of each component of near copies (module ``near``: five words, 0.8): the one with the smallest id. Rows with a null id stay: they cannot be named.

    Rows that repeat an id are one document; one of them stays.
    """
    from strandline.llm import near  # which takes fingerprints and links from this module

    first = written(near.least_ids(docs, id_col, text_col), "survivors")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))
    name = "__place"
    while name in docs.columns:
        name += "_"
    one = docs.filter(F.col(id_col).isNotNull()).withColumn(name, place).filter(F.col(name) == 1).drop(name)
    # The texts are shuffled once, by id; both the window and the join work on that.
    kept = one.join(first, id_col, "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
