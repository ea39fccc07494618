"""Components of documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more (the pipeline's near-dedup).

Documents first meet by SimHash: fingerprints of the five-word sets, linked by operator 10's pivot tables within its three
bits. That is far too tight for a similarity of 0.8 alone, where fingerprints differ in about ten bits, and a radius wide
enough has no selective index. So those that differ in more bits meet by min-hashes too: ``BANDS`` groups of ``BAND_ROWS``
minima each. A pair at exactly 0.8 shares no band with a probability of (1 - 0.8 ** 4) ** 40 = 7e-10, and more alike ones
with less. Documents that meet either way form *candidate components*; each document's text goes to its own one, where the
exact shingle sets are compared and only links of 0.8 or more stay.

Equal shingle sets are one node, however many documents have them. Candidate components above ``CHUNK`` nodes or
``SHINGLES_AT_ONCE`` shingles are dealt by hash to chunks, and pairs of chunks are handled apart. From each group only
stars of its own components are emitted, never all its pairs.

Only texts of candidates are shuffled: a bit filter of their rows (at most 32 MB, whatever their number; beyond some
20 million candidates it lets more and more other texts through, which the join then drops) is broadcast before.

Cases: only A-Z are lower-cased and only ASCII white space separates words; texts under five words are one shingle; null
and empty texts are one node that links to no other. A null id is never the smallest of a component that has other ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.common import keep_rows, map_arrow, written
from strandline.llm.components import components
from strandline.llm.decontam import bit_filter, known_to

WORDS = 5
SEED = 42
#: The least similarity is NUM / DEN; whole numbers keep the comparison exact.
NUM, DEN = 4, 5
BANDS, BAND_ROWS = 40, 4
CHUNK = 2048
SHINGLES_AT_ONCE = 1_000_000
_DRAWN = np.random.default_rng(11).integers(0, 2**32, (2, BANDS * BAND_ROWS), np.uint32)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint32(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-WORDS] + 1).tolist()]
    return np.array(sorted({digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist())}), np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of a set's min-hashes."""
    low = hashes.astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, ((low[at : at + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    m = least.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = (out ^ m[:, k]) * _MIX[0]
        out = (out ^ (out >> np.uint64(29))) * _MIX[1]
    return out ^ (out >> np.uint64(32))


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of one set of its component; sets link at a similarity of NUM / DEN or more.

    Each set is compared with those that no component has yet, so a group of near copies costs little more than one pass.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(max(c.max() for c in codes)) + 1, np.int8)
    root = np.full(len(sets), -1)
    live = np.argsort(sizes, kind="stable")
    flat, size, start = np.zeros(0, np.int64), sizes[live], np.zeros(0, np.int64)
    fresh = False
    for seed in live.tolist():
        if root[seed] >= 0:
            continue
        root[seed] = seed
        todo = [seed]
        while todo:
            i = todo.pop()
            if not fresh or 2 * np.count_nonzero(root[live] < 0) < len(live):
                live = live[root[live] < 0]
                if not len(live):
                    todo.clear()
                    break
                size = sizes[live]
                flat = np.concatenate([codes[k] for k in live])
                start = np.concatenate([[0], np.cumsum(size)])
                fresh = True
            lo = np.searchsorted(size, -(-NUM * sizes[i] // DEN), "left")
            hi = np.searchsorted(size, DEN * sizes[i] // NUM, "right")
            if lo == hi:
                continue
            mark[codes[i]] = 1
            shared = np.add.reduceat(mark[flat[start[lo] : start[hi]]], start[lo:hi] - start[lo], dtype=np.int64)
            mark[codes[i]] = 0
            near = live[lo:hi][(NUM + DEN) * shared >= NUM * (sizes[i] + size[lo:hi])]
            near = near[root[near] < 0]
            root[near] = seed
            todo += near.tolist()
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (root, low, high, key, text) sorted by the first three: links (a, b) within each group."""

    def stars(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        at = linked(sets)
        hung = [(keys[k], keys[r]) for k, r in enumerate(at.tolist()) if k != r]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in hung], pa.int64()), pa.array([b for _, b in hung], pa.int64())], ["a", "b"])

    now, keys, sets = None, [], []
    for batch in batches:
        for *group, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if group != now:
                if len(keys) > 1:
                    yield stars(keys, sets)
                now, keys, sets = group, [], []
            keys.append(key)
            sets.append(shingles(text))
    if len(keys) > 1:
        yield stars(keys, sets)


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row, key, size, fp, bands): key names the shingle set, fp is its fingerprint; bands are none for an empty set."""
    rows = docs.select(id_col, F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("row"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
        found = [bands(s).view(np.int64) for s in sets if len(s)]
        ends = np.cumsum(np.where(sizes > 0, BANDS, 0)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.array(sizes), pa.array(fps), lists], [id_col, "__text", "row", "key", "size", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows, fn, f"`{id_col}` {kind}, __text string, row long, key long, size long, fp long, bands array<long>")


def met_by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): keys of nodes (key, size, fp) that meet by fingerprints within operator 10's radius: the least of each with its links'."""
    own = nodes.filter("size > 0").select("key", "fp")
    least = written(own.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    equal = own.join(least, "fp").filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    found = simhash.links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab"]
    return equal.unionByName(found.join(ends[0], "a").join(ends[1], "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def _texts(prints: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, text) of all members, and of the few other rows that their bit filter lets through."""
    bits = prints.sparkSession.sparkContext.broadcast(bit_filter(members.select(F.xxhash64("rep"))))

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, bool)
        out[known_to(batch.column(0).to_numpy().view(np.uint64), bits.value)] = True
        return out

    return keep_rows(prints.select(F.xxhash64("row").alias("hash"), F.col("row").alias("rep"), "__text"), mask).drop("hash")


def links(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between keys that connect what the similarity connects."""
    keyed = nodes.select("key", F.explode("bands").alias("band"))
    met = keyed.select("key", F.first("key").over(Window.partitionBy("band").orderBy("key")).alias("least")).filter("key <> least")
    groups = components(met_by_fingerprint(nodes).unionByName(met.select(F.col("key").alias("a"), F.col("least").alias("b"))))
    members = written(nodes.join(groups, nodes.key == groups.node).select("key", "rep", "size", "root"), "members")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / SHINGLES_AT_ONCE)).cast("int")
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("own")))
    dealt = (
        members.join(members.groupBy("root").agg(chunks.alias("chunks")), "root")
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        .join(_texts(prints, members), "rep")
        .withColumn("with", F.explode(other))
        .select("root", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "key", "__text")
    )
    keys = ["root", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_stars, "a long, b long")


def least_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id): the smallest id of each component."""
    prints = written(_prints(docs, id_col, text_col), "shingles")
    nodes = written(prints.groupBy("key").agg(F.min(id_col).alias("least"), F.min("row").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    roots = components(links(prints, nodes))
    of_node = nodes.join(roots, nodes.key == roots.node, "left").select(F.coalesce("root", "key").alias("root"), "least")
    return of_node.groupBy("root").agg(F.min("least").alias(id_col)).filter(F.col(id_col).isNotNull()).select(id_col).distinct()
