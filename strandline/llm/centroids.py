"""Exact centroid clustering of whole-number vectors with a PCA-rotated filter (operator 11).

Vectors of exactly ``SIZE`` components become whole numbers, floor(1024 * x). One pass adds up their first and second
moments, of all rows; the principal axes of these rotate every vector. Stored beside each vector are its ``LEAD`` leading
rotated coordinates and the norm of the rest. For a vector p and a centroid c, rotation keeps distances, and the rests
differ in norm by no more than in distance, so |lead(p) - lead(c)|^2 + (rest(p) - rest(c))^2 is at most |p - c|^2. The
centroid of the least bound is measured in whole numbers; only centroids whose bound does not exceed that distance
(with room for rounding) are measured too. So assignments, ties and sums are exact whatever the axes are.

Each round is one pass over the stored table: slices add up their members by centroid, Spark adds the slices, and the
driver gets one row for a centroid and component. Centroids, which go to all tasks, are k vectors. No vectors are shuffled,
so a vector that very many rows share is no burden; the tables are written to the shared folder.

Cases: a null vector, one of another length, or with a null or non-finite component is left out, and so is one with a
component of ``LARGEST`` or more, since its squared distances leave the range of a long. Rows that repeat are rows of
their own; equal distances go to the smaller number. Starts are ordered by hash, then by vector; a null id hashes as no
hash, after the others. With fewer than k vectors there are fewer centroids, with none an empty result. An inertia beyond
a long is null. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, written

SIZE = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
LEAD = 16
#: 64 squared differences of components below this fit a long.
LARGEST = 2**27


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the kept vectors as whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x * SCALE >= -LARGEST) & (x * SCALE < LARGEST))
    return vectors.filter((F.size(v) == SIZE) & fits).select(id_col, F.transform(v, lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


@dataclass
class Axes:
    """A centre and principal axes, the longest first."""

    mean: np.ndarray
    axes: np.ndarray

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates, and the norm of the others."""
        turned = (x.astype(float) - self.mean) @ self.axes
        return turned[:, :LEAD].astype(np.float32), np.sqrt((turned[:, LEAD:] ** 2).sum(axis=1)).astype(np.float32)


def _moments(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = _matrix(batch.column(0), float)
    low = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[np.triu_indices(SIZE)]])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low)], ["at", "value"])


def principal_axes(points: DataFrame) -> Axes:
    """From the moments of all rows of (id, v); any axes would do for exactness, these prune best."""
    got = map_arrow(points.select("v"), _moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(1 + SIZE + SIZE * (SIZE + 1) // 2)
    for at, value in got:
        total[at] = value
    n = max(1.0, total[0])
    mean = total[1 : SIZE + 1] / n
    upper = np.zeros((SIZE, SIZE))
    upper[np.triu_indices(SIZE)] = total[SIZE + 1 :]
    second = (upper + np.triu(upper, 1).T) / n
    _, axes = np.linalg.eigh(second - np.outer(mean, mean))
    return Axes(mean, axes[:, ::-1])


def store(points: DataFrame, axes: Axes) -> DataFrame:
    """(id, v, lead, rest), written."""
    shared = points.sparkSession.sparkContext.broadcast(axes)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lead, rest = shared.value.split(_matrix(batch.column(1), np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1, dtype=np.int32) * LEAD), pa.array(lead.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(rest)], [*batch.schema.names, "lead", "rest"])

    schema = f"`{points.columns[0]}` {points.dtypes[0][1]}, v array<int>, lead array<float>, rest float"
    return written(map_arrow(points, fn, schema), "rotated")


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: Axes) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, and how many distances were measured."""
    c_lead, c_rest = axes.split(centroids)
    lead, rest, c_lead, c_rest = (a.astype(float) for a in (lead, rest, c_lead, c_rest))
    bound = np.stack([((lead - a) ** 2).sum(axis=1) + (rest - b) ** 2 for a, b in zip(c_lead, c_rest)], axis=1)
    # Stored coordinates are rounded to 24 bits, relative to the norms.
    room = 1e-5 * (((lead**2).sum(axis=1) + rest**2)[:, None] + (c_lead**2).sum(axis=1) + c_rest**2) + 1

    def measured(rows: np.ndarray, k: int) -> np.ndarray:
        return ((x[rows] - centroids[k]) ** 2).sum(axis=1)

    number = bound.argmin(axis=1)
    least = np.zeros(len(x), np.int64)
    for k in range(len(centroids)):
        rows = np.flatnonzero(number == k)
        least[rows] = measured(rows, k)
    open_to = bound - room <= least[:, None]
    open_to[np.arange(len(x)), number] = False
    for k in range(len(centroids)):
        rows = np.flatnonzero(open_to[:, k])
        d = measured(rows, k)
        better = (d < least[rows]) | ((d == least[rows]) & (k < number[rows]))
        least[rows[better]], number[rows[better]] = d[better], k
    return number, least, len(x) + int(open_to.sum())


def _nearest(batch: pa.RecordBatch, given: tuple[np.ndarray, Axes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, lead, rest = (batch.column(batch.schema.get_field_index(c)) for c in ("v", "lead", "rest"))
    x = _matrix(v, np.int64)
    number, least, _ = nearest(x, _matrix(lead, float), rest.to_numpy(), *given)
    return x, number, least


def moved(stored: DataFrame, centroids: np.ndarray, axes: Axes) -> np.ndarray:
    """Each centroid's members' componentwise floor of the mean; a centroid without members stays."""
    shared = stored.sparkSession.sparkContext.broadcast((centroids, axes))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, number, _ = _nearest(batch, shared.value)
        there = np.unique(number)
        sums = np.stack([x[number == k].sum(axis=0) for k in there])
        cluster, counts = np.repeat(there, SIZE), np.repeat([(number == k).sum() for k in there], SIZE)
        arrays = [pa.array(a) for a in (cluster.astype(np.int32), np.tile(np.arange(SIZE, dtype=np.int32), len(there)), counts.astype(np.int64), sums.ravel())]
        return pa.RecordBatch.from_arrays(arrays, ["cluster", "at", "n", "total"])

    sums = map_arrow(stored.select("v", "lead", "rest"), fn, "cluster int, at int, n long, total long")
    out = centroids.copy()
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    for k, at, n, total in sums.groupBy("cluster", "at").agg(F.sum("n"), exact).collect():
        out[k, at] = int(total) // n
    return out


def first_centroids(points: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit("3:"), F.col(points.columns[0]).cast("string")), 256)
    rows = points.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), SIZE)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of each kept vector."""
    points = whole_vectors(vectors, id_col, vector_col)
    kind = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}"
    spark = vectors.sparkSession
    centroids = first_centroids(points, k)
    if not len(centroids):
        return spark.createDataFrame([], f"{kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    axes = principal_axes(points)
    stored = store(points, axes)
    for _ in range(rounds):
        centroids = moved(stored, centroids, axes)
    shared = spark.sparkContext.broadcast((centroids, axes))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, number, least = _nearest(batch, shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(least)], [id_col, "cluster", "distance"])

    found = written(map_arrow(stored, fn, f"{kind}, cluster int, distance long"), "clustered")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    told = [(j, int(own), sum(int(s) for _, s in sums), centroids[j].tolist(), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, own in sums]
    told = [(j, *(s if s < 2**63 else None for s in (own, total)), c, h) for j, own, total, c, h in told]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
