"""Ball k-means over integer vectors: exact assignment, with few comparisons.

A cluster is a ball: its centroid, and the members of a home cluster within a radius of it. A member may be as near to
another centroid only if its squared distance to its own is at least a quarter of the squared distance between the two. So
the neighbours of a ball are the centroids within twice its radius; members nearer than half-way to the nearest neighbour
are its stable core and are compared with nothing; those in the annulus between half-way to the m-th and to the next
neighbour are compared with m centroids only. All of it is integer arithmetic, so ties are exact: the smaller number wins.

A round is one pass over the vectors, in which each task compares its members with the centroids and gives their sums, and a
sum over tasks by cluster and component; centroids (k times the dimensions) go to the tasks and come back from them.
Homes are the assignment at the start and are written anew each REFRESH rounds; any home gives the same result, a near one
fewer comparisons. Vectors and homes are kept in the shared folder, so a lost executor costs its tasks only.

Defined cases: vectors that are null, of other dimensions, or hold a null or a component that is not finite are left out;
a component beyond vectors.MOST in its integer form is an error; of rows with the same id or without one each counts, rows
without an id being the last to start a cluster; of fewer vectors than k each starts a cluster, equal ones included, of which
the higher numbers stay empty; an empty cluster keeps its centroid; an empty table gives no rows; further columns, whatever
their names, are kept, and new ones have underscores put in front of their names while the input has one of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quorum.llm.common import removed, stored, unused
from quorum.llm.vectors import finite, integers

K, ROUNDS, DIMENSIONS, FACTOR, SEED = 8, 10, 64, 1_024, "3"
#: Homes are written anew after so many rounds.
REFRESH = 5
#: Vectors that are compared at a time.
CHUNK = 4_096


class Balls:
    """Centroids, numbered from 0, as integer rows."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        apart = ((self.centroids[:, None] - self.centroids[None]) ** 2).sum(axis=2)
        self.quarter = -(-apart // 4)  # from this squared distance to its own centroid on, a member may be as near to the other
        self.nearest = np.argsort(apart, axis=1, kind="stable")

    def assign(self, vectors: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance to its centroid) of each vector, and how many comparisons beyond the own one that took."""
        own = ((vectors - self.centroids[home]) ** 2).sum(axis=1)
        cluster, distance, compared = home.copy(), own.copy(), 0
        for i in np.unique(home).tolist():
            members = np.flatnonzero(home == i)
            for j in self.nearest[i].tolist():
                if j == i:
                    continue
                members = members[own[members] >= self.quarter[i, j]]  # beyond half-way to j; farther neighbours need fewer still
                if not len(members):
                    break
                other = ((vectors[members] - self.centroids[j]) ** 2).sum(axis=1)
                compared += len(members)
                wins = (other < distance[members]) | ((other == distance[members]) & (j < cluster[members]))
                cluster[members[wins]], distance[members[wins]] = j, other[wins]
        return cluster, distance, compared


def _chunks(batches: Iterator[pa.RecordBatch], components: str, home: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, part.column(components).flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1), part.column(home).to_numpy().astype(np.int64)


def _assigned(rows: DataFrame, centroids: np.ndarray, components: str, home: str, distance: str) -> DataFrame:
    """The rows with the cluster as their home, and the squared distance."""
    shared = rows.sparkSession.sparkContext.broadcast(Balls(centroids))  # k times the dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors, homes in _chunks(batches, components, home):
            cluster, far, _ = shared.value.assign(vectors, homes)
            names = [n for n in part.schema.names if n not in (home, distance)]
            yield pa.record_batch([*(part.column(n) for n in names), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], [*names, home, distance])

    kept = [f for f in rows.schema.fields if f.name not in (home, distance)]
    return rows.mapInArrow(run, StructType(kept).add(home, IntegerType()).add(distance, LongType()))


def _moved(rows: DataFrame, centroids: np.ndarray, components: str, home: str) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their members, or as before where there are none."""
    shared = rows.sparkSession.sparkContext.broadcast(Balls(centroids))
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dimensions + 1), np.int64)  # the last column counts
        for _, vectors, homes in _chunks(batches, components, home):
            cluster, _, _ = shared.value.assign(vectors, homes)
            for i in np.unique(cluster).tolist():
                mine = vectors[cluster == i]
                sums[i, :-1] += mine.sum(axis=0)
                sums[i, -1] += len(mine)
        i, at = np.nonzero(sums)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[i, at], pa.int64())], ["cluster", "place", "total"])

    totals = np.zeros((k, dimensions + 1), np.int64)
    parts = rows.select(components, home).mapInArrow(run, "cluster int, place int, total long")
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # k times the dimensions and one
        totals[r["cluster"], r["place"]] = r["total"]
    counts = totals[:, -1:]
    return np.where(counts > 0, totals[:, :-1] // np.maximum(counts, 1), centroids)


def first_centroids(rows: DataFrame, key: Column, components: str, k: int = K) -> np.ndarray:
    """The k vectors whose key is least, nulls last, as the centroids to start from."""
    found = rows.orderBy(key.asc_nulls_last(), components).limit(k).select(components).collect()  # k rows
    return np.array([r[0] for r in found], np.int64)


def ball_kmeans(embeddings: DataFrame, rounds: int = ROUNDS, k: int = K, dimensions: int = DIMENSIONS, factor: int = FACTOR, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(the kept rows, all columns, with ``cluster`` and ``distance``; the final centroids)."""
    spark = embeddings.sparkSession
    cluster, distance = unused(embeddings, "cluster"), unused(embeddings, "distance")
    components = unused(embeddings, "components")
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.where(finite(vector) & (F.size("embedding") == dimensions)).withColumn(components, integers(vector, factor))
    rows, first = stored(rows.withColumns({cluster: F.lit(0), distance: F.lit(0).cast("long")}))
    centroids = first_centroids(rows, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), components, k)
    if not len(centroids):
        return rows.drop(components), centroids
    work, path = rows, first
    for r in range(rounds):
        if r % REFRESH == 0:
            work, new = stored(_assigned(work, centroids, components, cluster, distance))
            removed(spark, path)
            path = new
        centroids = _moved(work, centroids, components, cluster)
    return _assigned(work, centroids, components, cluster, distance).drop(components), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """The rows with the sums of distances over their cluster and over all, and the digest of their centroid."""
    sums = {r[0]: r[1] for r in assigned.groupBy(cluster).agg(F.sum(distance)).collect()}  # a row a cluster
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of = [(i, total, sum(sums.values()), digest(centroids[i])) for i, total in sorted(sums.items())]
    known = assigned.sparkSession.createDataFrame(of, f"{cluster} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), cluster)  # at most k rows
