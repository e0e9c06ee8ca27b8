"""Clusters around centroids, nearest ones found by equal-average equal-variance search.

Vectors are integers, so all sums and distances are exact. The centroids are sorted by the mean of
their components. A vector looks at them outward from its own mean: a squared distance is never less than
width * (difference of means)^2, so when the next centroid's mean is too far, so are all beyond it on that side;
nor less than that plus (difference of deviations)^2, which rejects single ones. Distances of
what is left are summed in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored

WIDTH = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
LIMIT = 1 << 27            # integers are held within this, so that a squared distance of 64 of them fits a long
_SLACK = 1e-9              # bounds are taken lower by this part, which rounding stays far below

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _integers(width: int, scale: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            right = np.flatnonzero(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width)
            rows = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)   # null components are NaN
            good = np.isfinite(rows).all(axis=1)
            whole = np.clip(np.floor(rows[good] * scale), -LIMIT, LIMIT).astype("<i4")
            cells = pa.array([r.tobytes() for r in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(right[good])), cells], names=["id", "v"])
    return run


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the components, and the length of what is left without it."""
    mean = x.sum(axis=1) / x.shape[1]
    rest = x - mean[:, None]
    return mean, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of `x` the number of its nearest centroid, the smallest of those that tie, and the squared
    distance; and how many distances were computed."""
    k, width = centroids.shape
    mean, dev = _moments(x)
    c_mean, c_dev = _moments(centroids)
    order = np.argsort(c_mean, kind="stable")
    c_mean, c_dev = c_mean[order], c_dev[order]
    up = np.searchsorted(c_mean, mean)
    down = up - 1
    who, best = np.full(len(x), k), np.full(len(x), np.iinfo(np.int64).max)
    looking, measured = np.arange(len(x)), 0
    while len(looking):
        m, u, d = mean[looking], up[looking], down[looking]
        above = np.where(u < k, c_mean[np.minimum(u, k - 1)] - m, np.inf)
        below = np.where(d >= 0, m - c_mean[np.maximum(d, 0)], np.inf)
        gap, at = np.minimum(above, below), np.where(above < below, u, d)
        near = width * gap * gap * (1 - _SLACK) <= best[looking]       # false too when no centroid is left
        looking, gap, at, rises = looking[near], gap[near], at[near], (above < below)[near]
        up[looking[rises]] += 1
        down[looking[~rises]] -= 1
        apart = np.maximum(np.abs(dev[looking] - c_dev[at]) - _SLACK * (dev[looking] + c_dev[at]), 0)
        test = (width * gap * gap + apart * apart) * (1 - _SLACK) <= best[looking]
        rows, numbers = looking[test], order[at[test]]
        diff = x[rows] - centroids[numbers]
        found = np.einsum("ij,ij->i", diff, diff)
        measured += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (numbers < who[rows]))
        who[rows[better]], best[rows[better]] = numbers[better], found[better]
    return who, best, measured


def _sums(centroids: np.ndarray) -> Batches:
    """Of a task's vectors: for each cluster the sum of each component and, at place -1, their number."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            who, _, _ = nearest(x, centroids)
            np.add.at(total, who, np.column_stack([np.ones(len(x), np.int64), x]))
        own = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(own))),
                                          pa.array(total[own].ravel())], names=["cluster", "place", "s"])
    return run


def _assigned(centroids: np.ndarray) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, best, _ = nearest(_matrix(batch.column(1), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])
    return run


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v): of vectors with `width` components, none null or non-finite, floor(scale * x) of each as 32-bit
    integers. Integers beyond LIMIT, that is components of over two million, are set to it."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("v", T.BinaryType())])
    return rows.mapInArrow(_integers(width, scale), schema)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, clusters: int = CLUSTERS,
            rounds: int = ROUNDS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row per vector that `integer_vectors` keeps: id, cluster, distance (squared, to its centroid), cluster_inertia, inertia,
    centroid_sha256.

    The start centroids are the vectors with the smallest digest of `<seed>:<id>`; each round gives every vector to its nearest centroid,
    the smaller number if several are, and moves each centroid with vectors to the floor of their mean. Fewer vectors than `clusters` make
    fewer clusters. Rows that repeat an id are vectors of their own and tie by their components; null ids start last.
    No vectors give no rows. Other columns are not read.

    The driver holds `clusters` x `width` numbers, the tasks the same and a batch of vectors.
    """
    spark = df.sparkSession
    vectors = stored(integer_vectors(df, id_col, vector_col, width, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = vectors.select(digest.alias("at"), "v").orderBy(F.asc_nulls_last("at"), "v").limit(clusters).collect()
    centroids = np.array([np.frombuffer(r.v, "<i4") for r in start], np.int64).reshape(-1, width)
    for _ in range(rounds if len(centroids) else 0):
        sums = vectors.select("v").mapInArrow(_sums(centroids), "cluster int, place int, s long").groupBy("cluster", "place").agg(F.sum("s").alias("s")).collect()
        total = np.zeros((len(centroids), width + 1), np.int64)
        for r in sums:
            total[r.cluster, r.place + 1] = r.s
        own = total[:, 0] > 0
        centroids[own] = total[own, 1:] // total[own, :1]
    schema = T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = stored(vectors.mapInArrow(_assigned(centroids), schema)) if len(centroids) else spark.createDataFrame([], schema)
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}     # a row for each cluster
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    facts = spark.createDataFrame(facts, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(facts), F.col("cluster") == F.col("number"))
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
