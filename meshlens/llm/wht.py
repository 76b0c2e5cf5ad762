"""Centroid clustering by Walsh-Hadamard progressive search.

Method: vectors and centroids are whole numbers; the Walsh-Hadamard transform of both is exact and
keeps distances (64 times the squared distance is the squared distance of the 64 coefficients).
Coefficients are ordered by their number of sign changes, coarse to fine, and handled in bands. A
first band gives every centroid a lower bound, the one with the least gives a whole distance;
centroids whose sum so far is strictly above the best whole distance go, band by band, and the
others finish all coefficients. So ties stay, and go to the smaller number.

Plan. A round is one pass over the vectors; a task sends the sums of its vectors per centroid and
component, split in 32-bit limbs so that they are exact at any size, and the driver gets one sum for
each centroid, component and limb: their number does not depend on the vectors. Centroids (40 x 64
numbers) travel with the task. The last assignment is stored, summed per cluster and joined with
these sums.

Numbers. Doubles hold every sum exactly while components stay below 2^19, 64-bit integers while
they stay below 2^24; vectors and centroids beyond take Python's integers, so the result is
exact at every size. Distances and sums that exceed 64 bits are NULL.

Cases. Vectors that are NULL, of another length or with a NULL or non-finite component are left
out. Equal vectors and repeated ids are vectors of their own. A NULL id is hashed as an empty one.
Fewer vectors than centroids give as many centroids. No vectors give no rows. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import stored

SIZE = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
#: Ends of the bands of coefficients.
BANDS = (4, 16, 32, SIZE)
#: Components below these bounds are handled as such numbers; beyond, as Python's.
BOUNDS = ((2**19, np.float64), (2**24, np.int64))
#: Vectors handled at one time.
BLOCK = 4096
LIMB = 32


def transform_matrix() -> np.ndarray:
    """Hadamard matrix of 64 rows, those with few sign changes first."""
    h = np.ones((1, 1), np.int64)
    while len(h) < SIZE:
        h = np.block([[h, h], [h, -h]])
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    return h[np.argsort(changes, kind="stable")]


def transform(numbers: np.ndarray) -> np.ndarray:
    return numbers @ transform_matrix().astype(numbers.dtype).T


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every vector; both of one kind of number."""
    x, c = transform(vectors), transform(centroids)
    coarse = BANDS[0]
    # Squares of differences, opened up: products of matrices, exact for whole numbers.
    a, b = x[:, :coarse], c[:, :coarse]
    sums = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    gap = x - c[sums.argmin(axis=1)]
    best = (gap * gap).sum(axis=1)
    row, number = np.nonzero(sums <= best[:, None])
    total = sums[row, number]
    for low, high in zip(BANDS, BANDS[1:]):
        gap = x[row, low:high] - c[number, low:high]
        total = total + (gap * gap).sum(axis=1)
        best_of = np.minimum(best, _least(row, total, best)) if high == SIZE else best
        alive = total <= best_of[row]
        row, number, total = row[alive], number[alive], total[alive]
    # Every row is left with its nearest centroids, in ascending order: the first is the answer.
    at = np.unique(row, return_index=True)[1]
    return number[at], total[at] // SIZE


def _least(row: np.ndarray, total: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least total of every row."""
    least = start.copy()
    np.minimum.at(least, row, total)
    return least


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and their components as whole numbers (doubles)."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == SIZE)
    flat = lists.take(pa.array(places, pa.int64())).flatten()
    numbers = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, SIZE)
    with np.errstate(over="ignore"):
        numbers = np.floor(numbers * SCALE) + 0.0  # no negative zero
    finite = np.isfinite(numbers).all(axis=1)
    return places[finite], numbers[finite]


def as_kind(numbers: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers as another kind, exactly."""
    if kind is not object:
        return numbers.astype(kind)
    return np.array([int(x) for x in numbers.ravel()], object).reshape(numbers.shape)


def blocks(numbers: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(places, clusters, distances)`` of some vectors at a time; all are of one kind of number."""
    if not len(numbers):
        return
    most = float(max(abs(x) for x in centroids.ravel()))
    level = np.digitize(np.maximum(np.abs(numbers).max(axis=1), most), [bound for bound, _ in BOUNDS])
    for k, kind in enumerate([*(kind for _, kind in BOUNDS), object]):
        at = np.flatnonzero(level == k)
        for start in range(0, len(at), BLOCK):
            some = at[start : start + BLOCK]
            yield some, *nearest(as_kind(numbers[some], kind), as_kind(centroids, kind))


def limbs(number: int) -> Iterator[int]:
    """A whole number in base 2^32, least digit first; the last digit has the sign."""
    half = 1 << (LIMB - 1)
    while not -half <= number < half:
        yield number & ((1 << LIMB) - 1)
        number >>= LIMB
    yield number


def summed(vectors: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """Per centroid that has vectors: its number, how many they are, their sum per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), SIZE + 1), object)  # the last column counts
        for batch in batches:
            _, numbers = usable(batch.column(0))
            for some, cluster, _ in blocks(numbers, centroids):
                for c in np.unique(cluster):
                    own = numbers[some[cluster == c]]
                    exact = own if np.abs(own).max() < BOUNDS[-1][0] else as_kind(own, object)
                    sums[c] += np.array([*(int(x) for x in exact.sum(axis=0)), len(own)], object)
        rows = [
            (c, place, k, part)
            for c in range(len(centroids))
            if sums[c, SIZE]
            for place in range(SIZE + 1)
            for k, part in enumerate(limbs(int(sums[c, place])))
        ]
        if rows:
            columns = [pa.array(v, kind) for v, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "limb", "part"])

    parts = vectors.mapInArrow(run, "cluster int, place int, limb int, part long")
    whole = parts.groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part"))
    found: dict[int, list[int]] = {}
    for r in whole.collect():  # one row for each centroid, component and limb
        found.setdefault(r.cluster, [0] * (SIZE + 1))[r.place] += r.part << (LIMB * r.limb)
    return [(c, n[SIZE], n[:SIZE]) for c, n in sorted(found.items())]


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` usable vectors whose ids have the smallest digests; equal ids by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers = usable(batch.column(1))
            lists = pa.ListArray.from_arrays(
                np.arange(0, numbers.size + 1, SIZE, dtype=np.int32), numbers.ravel()
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), lists], names=["digest", "numbers"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    kept = vectors.select(digest, "vector").mapInArrow(run, "digest string, numbers array<double>")
    top = kept.orderBy("digest", "numbers").limit(k).collect()
    return np.array([[int(x) for x in r.numbers] for r in top], object).reshape(-1, SIZE)


def moved(centroids: np.ndarray, sums: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """Centroids at the floor of their vectors' mean; those without vectors stay."""
    placed = centroids.copy()
    for c, n, total in sums:
        placed[c] = [x // n for x in total]
    return placed


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, cluster, distance)`` of every usable vector."""
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers = usable(batch.column(1))
            cluster, distance = np.zeros(len(places), np.int32), np.zeros(len(places), object)
            for some, number, far in blocks(numbers, centroids):
                cluster[some] = number
                distance[some] = [int(d) if d < 2**63 else None for d in far.tolist()]
            columns = [batch.column(0).take(pa.array(places)), pa.array(cluster), pa.array(distance.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return vectors.select("id", "vector").mapInArrow(run, schema)


def total(column: str) -> Column:
    """Sum of longs that is NULL where a part is, or where it exceeds 64 bits."""
    whole = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(F.count_if(F.col(column).isNull()) == 0, whole.try_cast("bigint"))


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    *,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: str = "2",
) -> DataFrame:
    """Per usable vector: ``(<vec_id>, cluster, distance, cluster_inertia, inertia, centroid_sha256)``."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    centres = first_centroids(rows, centroids, seed)
    if len(centres):
        for _ in range(rounds):
            centres = moved(centres, summed(rows.select("vector"), centres))
    found = stored(assigned(rows, centres), "clusters")
    per_cluster = found.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    inertia = per_cluster.agg(total("cluster_inertia").alias("inertia")).head().inertia
    digests = [(k, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(centres.tolist())]
    named = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # One row a centroid.
    facts = per_cluster.join(named, "cluster").withColumn("inertia", F.lit(inertia).cast("long"))
    return found.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
