"""Centroid clustering against a plain version in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from meshlens.llm import wht

KIND = "vec_id long, embedding array<float>, cluster string, n int"


def plain(rows, k, rounds):
    kept = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in range(len(centres)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    final = assign()
    small = lambda n: n if n is not None and n < 2**63 else None
    out = []
    for (i, _), (d, j) in zip(kept, final):
        own = [x for x, c in final if c == j]
        sums = [None if any(small(x) is None for x in g) else small(sum(g)) for g in (own, [x for x, _ in final])]
        name = hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
        out.append((i, j, small(d), *sums, name))
    return sorted(map(repr, out))


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND).repartition(3)


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def vectors(seed, n, scale):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    return [(i, [f(r.gauss(0, scale)) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("scale", [0.2, 3e4, 2e5, 1e9])
def test_equals_plain_version(spark, scale):
    rows = vectors(int(scale), 90, scale)
    assert got(wht.cluster(table(spark, rows), centroids=7, rounds=3)) == plain(rows, 7, 3)


def test_ties_repeated_rows_and_unusable_vectors(spark):
    r = random.Random(1)
    # Few values, so that distances tie often; equal rows and ids; NULL ids.
    rows = [(i % 37 if i % 11 else None, [r.choice((0.0, 0.25, -0.0, -1 / 512)) if k < 2 else 0.0 for k in range(64)]) for i in range(120)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    rows += [(1000 + k, v) for k, v in enumerate(bad)]
    rows.append((2000, [3e5] + [0.0] * 63))  # one vector beyond the doubles' bound
    assert got(wht.cluster(table(spark, rows))) == plain(rows, 40, 5)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(3, 5, 1.0)
    assert got(wht.cluster(table(spark, rows))) == plain(rows, 40, 5)
    empty = wht.cluster(table(spark, rows).limit(0))
    assert empty.collect() == []
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert wht.cluster(table(spark, [(1, None)])).collect() == []


def test_centroids_that_lose_all_vectors_stay(spark):
    zero = [0.0] * 64
    rows = [(i, zero) for i in range(6)] + [(9, [1.0] * 64)]
    found = wht.cluster(table(spark, rows), centroids=4, rounds=2)
    assert got(found) == plain(rows, 4, 2)


def test_transform_keeps_distances_and_bands_are_coarse_to_fine():
    h = wht.transform_matrix()
    assert (h @ h.T == 64 * np.eye(64, dtype=int)).all()
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    assert list(changes) == sorted(changes) and changes[0] == 0


def test_limbs_are_exact():
    for n in (0, -1, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 3**90, -(3**90)):
        assert sum(part << (32 * k) for k, part in enumerate(wht.limbs(n))) == n


def test_sums_do_not_depend_on_how_vectors_are_dealt(spark):
    rows = vectors(8, 200, 0.3)
    one = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    assert got(wht.cluster(one.repartition(1))) == got(wht.cluster(one.repartition(13)))
