import hashlib
import math

import numpy as np
import pytest

from ledgerlane.llm import centroid_clusters
from ledgerlane.llm.centroid_clusters import clusters, search

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, q string"


def brute(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in Python's whole numbers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [q for (_, q), (_, c) in zip(kept, near, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    total = [sum(d for d, c in near if c == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, total[c], sum(total), sha[c]) for (i, _), (d, c) in zip(kept, near, strict=True)]


def vectors(n=220, seed=4, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64)) * np.linspace(1, 0.05, 64)
    m = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, 64)) * spread
    m[20:50] = m[19]
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]


ODD = [
    (900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [1.0] * 63), (905, [1.0] * 65), (906, []), (907, [float("-inf")] * 64),
    (None, [0.5] * 64), (908, [-0.01] * 64), (19, [0.25] * 64),
]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in clusters(df, **options).collect()), key=str)


@pytest.mark.parametrize("together, seed", [(4_096, 4), (7, 5)])
def test_matches_brute_force(spark, monkeypatch, together, seed):
    monkeypatch.setattr(centroid_clusters, "TOGETHER", together)
    rows = vectors(seed=seed) + ODD + vectors(seed=seed)[:3]
    assert run(spark, rows) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    rows = vectors()[:n]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_equal_vectors_tie_to_the_smaller_centroid(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    got = run(spark, rows)
    assert got == sorted(brute(rows), key=str) and {(r[1], r[2]) for r in got} == {(0, 0)}


def test_no_vector_can_be_clustered(spark):
    assert run(spark, ODD[:1] + ODD[2:8]) == []


def test_a_component_that_does_not_fit_is_an_error(spark):
    with pytest.raises(Exception, match="a component is 262144 or more"):
        run(spark, [(1, [1e9] + [0.0] * 63)])


def test_search_abandons_and_stays_exact():
    """Partial sums end most comparisons early; results are those of whole distances."""
    rng = np.random.default_rng(1)
    c = rng.integers(-400, 400, (16, 64))
    x = c[rng.integers(0, 16, 500)] + rng.integers(-30, 30, (500, 64))
    number, distance, added = search(x, c, np.arange(64)[::-1])
    whole = np.square(x[:, None, :] - c[None]).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert added < 0.35 * whole.size * 64
    same = np.zeros((3, 64), dtype=np.int64)  # ties
    assert search(same, np.zeros((4, 64), dtype=np.int64), np.arange(64))[0].tolist() == [0, 0, 0]
    assert search(same, np.array([[1] * 64, [-1] * 64, [0] * 63 + [8]]), np.arange(64))[0].tolist() == [0, 0, 0]
