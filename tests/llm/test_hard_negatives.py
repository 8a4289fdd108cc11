import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.llm import hard_negatives
from ledgerlane.llm.hard_negatives import Lists, _Shard, mine

SCHEMA = "vec_id long, embedding array<double>, label int, score string, q string, id string, rank string"


def brute(rows, positives=5, negatives=5, low=80, high=100, every=100):
    """The contract by comparing all rows; the smallest (label, vector) of rows that share an id."""
    by_id = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            by_id.setdefault(i, []).append((label, [math.floor(256 * x) for x in v]))
    kept = {i: min(x) for i, x in by_id.items()}
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, own) for i, (own, v) in kept.items() if i != a)  # zip() pads with nothing
        for p, pid, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p]
            out += [(a, pid, n + 1, nid, -p, -s) for n, (s, nid, _) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(n=900, width=12, seed=2, centres=14, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    m = np.round(c[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * spread, 2)
    m[100:160] = m[99]  # copies over labels: many equal scores
    hot = rng.random(n) < 1 / 3
    labels = np.where(hot, 0, rng.integers(0, 10, n))
    return [(i * 4, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(m, labels, strict=True))]


ODD = [
    (100_000, None, 1), (100_100, [1.0] * 12, None), (100_200, [float("nan")] * 12, 1), (100_300, [None] + [1.0] * 11, 1), (100_400, [0.0] * 12, 3), (100_500, [], 2),
    (100_600, [0.5, -0.5], 4), (None, [1.0] * 12, 1), (100_700, [float("inf")] * 12, 1), (100_800, [2.0] * 12, 77), (100_900, [-1.0] * 12, -5),
]


def run(spark, rows, every=100, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine(spark, df, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many shards, lists in parts, one list after another
        for name, value in (("A_PART", 16), ("GATHERED", 8), ("TOGETHER", 3), ("A_SHARD", 600), ("SPREAD", 40)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors() + ODD + vectors()[:5] + [(8, [9.0] * 12, 9)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({r[:2] for r in want}) > 100 and any(a[:2] == b[:2] and a[5] == b[5] for a, b in zip(want, want[1:], strict=False))


def test_other_windows_and_counts(spark):
    rows = vectors(300, seed=5)
    options = {"positives": 2, "negatives": 3, "low": 50, "high": 95}
    assert run(spark, rows, every=20, **options) == brute(rows, every=20, **options)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [0.9, 0.1], 1), (3, [0.9, 0.0], 2), (4, [-1.0, 0.0], 2)]
    assert run(spark, rows) == brute(rows) != []
    assert run(spark, rows[:1]) == run(spark, rows[:2]) == run(spark, []) == run(spark, ODD[:4]) == []


def test_scores_of_zero(spark):
    rows = [(0, [0.0, 0.0], 1), *[(k, [float(k), 1.0], k % 3) for k in range(1, 40)]]
    assert run(spark, rows) == brute(rows) != []


def test_large_components(spark):
    """Beyond what doubles hold exactly scores are whole numbers still; what fits no long is an error."""
    rows = [(k * 50, [4e5 + k, -3e5 + 2 * k, 1.0], k % 2) for k in range(30)]
    assert run(spark, rows) == brute(rows) != []
    with pytest.raises(ValueError, match="too large"):
        run(spark, [(0, [1e9, 1.0], 1)])


def test_lists_beyond_the_bound_are_skipped(monkeypatch):
    """On clustered rows most lists are never scored, and the best rows are those of all rows."""
    import pandas as pd

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 100
    x = np.floor(centres[np.arange(4_000) % 40] + rng.normal(size=(4_000, 8)) * 3)
    number = np.arange(4_000) % 40
    radii = np.array([np.linalg.norm(x[number == k] - centres[k], axis=1).max() for k in range(40)])
    lists = Lists(centres, np.full(40, 100), radii, 1, True)
    scored = []
    monkeypatch.setattr(Lists, "scores", lambda self, q, y: scored.append(len(q) * len(y)) or q @ y.T)
    shard = _Shard([pd.DataFrame({"list": number, "id": np.arange(4_000), "label": np.zeros(4_000, dtype=int), "q": list(x)})], lists)
    asked = pd.DataFrame({"id": np.arange(50), "label": 1, "q": list(x[:50]), "los": [[-(1 << 62) + 1]] * 50, "his": [[1 << 62]] * 50, "bar": -np.inf})
    got = pd.concat(shard.best(asked, 5, same=False))
    scores = x[:50] @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    for k, found in got.groupby("anchor"):
        best = np.lexsort((np.arange(4_000), -scores[k]))[:5]
        assert found["id"].tolist() == best.tolist() and found["score"].tolist() == scores[k][best].tolist()
    assert sum(scored) < 0.2 * scores.size
