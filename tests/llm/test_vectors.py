import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.llm import grid_order_join, multi_index
from ledgerlane.llm.grid_order_join import join_intervals, near_duplicates
from ledgerlane.llm.multi_index import Index, search

SCHEMA = "vec_id long, embedding array<float>, label int, component long, rank int"


def rows(n=700, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, width))
    m = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, width)) * 0.18
    m[10:60] = m[9]  # copies
    return [(i * 3, [float(x) for x in np.float32(v)], None, 7, 1) for i, v in enumerate(m)]


ODD = [(100_001, None, 1, 1, 1), (100_002, [0.0] * 16, 1, 1, 1), (100_003, [float("nan")] * 16, 1, 1, 1), (100_004, [None] + [1.0] * 15, 1, 1, 1), (100_005, [float("inf")] * 16, 1, 1, 1), (100_006, [], 1, 1, 1)]


@pytest.mark.parametrize("block", [4096, 64])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(grid_order_join, "BLOCK", block)
    monkeypatch.setattr(grid_order_join, "LEAF", 16)
    data = rows()
    got = {r["vec_id"]: r for r in near_duplicates(spark, spark.createDataFrame([*data, *ODD], SCHEMA)).collect()}
    m = np.array([r[1] for r in data], dtype=np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    ids = [r[0] for r in data]
    want = brute.components(ids, lambda i, j: linked[i, j])
    assert len(set(want.values())) < len(ids) - 60
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(linked[k].sum()) - 1, want[i], want[i] == i)
    for i, *_ in ODD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    """An id on two unlike vectors joins nothing by itself; repeated rows are copies."""
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = [1.0, 0.1, 0.0]
    data = [(5, x), (5, y), (3, near), (9, y), (9, y), (7, z), (None, x)]
    got = near_duplicates(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    want = [(5, 1, 3, False), (5, 2, 5, True), (3, 1, 3, True), (9, 2, 5, False), (9, 2, 5, False), (7, 0, 7, True)]
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None) == sorted(want)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, None)]


@pytest.mark.parametrize("side", [0.125, 2.0])
def test_blocks_meet_in_one_cell(spark, monkeypatch, side):
    """Small blocks over several cells: links are neither lost nor counted twice."""
    monkeypatch.setattr(grid_order_join, "BLOCK", 16)
    monkeypatch.setattr(grid_order_join, "SIDE", side)
    data = rows(400, 3, seed=8)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(spark, spark.createDataFrame(data, SCHEMA)).collect()}
    m = np.array([r[1] for r in data], dtype=np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert [got[r[0]] for r in data] == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()


def test_join_covers_every_near_pair_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(x.T[::-1])]
    pairs = [(a + i, c + j) for a, c, m in join_intervals(x, x[:, :2], None, None, 0.95, 0.3163) for i, j in zip(*np.nonzero(m), strict=True)]
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(zip(i.tolist(), j.tolist(), strict=True))


def test_vector_operators_on_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(spark, empty).count() == 0 and search(spark, empty, F.col("vec_id") % 2 == 0).count() == 0
    only_odd = spark.createDataFrame(ODD, SCHEMA)
    assert near_duplicates(spark, only_odd).count() == len(ODD) and search(spark, only_odd, F.lit(True)).count() == 0


def test_search_recall_and_order(spark):
    data = rows(1500, seed=4)
    got = {}
    for r in search(spark, spark.createDataFrame([*data, *ODD], SCHEMA), F.col("vec_id") % 15 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    m = np.array([r[1] for r in data], dtype=np.float64)
    ids = np.array([r[0] for r in data])
    hits = total = 0
    for k, i in enumerate(ids.tolist()):
        if i % 15:
            continue
        s = m @ m[k]
        s[k] = -np.inf
        top = ids[np.lexsort((ids, -s))[:10]].tolist()
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert [v for *_, v in mine] == pytest.approx([s[v // 3] for _, v, _ in mine])
        hits += len({v for _, v, _ in mine} & set(top))
        total += 10
    assert hits / total >= 0.9


def test_search_returns_all_when_few_and_breaks_ties_by_id(spark):
    data = [(i, [1.0, 0.0], None, 0, 0) for i in (9, 4, 7, 2)]
    got = search(spark, spark.createDataFrame(data, SCHEMA), F.col("vec_id").isin(4, 7)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(4, 2), (4, 7), (4, 9), (7, 2), (7, 4), (7, 9)]


def test_walk_visits_cells_by_falling_sum():
    rng = random.Random(0)
    a, b = (np.array([rng.random() for _ in range(6)]) for _ in range(2))
    index = Index(np.zeros((6, 1)), np.zeros((6, 1)), 2, np.ones(36, dtype=int))
    sums = [a[c // 6] + b[c % 6] for c in index.visit(a, b, 36)[0]]
    assert len(sums) == 36 and sums == sorted(sums, reverse=True)


def test_search_keeps_doubles_and_counts_repeated_rows_and_ids_once(spark, monkeypatch):
    """Against brute force on the original doubles, over several shards; an id with two vectors stands
    for the smaller one."""
    monkeypatch.setattr(multi_index, "A_SHARD", 1024)
    monkeypatch.setattr(multi_index, "TOGETHER", 7)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 9)) + 1e-9 * rng.normal(size=(300, 9))
    m[200:] = m[:100] * (1 + 1e-12)  # near ties that single precision cannot tell
    data = [(i, m[i].tolist()) for i in range(300)]
    data += data[:40] + [(20, [9.0] * 9), (20, data[20][1])]
    vectors = {}
    for i, v in data:
        vectors[i] = min(vectors.get(i, v), v)
    got = {}
    for r in search(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array(sorted(vectors))
    all_ = np.array([vectors[i] for i in ids.tolist()])
    hits = 0
    assert sorted(got) == list(range(0, 300, 20))
    for q, rows_ in got.items():
        s = all_ @ np.array(vectors[q])
        s[ids == q] = -np.inf
        mine = sorted(rows_)
        assert [r for r, *_ in mine] == list(range(1, 21)) and len({v for _, v, _ in mine}) == 20
        assert [x for *_, x in mine] == pytest.approx([s[v] for _, v, _ in mine], rel=1e-13)
        assert [v for _, v, _ in mine] == [v for _, v, _ in sorted(mine, key=lambda r: (-r[2], r[1]))]
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {v for _, v, _ in mine})
    assert hits >= 0.97 * 20 * len(got)
