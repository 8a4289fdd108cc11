"""Clusters of vectors by k-means in whole numbers, assigned by partial-distance search.

Components are quantised to floor(64 x), so that distances, sums and centroids are exact and do not
depend on how rows are dealt to tasks. The first centroids are the vectors whose ids hash smallest.
Each round assigns every vector to its nearest centroid (squared Euclidean distance, ties to the
smaller number) and moves every centroid that has vectors to their mean, rounded down by component.

Assignment is a partial-distance search: dimensions are visited from the largest variance (over all
vectors) on, a few at a time; squared differences add up, and a centroid is abandoned for a vector
once its partial sum is strictly above the best whole distance so far. Survivors finish all
dimensions. The centroid that looks nearest in the first dimensions goes first, so that the bound is
tight early. The order changes the work only, never the result.

A round is one pass over a written table; a task adds up its own vectors by centroid and hands on one
row a centroid, so that neither a large cluster nor a very common vector gathers anywhere. What
comes to the driver is centroids x dimensions numbers, whatever the rows.

Edge cases: vectors that are null, of another width, or hold null or non-finite components are left
out; zero vectors stay; every row counts, repeated rows and shared ids included (equal hashes: the
smaller vector first); a row without a vec_id is clustered but starts no centroid unless there are
too few others; with fewer vectors than centroids each starts one; centroids without vectors stay
where they are; an empty table gives an empty result; other columns are not looked at. A component
of 2^18 or more (2^24 quantised) is an error, since distances might not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import materialize

WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Dimensions that are added at a time; vectors searched together; a quantised component's limit.
AT_A_TIME, TOGETHER, LIMIT = 8, 4_096, 1 << 24


def quantised(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and the quantised vector q of the rows whose vectors can be clustered."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall(v, lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    fits = F.when(small, F.transform(v, lambda x: F.floor(x.cast("double") * scale))).otherwise(F.raise_error(F.lit(f"a component is {LIMIT // scale} or more")))
    return rows.filter(v.isNotNull() & (F.size(v) == width) & finite).select("vec_id", fits.cast("array<int>").alias("q"))


def search(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many squares were added."""
    x, c = x[:, order], centroids[:, order]
    n, width = x.shape
    first = slice(0, AT_A_TIME)
    begun = np.stack([np.square(x[:, first] - row[first]).sum(axis=1) for row in c], axis=1)
    added = begun.size * min(AT_A_TIME, width)
    best, number = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    turns = np.argsort(begun, axis=1, kind="stable")
    for turn in range(len(c)):
        of = turns[:, turn]
        alive = np.flatnonzero(begun[np.arange(n), of] <= best)
        sums = begun[alive, of[alive]]
        for start in range(AT_A_TIME, width, AT_A_TIME):
            dims = slice(start, start + AT_A_TIME)
            sums += np.square(x[alive, dims] - c[of[alive], dims]).sum(axis=1)
            added += len(alive) * (min(width, start + AT_A_TIME) - start)
            going = sums <= best[alive]
            alive, sums = alive[going], sums[going]
        nearer = (sums < best[alive]) | (of[alive] < number[alive])
        alive, sums = alive[nearer], sums[nearer]
        best[alive], number[alive] = sums, of[alive]
    return number, best, added


def _rows(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array(vectors.to_list(), dtype=np.int64).reshape(-1, width)


def _by_dimension(df: DataFrame, *sums: str) -> DataFrame:
    """Sums of arrays by dimension: what tasks have added up, added up."""
    pairs = F.posexplode(F.arrays_zip(*sums)).alias("dim", "one")
    keys = [c for c in df.columns if c not in sums]
    return df.select(*keys, pairs).groupBy(*keys, "dim").agg(*[F.sum(f"one.{s}").alias(s) for s in sums])


def variance_order(vectors: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Dimensions from the largest variance on; of equal ones the smaller first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, squares = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = _rows(batch["q"], width).astype(np.float64)
            n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + np.square(x).sum(axis=0)
        yield pd.DataFrame({"n": [np.full(width, float(n))], "sums": [sums], "squares": [squares]})

    added = vectors.select("q").mapInPandas(add, "n array<double>, sums array<double>, squares array<double>")
    total = _by_dimension(added, "n", "sums", "squares").toPandas().sort_values("dim")
    n = np.maximum(total["n"].to_numpy(), 1)
    variance = total["squares"].to_numpy() / n - np.square(total["sums"].to_numpy() / n)
    return np.argsort(-variance, kind="stable") if len(total) else np.arange(width)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, width: int = WIDTH) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<vec_id>`."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    some = vectors.select(digest.alias("digest"), "q").orderBy(F.asc_nulls_last("digest"), "q").limit(k)
    return np.array([r["q"] for r in some.collect()], dtype=np.int64).reshape(-1, width)


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                x = _rows(batch["q"].iloc[start : start + TOGETHER], width)
                number, *_ = search(x, centroids, order)
                n += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    sums[c] += x[number == c].sum(axis=0)
        own = np.flatnonzero(n)
        if len(own):
            yield pd.DataFrame({"cluster": own, "n": [np.full(width, n[c]) for c in own], "sums": list(sums[own])})

    added = vectors.select("q").mapInPandas(add, "cluster int, n array<long>, sums array<long>")
    out = centroids.copy()
    for r in _by_dimension(added, "n", "sums").collect():
        out[r["cluster"], r["dim"]] = r["sums"] // r["n"]
    return out


def clusters(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """One row per vector of rows(vec_id, embedding) that can be clustered: vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256 (of the centroid's components, joined by commas)."""
    vectors = materialize(quantised(rows, width))
    centroids, order = first_centroids(vectors, k, width), variance_order(vectors, width)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(vectors, centroids, order)

    @F.pandas_udf("cluster int, distance long")
    def assign(q: pd.Series) -> pd.DataFrame:
        parts = [search(_rows(q.iloc[s : s + TOGETHER], width), centroids, order)[:2] for s in range(0, len(q), TOGETHER)]
        return pd.DataFrame({"cluster": np.concatenate([p[0] for p in parts]).astype(np.int32), "distance": np.concatenate([p[1] for p in parts])})

    assigned = materialize(vectors.select("vec_id", assign("q").alias("at")).select("vec_id", "at.*"))
    inertias = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(c, total, sum(inertias.values()), digest[c]) for c, total in inertias.items()]  # a row a centroid
    totals = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
