"""Nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own (k-means on a bounded sample, fixed seed), so K
centroids a half give K x K cells. A query ranks each half's centroids by inner product, walks the
pairs of centroids from the largest sum on with a heap, and stops once the cells it has visited hold
enough entries; these are reranked by the exact inner product in double precision. How many are
enough is measured: 200 sampled rows are compared with all rows, and the number is taken that would
have found 97 % of their neighbours.

Every row is indexed. Cells are dealt to shards, large cells over several; a query goes to the
shards that hold its cells, with its vector and the least sum that its walk has come to, from which a
shard tells which of its cells are meant, and brings back its best few from each. A shard holds as many
entries as memory allows, so that a query is copied seldom next to what it is compared with. A task
reads a shard's entries and then lets the shard's queries stream past them, so that it never holds
more than a batch of these. Of equal vectors only the smallest ids can be among the nearest, so k + 1
of them are kept (a limit that loses no result), and equal queries are searched once. Cell sizes
(K x K numbers, bounded) are known to all workers. Vectors keep the input's element type throughout.

Edge cases: vectors that are null, zero or hold null or non-finite components, and rows without a
vec_id, take no part; repeated rows count once; of rows that share a vec_id but not the vector the
smallest vector stands for the id; with k other ids or fewer all are returned; ties go to the smaller
vec_id; shorter vectors are padded with zeros; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import materialize
from ledgerlane.llm.vectors import matrix, sample, usable

#: Entries a cell should have; numbers that a shard may hold, and shards that a table of any size is
#: spread over; centroids a half; rounds of k-means; entries of a cell that stay together; queries scored
#: together; queries of the calibration.
A_CELL, A_SHARD, SPREAD, MOST_CENTROIDS, ROUNDS, A_PART, TOGETHER, CALIBRATING = 50, 4 << 20, 24, 1024, 10, 2_048, 256, 200
#: For the rounding of sums that are computed in other batches.
SLACK = 1e-9


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids of x (fewer rows: repeated ones)."""
    rng = np.random.default_rng(42)
    if not len(x):
        return np.zeros((k, x.shape[1]))
    c = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * np.square(c).sum(axis=1)).argmax(axis=1)


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    width: int
    sizes: np.ndarray | None = None  # entries by cell
    shards: int = 1

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.first.shape[1]], x[:, self.first.shape[1] :]

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return nearest(a, self.first) * len(self.second) + nearest(b, self.second)

    def visit(self, a: np.ndarray, b: np.ndarray, enough: int) -> tuple[list[int], float]:
        """Cells from the largest sum of a query's two inner products on, until they hold enough, and the
        least of their sums."""
        i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[i_of], b[j_of]
        heap, seen, out, n, least = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, [], 0, 0.0
        while heap and n < enough:
            least, i, j = heapq.heappop(heap)
            cell = int(i_of[i]) * len(j_of) + int(j_of[j])
            if self.sizes[cell]:
                out.append(cell)
                n += int(self.sizes[cell])
            for u, v in ((i + 1, j), (i, j + 1)):
                if u < len(a) and v < len(b) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (-(a[u] + b[v]), u, v))
        return out, -least

    def parts(self, cell: np.ndarray) -> np.ndarray:
        return 1 + self.sizes[cell] // A_PART

    def shard(self, cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (cell * 2_654_435_761 + part * 40_503) % self.shards


class _Shard:
    """The entries of a shard, by cell."""

    def __init__(self, parts: list[pd.DataFrame], index: Index) -> None:
        entries = pd.concat(parts).sort_values(["cell", "id"])
        self.index, self.x, self.ids = index, matrix(entries["embedding"], index.width), entries["id"].to_numpy()
        self.cells, starts = np.unique(entries["cell"].to_numpy(), return_index=True)
        self.cuts = [*zip(starts.tolist(), [*starts[1:].tolist(), len(entries)], strict=True)]

    def best(self, queries: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
        """The k best entries of the cells that each query means, ties to the smaller id."""
        x, ids, index = self.x, self.ids, self.index
        first, second = np.divmod(self.cells, len(index.second))
        step = max(1, min(TOGETHER, A_SHARD // max(len(x), 1)))  # so that their scores fit in memory
        for start in range(0, len(queries), step):
            some = queries.iloc[start : start + step]
            q = matrix(some["embedding"], index.width)
            a, b = (h @ c.T for h, c in zip(index.halves(q), (index.first, index.second), strict=True))
            meant = a[:, first] + b[:, second] >= some["bar"].to_numpy()[:, None]
            scores = np.full((len(some), len(x)), -np.inf)
            for (s, e), on in zip(self.cuts, meant.T, strict=True):
                who = np.flatnonzero(on)
                if len(who):
                    scores[who, s:e] = q[who] @ x[s:e].T
            least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(some), -np.inf)
            row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            best = np.lexsort((ids[col], -scores[row, col], row))
            row, col = row[best], col[best]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[top], col[top]
            yield pd.DataFrame({"qid": some["id"].to_numpy()[row], "vec_id": ids[col], "score": scores[row, col]})


def _runs(batch: pd.DataFrame) -> Iterator[tuple[int, bool, pd.DataFrame]]:
    """Runs of rows of one shard and kind (entries, then queries)."""
    shard, asks = batch["shard"].to_numpy(), batch["asks"].to_numpy()
    cuts = np.flatnonzero(np.diff(shard * 2 + asks, prepend=-1)).tolist()
    for s, e in zip(cuts, [*cuts[1:], len(batch)], strict=True):
        yield int(shard[s]), bool(asks[s]), batch.iloc[s:e]


def enough_for(index: Index, celled: DataFrame, k: int, recall: float) -> int:
    """How many entries a walk must gather: for a bounded sample of rows as queries, compared with all
    rows, the number that reaches `recall` of their k nearest."""
    hashed, rows = F.xxhash64("vec_id", F.lit(1)), int(index.sizes.sum())
    few = celled.filter(hashed < F.lit(int(-(2**63) + 2.0**64 * 8 * CALIBRATING / rows))) if rows > 16 * CALIBRATING else celled
    some = few.orderBy(hashed, "vec_id").limit(CALIBRATING).toArrow()
    x = matrix(pd.Series(some["embedding"].to_pylist(), dtype=object), index.width)
    own = some["vec_id"].to_numpy()
    if not len(x):
        return 1

    def nearest_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = x @ matrix(batch["embedding"], index.width).T
            ids = batch["vec_id"].to_numpy()
            scores[own[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(x)), top.shape[1])
            yield pd.DataFrame({"q": q, "score": scores[q, top.ravel()], "cell": batch["cell"].to_numpy()[top.ravel()]})

    near = celled.mapInPandas(nearest_of, "q int, score double, cell int").filter("score > double('-infinity')")
    ranked = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))).filter(F.col("nth") <= k)
    true = ranked.select("q", "cell").toArrow().to_pandas()
    a, b = (h @ c.T for h, c in zip(index.halves(x), (index.first, index.second), strict=True))
    reached = []
    for q, cells in true.groupby("q")["cell"]:
        sums = (a[q][:, None] + b[q][None, :]).ravel()
        order = np.argsort(-sums, kind="stable")
        gathered = np.empty(len(sums), dtype=np.int64)
        gathered[order] = np.cumsum(index.sizes[order])
        reached.append(gathered[cells.to_numpy()])
    return int(np.quantile(np.concatenate(reached), recall, method="higher")) if reached else 1


def search(spark: SparkSession, rows: DataFrame, queries: Column, k: int = 20, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows of each row of rows(vec_id,
    embedding) for which the condition `queries` holds; recall is what the calibration aims at."""
    usable_rows = rows.select("vec_id", "embedding").filter(usable() & F.col("vec_id").isNotNull())
    good = materialize(usable_rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = materialize(good.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1).drop("nth"))
    n, width = kept.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    width = width or 2
    some = sample(kept, "vec_id", width, n)
    centroids, half = min(MOST_CENTROIDS, max(8, int((n / A_CELL) ** 0.5))), (width + 1) // 2
    index = Index(k_means(some[:, :half], centroids), k_means(some[:, half:], centroids), width)

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(index.cell(matrix(vectors, width)).astype(np.int32))

    celled = materialize(kept.withColumn("cell", cell_of("embedding")))
    counts = celled.groupBy("cell").count().toArrow()
    index.sizes = np.zeros(centroids * centroids, dtype=np.int64)
    index.sizes[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    index.shards = max(1 + n * width // A_SHARD, min(SPREAD, 1 + n // TOGETHER))
    enough = max(k + 1, enough_for(index, celled, k, recall))
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def shard_of(cell: pd.Series, vec_id: pd.Series) -> pd.Series:
        c, i = cell.to_numpy().astype(np.int64), shared.value
        part = ((vec_id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % i.parts(c)
        return pd.Series(i.shard(c, part).astype(np.int32))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = shared.value
        for batch in batches:
            a, b = (h @ c.T for h, c in zip(i.halves(matrix(batch["embedding"], width)), (i.first, i.second), strict=True))
            out = []
            for k_, (qid, vector) in enumerate(zip(batch["qid"], batch["embedding"], strict=True)):
                cells, least = i.visit(a[k_], b[k_], enough)
                cells, bar = np.array(cells, dtype=np.int64), least - SLACK * (1 + abs(least))
                times = i.parts(cells)
                cells, part = np.repeat(cells, times), np.concatenate([np.arange(t) for t in times]) if len(times) else times
                shard = i.shard(cells, part)
                out += [(s, qid, vector, bar) for s in np.unique(shard).tolist()]
            yield pd.DataFrame(out, columns=["shard", "qid", "embedding", "bar"])

    asked = good.filter(queries)
    distinct = materialize(asked.groupBy("embedding").agg(F.min("vec_id").alias("qid")))
    kind = kept.schema["embedding"].dataType.simpleString()
    dealt = distinct.repartition(1 + distinct.count() // TOGETHER, "qid")
    wanted = dealt.mapInPandas(walk, f"shard int, qid long, embedding {kind}, bar double")
    entries = celled.select(
        shard_of("cell", "vec_id").alias("shard"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "embedding", "cell", F.lit(None).cast("double").alias("bar")
    )
    questions = wanted.select("shard", F.lit(1).alias("asks"), F.col("qid").alias("id"), "embedding", F.lit(0).alias("cell"), "bar")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, at, shard = [], None, None
        for batch in batches:
            for number, asks, some in _runs(batch):
                if number != at:
                    parts, at, shard = [], number, None
                if not asks:
                    parts.append(some)
                elif parts:
                    shard = shard or _Shard(parts, shared.value)
                    yield from shard.best(some, k + 1)

    streamed = entries.union(questions).repartition(index.shards, "shard").sortWithinPartitions("shard", "asks")
    found = streamed.mapInPandas(find, "qid long, vec_id long, score double")
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= k + 1).drop("nth")
    of = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(distinct, "embedding").select("query_id", "qid")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        of.join(top, "qid").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
