"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels whose
score lies in a window below the positive's.

Vectors are quantised to floor(256 x); a score is their inner product, a whole number. Rows lie in
inverted lists, one a centroid (k-means on a bounded sample, fixed seed; the sample decides which rows
share a list, so it changes the work only), and every list knows its radius r, the largest distance
from its centroid c to a row, over all rows. By Cauchy-Schwarz no row of a list scores above
q.c + |q| r, nor below q.c - |q| r, for an anchor q. A search visits lists by the upper bound; a list
whose range lies outside the windows is skipped, and once the bound is strictly below the k-th score
found, nothing is left to find (equal scores may still win by a smaller vec_id). Results are exact.

A search runs twice over the lists. The first visit looks at the few lists with the highest bounds,
which gives each anchor a k-th score; the second goes to every list that this score does not rule out,
and raises it further as it goes. Positives and negatives are searched in this way one after the other.

Lists are dealt to shards, long ones in parts, and an anchor goes to the shards that hold lists it must
visit, once a shard, its bounds being computed anew there from the centroids and radii, which all
workers know (a bounded number). A task reads a shard's rows, whose number is bounded, and lets the
anchors stream past them, so that it never holds more than a batch of these. A shard hands back at most
k rows for an anchor and window.

Edge cases: rows with a null vec_id, label or vector, or with null or non-finite components, take no
part; zero vectors do, with scores of zero; repeated rows count once; of rows that share a vec_id the
smallest (label, vector) stands for the id; ties go to the smaller vec_id; shorter vectors are padded
with zeros; a positive without a row in its window has no result; an empty table gives an empty
result; other columns are not looked at. Components for which a score might not fit a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import materialize
from ledgerlane.llm.multi_index import k_means, nearest
from ledgerlane.llm.vectors import matrix, sample

#: Most lists; rows of a list that stay together; rows that a first visit gathers; anchors scored
#: together; numbers that a shard may hold, and shards that a table of any size is spread over.
MOST_LISTS, A_PART, GATHERED, TOGETHER, A_SHARD, SPREAD = 1024, 2_048, 2_048, 256, 4 << 20, 24
#: No score is as large; whole numbers below EXACT are exact in double precision.
NONE, EXACT = 1 << 62, 1 << 53


@dataclass
class Lists:
    """What every worker knows of the lists."""

    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    shards: int
    exact: bool  # scores are exact in double precision
    norms: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.norms = np.linalg.norm(self.centroids, axis=1)

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def bounds(self, q: np.ndarray, lists: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """The highest and lowest score that a row of each list can have with each anchor."""
        dot, own = q @ self.centroids[lists].T, np.linalg.norm(q, axis=1)[:, None]
        reach = own * self.radii[lists]
        reach += 1e-9 * own * (self.norms[lists] + self.radii[lists]) + 1e-6  # for the rounding of doubles
        return dot + reach, dot - reach

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return q @ x.T if self.exact else q.astype(np.int64) @ x.T.astype(np.int64)

    def parts(self, number: np.ndarray) -> np.ndarray:
        return 1 + self.sizes[number] // A_PART

    def shard(self, number: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (number * 2_654_435_761 + part * 40_503) % self.shards


def _windows(los: pd.Series, his: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Windows of anchors as two arrays; shorter rows end with windows that nothing fits."""
    most = max(map(len, los), default=0)
    lo, hi = (np.full((len(los), most), x, dtype=np.int64) for x in (NONE, -NONE))
    for k, (a, b) in enumerate(zip(los, his, strict=True)):
        lo[k, : len(a)], hi[k, : len(b)] = a, b
    return lo, hi


class _Best:
    """The k best (score, id) of each of n searches, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids = np.full((n, k), -NONE, dtype=np.int64), np.zeros((n, k), dtype=np.int64)

    def add(self, search: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k, known = self.scores.shape[1], np.unique(search)
        search = np.concatenate([search, np.repeat(known, k)])
        scores, ids = np.concatenate([scores, self.scores[known].ravel()]), np.concatenate([ids, self.ids[known].ravel()])
        order = np.lexsort((ids, -scores, search))
        search, scores, ids = search[order], scores[order], ids[order]
        nth = np.arange(len(search)) - np.searchsorted(search, search)
        top = nth < k
        self.scores[search[top], nth[top]], self.ids[search[top], nth[top]] = scores[top], ids[top]


class _Shard:
    """The rows of a shard, by list."""

    def __init__(self, parts: list[pd.DataFrame], lists: Lists) -> None:
        rows = pd.concat(parts).sort_values(["list", "id"])
        self.lists, self.x = lists, matrix(rows["q"], lists.width)
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.numbers, starts = np.unique(rows["list"].to_numpy(), return_index=True)
        self.ends = [*zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True)]

    def best(self, asked: pd.DataFrame, k: int, same: bool) -> Iterator[pd.DataFrame]:
        """The k best rows of this shard for each anchor and window."""
        for start in range(0, len(asked), TOGETHER):
            some = asked.iloc[start : start + TOGETHER]
            q, own, label, bar = matrix(some["q"], self.lists.width), some["id"].to_numpy(), some["label"].to_numpy(), some["bar"].to_numpy()
            lo, hi = _windows(some["los"], some["his"])
            windows, found = lo.shape[1], _Best(lo.size, k)
            upper, lower = self.lists.bounds(q, self.numbers)
            for at in np.argsort(-upper.max(axis=0), kind="stable").tolist():
                least = np.maximum(lo, found.scores[:, -1].reshape(lo.shape))
                meets = (upper[:, at, None] >= least) & (lower[:, at, None] <= hi)
                who = np.flatnonzero(meets.any(axis=1) & (upper[:, at] >= bar))
                if not len(who):
                    continue
                s, e = self.ends[at]
                scores = self.lists.scores(q[who], self.x[s:e]).astype(np.int64)
                fits = ((self.labels[s:e] == label[who, None]) == same) & (self.ids[s:e] != own[who, None])
                for w in range(windows):
                    inside = fits & (scores >= least[who, w, None]) & (scores <= hi[who, w, None])
                    if e - s > k:  # only rows that are among the k best here, or equal to the k-th
                        inside &= scores >= np.partition(np.where(inside, scores, -NONE), e - s - k, axis=1)[:, [e - s - k]]
                    row, col = np.nonzero(inside)
                    if len(row):
                        found.add(who[row] * windows + w, scores[row, col], self.ids[s:e][col])
            search, nth = np.nonzero(found.scores > -NONE)
            yield pd.DataFrame({"anchor": own[search // windows], "window": search % windows, "id": found.ids[search, nth], "score": found.scores[search, nth]})


def _runs(batch: pd.DataFrame) -> Iterator[tuple[int, bool, pd.DataFrame]]:
    """Runs of one shard's rows (lists, then anchors)."""
    shard, asks = batch["shard"].to_numpy(), batch["asks"].to_numpy()
    cuts = np.flatnonzero(np.diff(shard * 2 + asks, prepend=-1)).tolist()
    for s, e in zip(cuts, [*cuts[1:], len(batch)], strict=True):
        yield int(shard[s]), bool(asks[s]), batch.iloc[s:e]


def _visit(rows: DataFrame, anchors: DataFrame, shared, k: int, same: bool, first: bool) -> DataFrame:
    """(anchor, window, id, score) of the k best rows for each window of anchors(id, label, q, los, his)
    that the search visits: lists of the highest bounds only if first."""
    lists = shared.value
    kind = rows.schema["q"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        numbers = np.flatnonzero(known.sizes)
        times = known.parts(numbers)
        heads = np.cumsum(times) - times  # each list's first part
        places = known.shard(np.repeat(numbers, times), np.arange(times.sum()) - np.repeat(heads, times))
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                some = batch.iloc[start : start + TOGETHER]
                upper, lower = known.bounds(matrix(some["q"], known.width), numbers)
                lo, hi = _windows(some["los"], some["his"])
                open_ = np.zeros(upper.shape, dtype=bool)
                for w in range(lo.shape[1]):
                    open_ |= (upper >= lo[:, [w]]) & (lower <= hi[:, [w]])
                sent, bars = [], []
                for at in range(len(some)):
                    on = np.flatnonzero(open_[at])
                    bar = -np.inf
                    if first and len(on):
                        on = on[np.argsort(-upper[at, on], kind="stable")]
                        held = np.cumsum(np.minimum(known.sizes[numbers[on]], A_PART))
                        on = on[: 1 + int(np.searchsorted(held, GATHERED))]
                        bar, where = upper[at, on[-1]], places[heads[on]]
                    else:
                        where = places[np.repeat(open_[at], times)]
                    sent.append(np.unique(where))
                    bars.append(bar)
                out = some.assign(bar=bars).loc[some.index.repeat([len(x) for x in sent])]
                yield out.assign(shard=np.concatenate(sent))[["shard", "id", "label", "q", "los", "his", "bar"]]

    dealt = anchors.repartition(1 + anchors.count() // TOGETHER, "id")
    asked = dealt.mapInPandas(walk, f"shard int, id long, label long, q {kind}, los array<long>, his array<long>, bar double")
    nothing = F.lit(None).cast("array<long>")
    entries = rows.select("shard", F.lit(0).alias("asks"), "list", "id", "label", "q", nothing.alias("los"), nothing.alias("his"), F.lit(None).cast("double").alias("bar"))
    questions = asked.select("shard", F.lit(1).alias("asks"), F.lit(-1).alias("list"), "id", "label", "q", "los", "his", "bar")

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
                    yield from shard.best(some, k, same)

    streamed = entries.union(questions).repartition(lists.shards, "shard").sortWithinPartitions("shard", "asks")
    found = streamed.mapInPandas(find, "anchor long, window int, id long, score long")
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(rows: DataFrame, anchors: DataFrame, shared, k: int, same: bool) -> DataFrame:
    """(anchor, window, id, score, rank) of the k best rows for each window of the anchors."""
    once = _visit(rows, anchors, shared, k, same, first=True).filter(F.col("rank") == k)
    kth = once.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    raised = anchors.join(kth, "id", "left").withColumn("los", F.transform("los", lambda lo, w: F.greatest(lo, F.coalesce(F.col("kth")[w], lo))))
    return materialize(_visit(rows, materialize(raised.drop("kth")), shared, k, same, first=False))


def listed(spark: SparkSession, good: DataFrame) -> tuple[DataFrame, object]:
    """The rows good(id, label, q) with their list and shard, and what workers know of the lists."""
    n, width, largest = good.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()
    width, largest = width or 1, largest or 0
    if largest * largest * width >= NONE:
        raise ValueError(f"components of {largest} are too large for scores that fit a long")
    some = sample(good.select("id", F.col("q").alias("embedding")), "id", width, n)
    index = Lists(k_means(some, min(MOST_LISTS, max(1, int(n**0.5)))), np.zeros(0), np.zeros(0), 1, largest * largest * width < EXACT)
    centroids = index.centroids

    @F.pandas_udf("list int, far double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        x = matrix(vectors, width)
        number = nearest(x, centroids)
        return pd.DataFrame({"list": number.astype(np.int32), "far": np.linalg.norm(x - centroids[number], axis=1)})

    placed = materialize(good.select("id", "label", "q", place("q").alias("at")).select("id", "label", "q", "at.*"))
    known = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).toArrow()
    index.sizes, index.radii = np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids))
    index.sizes[known["list"].to_numpy()], index.radii[known["list"].to_numpy()] = known["n"].to_numpy(), known["r"].to_numpy()
    index.shards = max(1 + n * width // A_SHARD, min(SPREAD, 1 + n // TOGETHER))
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def shard_of(number: pd.Series, row: pd.Series) -> pd.Series:
        c, known = number.to_numpy().astype(np.int64), shared.value
        return pd.Series(known.shard(c, row.to_numpy() % known.parts(c)).astype(np.int32))

    spread = F.shiftrightunsigned(F.xxhash64("id"), 2)
    return materialize(placed.drop("far").withColumn("shard", shard_of("list", spread))), shared


def mine(
    spark: SparkSession, rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of
    rows(vec_id, embedding, label) for which the condition `anchors` holds. A negative's score is
    between low and high hundredths of the positive's."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    asks = F.coalesce(anchors, F.lit(False)).alias("asks")
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    numbered = usable.select(F.col("vec_id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("q"), asks).alias("row"))
    good = materialize(numbered.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*"))
    entries, shared = listed(spark, good.drop("asks"))
    asked = good.filter("asks").drop("asks")

    all_scores = asked.select("*", F.array(F.lit(-NONE + 1)).alias("los"), F.array(F.lit(NONE)).alias("his"))
    near = _search(entries, all_scores, shared, positives, same=True).select(
        F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    exact = F.col("positive_score").cast("decimal(30,0)")
    near = near.withColumn("lo", F.ceil(exact * low / 100).cast("long")).withColumn("hi", F.floor(exact * high / 100).cast("long"))
    windows = near.filter("lo <= hi").groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("w"))
    within = asked.join(windows, "id").select("id", "label", "q", F.col("w.lo").alias("los"), F.col("w.hi").alias("his"))
    within = materialize(within)
    found = _search(entries, within, shared, negatives, same=False)
    window = within.select(F.col("id").alias("anchor"), F.posexplode(F.arrays_zip("los", "his")).alias("window", "of"))
    best = found.join(window, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), F.col("of.los").alias("lo"), F.col("of.his").alias("hi"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return near.join(best, ["anchor_id", "lo", "hi"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
