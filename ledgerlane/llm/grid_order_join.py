"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so cosine >= 0.95 is a Euclidean join with a radius
epsilon. Vectors are turned to their leading principal dimensions (fitted on a bounded sample; any
rotation keeps distances, so only speed depends on it), ordered lexicographically by their cells of
side epsilon, and cut into blocks of neighbouring rows. Two blocks whose boxes in the leading
dimensions are farther apart than epsilon are never joined. A pair of blocks is one task, which
halves the two intervals again and again, skips halves that are provably too far apart, and compares
the rest by dot products in double precision.

Equal vectors are one row of the join, whatever their number. A task returns at most one row per
vector: how many links it found, and a link that leads to its component's first vector there. Nothing
emits the pairs of a group.

Edge cases: vectors that are null, zero or hold null or non-finite components, and rows without a
vec_id, link with nothing (component and kept follow from vec_id); equal vectors are links of each
other; rows that share a vec_id are vectors of their own, each with its links and component; shorter vectors are padded with zeros; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import connected_components, materialize
from ledgerlane.llm.vectors import matrix, sample, usable

LEADING, BLOCK, LEAF = 6, 4096, 256
#: Of many vectors a block holds up to this many numbers, as soon as there would be this many blocks: a
#: block is copied to each of its partners, so that larger blocks make fewer copies of each vector.
MOST_NUMBERS, BLOCKS = 2 << 20, 64
#: Pairs of blocks are looked up by cells of this many leading dimensions, of this side at least.
KEYED, SIDE = 3, 0.125


def join_intervals(x: np.ndarray, p: np.ndarray, y: np.ndarray | None, q: np.ndarray | None, least: float, radius: float):
    """Yields (rows, columns, mask) of compared leaves of x and y (None: x with itself, each pair
    once), rows in grid order; p and q hold the leading dimensions."""
    same = y is None
    y, q = (x, p) if same else (y, q)
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d or same and c < a:
            continue
        if (a, b) != (c, d) or not same:
            gap = np.maximum(p[a:b].min(0) - q[c:d].max(0), q[c:d].min(0) - p[a:b].max(0))
            if np.square(np.maximum(gap, 0)).sum() > radius * radius:
                continue
        if b - a <= LEAF and d - c <= LEAF:
            mask = x[a:b] @ y[c:d].T >= least
            if same and a == c:
                mask &= np.triu(np.ones(mask.shape, dtype=bool), 1)
            if mask.any():
                yield a, c, mask
            continue
        i, j = (a + b + 1) // 2, (c + d + 1) // 2
        left = [(a, i), (i, b)] if b - a > LEAF else [(a, b)]
        right = [(c, j), (j, d)] if d - c > LEAF else [(c, d)]
        stack += [(*s, *t) for s in left for t in right]


class _Roots:
    """Smallest member of each set of 0..n-1, merged by arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            u, v = self.of[i], self.of[j]
            apart = u != v
            i, j = i[apart], j[apart]
            np.minimum.at(self.of, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
            while (up := self.of[self.of]) is not None and (up != self.of).any():
                self.of = up


def _joined(left: pd.DataFrame, right: pd.DataFrame, width: int, least: float, radius: float) -> pd.DataFrame:
    """links and root of the vectors of one pair of blocks (right empty: a block with itself)."""
    both = [f.sort_values([*[f"c{k}" for k in range(LEADING)], "p0", "rep"]) for f in (left, right)]
    units, points = [], []
    for f in both:
        m = matrix(f["embedding"], width)
        units.append(m / np.linalg.norm(m, axis=1, keepdims=True))
        points.append(f[[f"p{k}" for k in range(LEADING)]].to_numpy())
    n, own = len(both[0]), not len(both[1])
    rep = np.concatenate([f["rep"].to_numpy() for f in both])
    copies = np.concatenate([f["copies"].to_numpy() for f in both]).astype(np.int64)
    links, roots = np.zeros(len(rep), dtype=np.int64), _Roots(len(rep))
    shift = 0 if own else n
    for a, c, mask in join_intervals(units[0], points[0], None if own else units[1], None if own else points[1], least, radius):
        i, j = np.nonzero(mask)
        i, j = i + a, j + c + shift
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        roots.merge(i, j)
    on = links > 0
    return pd.DataFrame({"rep": rep[on], "links": links[on], "root": rep[roots.of[on]]})


def near_duplicates(spark: SparkSession, rows: DataFrame, least: float = 0.95) -> DataFrame:
    """One row per row of rows(vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = rows.select("vec_id", "embedding")
    good = rows.filter(usable() & F.col("vec_id").isNotNull())
    # A class has a number of its own: two classes may have the same smallest vec_id.
    counted = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(counted.withColumn("rep", F.monotonically_increasing_id()))
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    found = _links(classes, n, width or 1, least)
    linked = materialize(found)
    component = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    least_id = component.join(classes, "rep").groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = component.join(least_id, "component").select("rep", "least_id")
    totals = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        classes.join(totals, "rep", "left").join(named, "rep", "left")
        .select(
            F.col("embedding").alias("known_"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links_"), F.coalesce("least_id", "first_id").alias("component_"),
        )
    )
    out = rows.join(known, rows["embedding"] == known["known_"], "left")
    own = F.when(F.col("vec_id").isNotNull(), F.col("component_"))
    return out.select(
        "vec_id", F.when(own.isNotNull(), F.col("links_")).otherwise(0).cast("long").alias("n_links"),
        F.coalesce(own, "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(classes: DataFrame, n: int, width: int, least: float) -> DataFrame:
    """(rep, links, root) per vector and pair of blocks in which it has links."""
    radius = float(np.sqrt(2 - 2 * least)) + 1e-9
    some = sample(classes, "first_id", width, n)
    some = some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-300)
    mean = some.mean(axis=0) if len(some) else np.zeros(width)
    centred = some - mean
    turn = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :LEADING]
    turn = np.pad(turn, ((0, 0), (0, LEADING - turn.shape[1])))

    block = max(BLOCK, min(MOST_NUMBERS // width, n // BLOCKS))
    names = [f"c{k}" for k in range(LEADING)] + [f"p{k}" for k in range(LEADING)]

    @F.pandas_udf(", ".join(f"{x} {'int' if x[0] == 'c' else 'double'}" for x in names))
    def place(vectors: pd.Series) -> pd.DataFrame:
        m = matrix(vectors, width)
        p = (m / np.linalg.norm(m, axis=1, keepdims=True) - mean) @ turn
        return pd.DataFrame(np.hstack([np.floor(p / radius), p]), columns=names).astype({x: "int32" for x in names[:LEADING]})

    placed = classes.select("rep", "copies", "embedding", place("embedding").alias("at")).select("rep", "copies", "embedding", "at.*")
    order = [*names[:LEADING], "p0", "rep"]
    parts = materialize(placed.repartitionByRange(1 + n // block, *order).withColumn("part", F.spark_partition_id()))
    # Neighbouring parts that are small become one block.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), *[f(f"p{k}").alias(f"{s}{k}") for k in range(LEADING) for s, f in (("lo", F.min), ("hi", F.max))]
    ).withColumn("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block))
    of = materialize(blocks)
    boxes = of.groupBy("block").agg(*[f(f"{s}{k}").alias(f"{s}{k}") for k in range(LEADING) for s, f in (("lo", F.min), ("hi", F.max))])
    inside = parts.join(of.select("part", "block"), "part").drop("part")

    # Pairs of blocks: equi-joined on the cells of the leading dimensions that either reaches, then by
    # box. Two blocks that share many cells meet in the first one only.
    side, cells = max(radius, SIDE), [f"cell{k}" for k in range(KEYED)]

    def reached(tag: str, margin: float) -> DataFrame:
        out = boxes.select(*[F.col(c).alias(f"{tag}_{c}") for c in boxes.columns])
        for k in range(KEYED):
            out = out.withColumn(f"{tag}_first{k}", F.floor((F.col(f"{tag}_lo{k}") - margin) / side))
            last = F.floor((F.col(f"{tag}_hi{k}") + margin) / side)
            out = out.withColumn(f"cell{k}", F.explode(F.sequence(f"{tag}_first{k}", last)))
        return out

    a, b = reached("a", 0.0), reached("b", radius)
    first = [F.col(c) == F.greatest(f"a_first{k}", f"b_first{k}") for k, c in enumerate(cells)]
    gap = sum(
        F.pow(F.greatest(F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.lit(0.0)), F.lit(2))
        for k in range(LEADING)
    )
    pairs = materialize(
        a.join(b, cells).filter((F.col("a_block") <= F.col("b_block")) & reduce(and_, first) & (gap <= radius * radius)).select("a_block", "b_block")
    )

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _joined(left, right, width, least, radius)

    lefts = inside.withColumnRenamed("block", "a_block").join(pairs, "a_block")
    rights = inside.withColumnRenamed("block", "b_block").join(pairs, "b_block").filter("a_block <> b_block")
    rights = rights.select(*[F.col(c).alias(c) for c in rights.columns])  # columns of their own
    return lefts.groupBy("a_block", "b_block").cogroup(rights.groupBy("a_block", "b_block")).applyInPandas(join, "rep long, links long, root long")
