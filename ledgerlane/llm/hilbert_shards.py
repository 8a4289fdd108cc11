"""Sharding along a Hilbert curve.

Several metadata dimensions (source, language, size, doc_id) are quantised to a few bits each; the
cell's index on the Hilbert curve orders the rows, and equal runs of that order become shards, so that
each shard covers a compact region of all dimensions at once.

A dimension is cut where its rows are, at its quantiles over all rows, so that ids with gaps and long
tails of sizes spread over all cells. Names are cut by the quantiles of their hashes: one that holds a
cell's share of all rows shares its cell at most with rare ones. There are 16 cells a shard or more.

The order is never sorted in one place: cells are counted (some hundreds a shard at most), counts are
summed along the curve, and rows are ranked within salted parts of their cell. Shards are cut by the law
`rows`: counts differ by one at most.

Edge cases: a null text has size 1; null names have a hash of their own, a null doc_id counts as the
smallest; repeated rows get slots of their own; an empty table gives an empty result; with fewer rows
than shards some shards stay empty; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerlane.llm.common import grouped_rank, materialize, salts_for

DIMENSIONS, LEAST_BITS = ("source_", "lang_", "size", "id_"), 4


def bits_for(n_shards: int) -> int:
    """Bits a dimension, for 16 cells a shard or more."""
    return max(LEAST_BITS, -(-((n_shards - 1).bit_length() + 4) // len(DIMENSIONS)))


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (n x d integers below 2^bits), by undoing the curve's
    rotations from the top bit down and Gray-coding what is left."""
    x = [c.astype(np.int64) for c in np.asarray(points).T]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = (index << 1) | (((c ^ turn) >> b) & 1)
    return index


def curve(cuts: list[list[int]], bits: int) -> Column:
    """The Hilbert index of a row, each of DIMENSIONS quantised at its cuts (ascending, 2^bits - 1 of them)."""
    edges = [np.array(c, dtype=np.int64) for c in cuts]

    @F.pandas_udf(LongType())
    def index(point: pd.DataFrame) -> pd.Series:
        cells = [np.searchsorted(e, point[d].to_numpy()) for e, d in zip(edges, DIMENSIONS, strict=True)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return index(F.struct(*DIMENSIONS))


def shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("source").alias("source_"), F.xxhash64("lang").alias("lang_"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id_"),
        )
    )
    bits = bits_for(n_shards)
    cells = 1 << bits
    at = F.lit([i / cells for i in range(1, cells)])
    n, *cuts = rows.agg(F.count(F.lit(1)), *[F.percentile_approx(d, at, max(10_000, 16 * cells)) for d in DIMENSIONS]).first()
    index = curve([c or [] for c in cuts], bits)
    placed = materialize(rows.select("doc_id", "size", "text_crc32", index.alias("cell_")))
    ranked = grouped_rank(placed, [], ["cell_"], ["doc_id", "text_crc32", "size"], salts_for(n))
    shard = F.expr(f"cast((rank_ * {n_shards}L) div {max(n, 1)}L as int)")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank_ - ((shard * {n}L + {n_shards - 1}L) div {n_shards}L)").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
