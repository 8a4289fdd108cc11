"""What several operators share: scratch tables, distributed ranks, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.sources.scratch import clear_scratch, folder, materialize, scratch  # noqa: F401

#: An ASCII word: what lies between spaces and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_BLOCK = 256

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots(texts: list[str | None], most: int) -> list[list[int]]:
    """The numbers of the texts, shorter ones first, in lots of about `most` characters (or one text),
    so that what is held at a time is bounded and texts of one lot are about as long."""
    out, chars = [[]], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k] or "")):
        if chars >= most:
            out.append([])
            chars = 0
        out[-1].append(k)
        chars += len(texts[k] or "")
    return out


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers 1,000 at a time, where the session doesn't say otherwise: batches of
    Spark's own 10,000 stand several times in the memory of an executor and of its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def release_memory() -> None:
    """Hands freed memory back to the system. A Python worker outlives its task, and what its
    allocators keep would stand beside the next stage's own needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def aside(df: DataFrame, *needed: str) -> DataFrame:
    """df with every column renamed in_<name>, and the needed ones again under their own names, so that
    working columns cannot clash with what the input brings along."""
    return df.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in df.columns], *needed)


def back(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that aside() renamed, under their first names; those in new replaced."""
    return df.select(*[new.get(c, F.col(f"`in_{c}`")).alias(c) for c in columns])


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def salts_for(rows: int) -> int:
    """Into how many parts grouped_rank() should split a bucket: one per 4,000 rows, 2^16 at most."""
    return min(1 << 16, 1 + rows // 4_000)


def grouped_rank(
    df: DataFrame, group: list[str], bucket: list[str], tie: list[str], salts: int, known: DataFrame | None = None
) -> DataFrame:
    """Adds `rank_` (long, from 0) of each row in its group: by bucket, then salt, then tie.

    No task holds a whole group: rows are ranked within (group, bucket, salt) only, and offsets come
    from cumulative sums over counts, of which a window holds a group's buckets or a bucket's salts.
    Group and bucket columns must not be null. `known` may hold further columns by group, which then
    come along. df is read twice: pass something cheap or materialized.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, *bucket, "salt_"]
    salted = df.withColumn("salt_", F.pmod(F.xxhash64(*tie), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    buckets = parts.groupBy(*group, *bucket).agg(F.sum("n_").alias("n_"))
    first = F.coalesce(F.sum("n_").over(earlier(Window.partitionBy(*group).orderBy(*bucket))), F.lit(0))
    buckets = buckets.withColumn("first_", first).drop("n_")
    if known is not None:
        buckets = buckets.join(known, group)
    inside = F.coalesce(F.sum("n_").over(earlier(Window.partitionBy(*group, *bucket).orderBy("salt_"))), F.lit(0))
    offsets = (
        parts.withColumn("inside_", inside).join(buckets, [*group, *bucket])
        .withColumn("offset_", F.col("first_") + F.col("inside_")).drop("n_", "inside_", "first_")
    )
    own = Window.partitionBy(*keys).orderBy(*tie)
    return (
        salted.withColumn("in_", F.row_number().over(own) - 1)
        .join(offsets, keys)
        .withColumn("rank_", (F.col("offset_") + F.col("in_")).cast("long"))
        .drop("salt_", "offset_", "in_")
    )


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """For n values, the n + 1 results of start and the first 0, 1, ... of them under an associative
    step, in blocks of _BLOCK, so that appending stays cheap. values must be a column, not an
    expression: a lambda reads it."""

    def over(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda a, x: F.array_append(a, step(F.element_at(a, -1), x)))

    count = F.ceil(F.size(values) / _BLOCK).cast("int")
    blocks = F.when(F.size(values) == 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    )
    starts = over(F.transform(blocks, lambda b: F.aggregate(b, start, step)), start)
    inner = F.zip_with(blocks, F.slice(starts, 1, F.greatest(count, F.lit(0))), lambda b, s: F.slice(over(b, s), 2, _BLOCK))
    return F.concat(F.array(start), F.flatten(inner))


def running_sums(lengths: Column) -> Column:
    """For n lengths, the n + 1 sums of the first 0, 1, ... of them."""
    return running(lengths, lambda a, x: a + x, F.lit(0))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges(a, b), both long; component is the smallest id reachable.

    Alternating large-star and small-star rounds, each a join and an aggregation with map-side
    combine, written to the shared folder; hubs are spread by the adaptive skew join, and nothing
    but one count and one checksum comes to the driver.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.select(hi.alias("hi"), lo.alias("lo")).filter("hi <> lo").distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("hi", "lo"), 20))).first()
        if tuple(mark) == seen or not mark[0]:
            return (
                now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
                .union(now.select(F.col("lo"), F.col("lo")))
                .distinct()
            )
        seen = tuple(mark)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        )
        large = materialize(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        )
        now = materialize(small)
    raise RuntimeError("components did not settle")
