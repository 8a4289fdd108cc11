"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint becomes the vector of the bit counts of its 16 four-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so every pair
within 2 bits lies within distance 2 on the grid. Two grid points at distance 2 or less have a point
within distance 1 of both; each fingerprint is therefore dealt to its own cell and its at most 32
neighbour cells, cells are equi-joined, and each pair that meets is verified exactly.

Only distinct fingerprints are joined: copies share one row whatever their number, and a fingerprint
has at most 2,080 others within 2 bits, so links stay linear in the distinct fingerprints.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other; fewer than
three words hash as one sequence; repeated rows share a fingerprint and a component; a null doc_id is
ignored for the smallest id (a component of null ids only has a null id); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerlane.llm.common import aside, back, connected_components, materialize, release_memory

WORDS, SEED, MAX_BITS, SEGMENTS = 3, 42, 2, 16
_CHUNK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    shingles = zip(*(words[i:] for i in range(WORDS)), strict=False) if len(words) >= WORDS else iter([words])
    ones, n = np.zeros(64, dtype=np.int64), 0
    while chunk := [hashed(s) for s in map(b" ".join, islice(shingles, _CHUNK))]:
        h = np.array(chunk, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(h, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
        n += len(chunk)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint_of(x) for x in batch], dtype=np.uint64).view(np.int64))
        release_memory()


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """The signed 64-bit pattern of each text's fingerprint."""
    return _fingerprints(docs[text])


def _grid_key() -> Column:
    """Bit counts (0 to 4) of the 16 four-bit segments of fp, each in its own four bits."""
    counts = [f"shiftleft(cast(bit_count(shiftrightunsigned(fp, {i}) & 15L) as long), {i})" for i in range(0, 64, 4)]
    return F.expr(" | ".join(counts))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints `fp` that differ in 1 or 2 bits."""
    steps = []
    for i in range(SEGMENTS):
        count, one = f"(shiftrightunsigned(key, {4 * i}) & 15L)", f"shiftleft(1L, {4 * i})"
        steps += [f"if({count} < 4, key + {one}, null)", f"if({count} > 0, key - {one}, null)"]
    cells = (
        distinct.select("fp", _grid_key().alias("key"))
        .select("fp", "key", F.explode(F.filter(F.expr(f"array(key, {', '.join(steps)})"), lambda c: c.isNotNull())).alias("cell"))
    )
    a, b = cells.toDF("a", "key_a", "cell"), cells.toDF("b", "key_b", "cell")
    met = a.join(b, "cell").filter(
        (F.col("a") < F.col("b"))
        & ((F.col("key_a") != F.col("key_b")) | (F.col("cell") == F.col("key_a")))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    )
    return met.select("a", "b").distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for prints(doc_id, fp): the smallest doc_id reachable over links."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = connected_components(links(classes))
    grouped = classes.join(linked, classes["fp"] == linked["id"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("group_")
    )
    least = grouped.groupBy("group_").agg(F.min("first_id").alias("component_id"))
    return grouped.join(least, "group_").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(docs.select("doc_id", fingerprints(docs).alias("fp")))
    return prints.join(components(prints), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row left of each component: that of the smallest doc_id (null last), of one
    doc_id that of the smallest text hash, of repeated rows any one. All columns stay."""
    prints = materialize(
        docs.select("doc_id", F.xxhash64("text").alias("hash_"), fingerprints(docs).alias("fp"))
    )
    # Kept ids are found per component, not per fingerprint, with a map-side combine.
    classes = materialize(
        prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "hash_")).alias("best"))
    )
    linked = connected_components(links(classes))
    winners = (
        classes.join(linked, classes["fp"] == linked["id"], "left")
        .groupBy(F.coalesce("component", "fp").alias("group_"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.doc_id").alias("id_"), F.col("best.hash_").alias("hash_"))
        .distinct()
    )
    # Distinct texts under one null id keep their own hash, so the pair tells rows apart.
    rows = aside(docs, "doc_id", F.xxhash64("text").alias("row_hash_"))
    kept = rows.join(winners, (F.col("row_hash_") == F.col("hash_")) & F.col("doc_id").eqNullSafe(F.col("id_")))
    one = Window.partitionBy("row_hash_", "doc_id").orderBy("row_hash_")
    return back(kept.withColumn("nth_", F.row_number().over(one)).filter("nth_ = 1"), docs.columns)
