"""Mixing sources to target weights by systematic sampling.

Size is a text's number of words. Targets share the corpus's size by the sources' weights, are capped
at 3 times a source's own size, and the excess goes to the others by weight (water-filling, in closed
form over a window of the sources). Within a source every document expects target / size copies;
documents stand in order of size, the expected copies are prefix-summed, one random offset a source
is added, and a document is emitted once for each integer that its stretch crosses. Every document is
thus taken target / size times on average over the seeds. Since like sizes stand together, the words
taken of a source stay within about its longest document of the target.

The prefix sum needs a document's rank in its source. It is found from counts per size class and
ranks within salted parts of a class, so a source that holds most rows is spread over many tasks.

Edge cases: a null or blank text has size 0 and may be taken without adding words; a null source is a
source of its own, last in order; a source of size 0 has target 0; repeated rows count one by one; an
empty table gives an empty result; reruns agree, as the offset is a hash of seed and source. Sources
are metadata: their table is counted with a map-side combine and ordered in one small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import WORD, aside, back, grouped_rank, materialize, salts_for

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 42


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))


def targets(sized: DataFrame) -> DataFrame:
    """(source_key_, source_size, target) from sized(source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sources.withColumn("nth_", (F.row_number().over(in_order) - 1) % len(WEIGHTS)).withColumn(
        "weight_", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("nth_") + 1).cast("double")
    )
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("source_size") / F.col("weight_"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # The level that uncapped sources get per weight: sources are capped from the tightest on, and
    # the level rises while capping is right and falls afterwards, so it is the largest of them.
    level = (F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight_").over(everything) - F.coalesce(F.sum("weight_").over(before), F.lit(0.0))
    )
    return weighed.withColumn("level_", level).withColumn("level_", F.max("level_").over(everything)).select(
        _key().alias("source_key_"), "source_size",
        F.least(F.col("source_size") * float(MOST), F.col("level_") * F.col("weight_")).alias("target"),
    )


def _crossed(start: Column) -> Column:
    """Integer boundaries in a document's stretch."""
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("rank_") + 1) * each + start) - F.floor(F.col("rank_") * each + start)
    return F.least(crossed, F.lit(MOST)).cast("long")


def _ranked(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    keyed = rows.withColumn("source_key_", _key()).withColumn("class_", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
    return grouped_rank(keyed, ["source_key_"], ["class_"], ["doc_id", "size"], salts_for(n), known)


def offset(seed: int) -> Column:
    """The random start of a source, from 0 to below 1."""
    return F.pmod(F.xxhash64(F.lit(seed), "source_key_"), F.lit(1 << 40)) / float(1 << 40)


def planned(rows: DataFrame, narrow: DataFrame, seed: int = SEED) -> DataFrame:
    """rows(doc_id, source, size, ...) with source_size, target and copies; narrow holds the same
    rows with these three columns only, materialized."""
    known = materialize(targets(narrow).withColumn("start_", offset(seed)))
    ranked = _ranked(rows, known, narrow.count())
    return ranked.withColumn("copies", _crossed(F.col("start_"))).drop("source_key_", "class_", "start_", "rank_")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def _narrow(docs: DataFrame) -> DataFrame:
    return materialize(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"))


def mix_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    narrow = _narrow(docs)
    return planned(narrow, narrow, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture: docs, same columns, each row as often as it is taken."""
    rows = sized(aside(docs, "doc_id", "source", "text")).drop("text")
    plan = planned(rows, _narrow(docs), seed)
    often = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return back(plan.filter("copies > 0").withColumn("nth_", often), docs.columns)
