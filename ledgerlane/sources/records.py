"""CSV records that span lines, read by many tasks.

A line feed in a quoted field ends a line but not a record, so a reader that starts in the middle of a
file cannot know which of the two it sees. Here every split of a file (Spark's scan of lines knows where
each line's split begins) first tells how it would end if it began outside and if it began inside a
quoted field: two states, whose mappings compose. Composed from the first split on, they give
each split its true beginning. Then each split cuts its lines into records on its own, and only the
pieces of records that cross a split's end meet, two or so a split.

The splits' states are on the driver: a few numbers per split, so per 128 MB of input. Records are
written once to the shared folder, so that later jobs do not depend on how files are split then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.sources.scratch import materialize

#: A quoted field up to its comma, any field, and a line whose quoted fields all end.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rf'(?:{_QUOTED}|[^",][^,]*+|)'
CLOSED = rf"\A{_FIELD}(?:,{_FIELD})*+\z"

_LINE = re.compile(rf"{_FIELD}(?:,{_FIELD})*+")
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+(,?)')

CSV = {"quote": '"', "escape": '"'}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line."""
    if '"' not in line:
        return inside
    if inside:
        closed = _REST.match(line)
        if not closed:
            return True
        if not closed[1]:
            return False
        line = line[closed.end() :]
    return not _LINE.fullmatch(line)


def plain_path(path: str) -> str:
    """A path with one slash after file:, as listings and metadata write it differently."""
    return re.sub("^file:/+", "file:/", path)


def path_of_row() -> Column:
    """The file that a row of a scan comes from, as plain_path() writes it."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, path, file (its hash) and start (of the split) of every line."""
    read = spark.read.text(paths, lineSep="\n")
    path = path_of_row()
    return read.select("value", path.alias("path"), F.xxhash64(path).alias("file"), F.col("_metadata.file_block_start").alias("start"))


def span_lines(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether a record of these files may span lines: a line, read from its beginning, leaves a quoted field open."""
    quoted = lines(spark, paths).select("value").filter(F.col("value").contains('"'))
    return not quoted.filter(~F.col("value").rlike(CLOSED)).limit(1).isEmpty()


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """(file, start) and lines, in order; a split may come in several."""
    for batch in batches:
        keys = batch[["file", "start"]].to_numpy()
        cuts = [0, *(k for k in range(1, len(keys)) if (keys[k] != keys[k - 1]).any()), len(keys)] if len(keys) else [0]
        values = batch["value"].tolist()
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield (int(keys[s][0]), int(keys[s][1])), values[s:e]


def _tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By split: whether it ends inside a quoted field if it begins outside, if it begins inside, and
    whether in the latter case any record ends in it."""
    found: dict = {}
    for key, values in _runs(batches):
        out, in_, ends = found.get(key, (False, True, False))
        for line in values:
            if '"' in line:
                out, in_ = ends_inside(line, out), ends_inside(line, in_)
                ends |= not in_
        found[key] = (out, in_, ends)
    yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["file", "start", "from_out", "from_in", "ends"])


def beginnings(told: list[tuple]) -> dict[tuple[int, int], tuple[bool, int]]:
    """By (file, start): whether the split begins inside a record, and in which split that began."""
    out, now, inside, owner = {}, None, False, -1
    for file, start, from_out, from_in, ends in sorted(told):
        if file != now:
            now, inside, owner = file, False, -1
        out[file, start] = (inside, owner)
        if not inside or ends:
            inside = from_in if inside else from_out
            owner = start if inside else -1
    return out


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and record (its text, without header records and blank ones) of CSV files."""
    read = lines(spark, paths)
    told = read.select("file", "start", "value").mapInPandas(_tell, "file long, start long, from_out boolean, from_in boolean, ends boolean")
    known = beginnings([tuple(r) for r in told.collect()])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(file, owner, place, record, first): whole records without an owner, pieces of others with the
        split in which theirs began; first where it is a file's first."""
        at, held, inside, owner, first, out = None, [], False, -1, False, []

        def ended(whole: bool) -> None:
            nonlocal held, owner, first
            text = "\n".join(held)
            if not whole or owner >= 0 or text.strip():
                mine = owner if owner >= 0 else at[1] if not whole else None
                out.append((at[0], mine, at[1], text, first and owner < 0))
                first = first and owner >= 0
            held, owner = [], -1

        for key, values in _runs(batches):
            if key != at:
                if held:
                    ended(whole=False)
                if key not in known:
                    raise RuntimeError("the files' splits have changed while they were read; read them again")
                at, (inside, owner) = key, known[key]
                first = key[1] == 0
            for line in values:
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    ended(whole=True)
            if out:
                yield pd.DataFrame(out, columns=["file", "owner", "place", "record", "first"]).astype({"owner": "Int64"})
                out = []
        if held:
            ended(whole=False)
        if out:
            yield pd.DataFrame(out, columns=["file", "owner", "place", "record", "first"]).astype({"owner": "Int64"})

    parts = materialize(read.select("file", "start", "value").mapInPandas(cut, "file long, owner long, place long, record string, first boolean"))
    pieces = parts.filter("owner is not null").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("place", "record"))).alias("pieces"), F.bool_or("first").alias("first")
    )
    joined = pieces.select("file", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"), "first")
    names = read.select("file", "path").distinct()
    whole = parts.filter("owner is null").select("file", "record", "first").union(joined)
    return whole.filter("not first").join(F.broadcast(names), "file").select("path", F.regexp_replace("record", "\r$", "").alias("record"))


def read_spanning(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The columns of such files as text, and path_. Headers are read from the first file."""
    names = spark.read.csv(paths, header=True, inferSchema=False, multiLine=True, **CSV).columns
    fields = ", ".join(f"c{k} string" for k in range(len(names)))
    rows = read_records(spark, paths).select("path", F.from_csv("record", fields, {**CSV, "multiLine": "true"}).alias("row"))
    return rows.select("row.*", F.col("path").alias("path_")).toDF(*names, "path_")
