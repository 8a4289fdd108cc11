"""Quality rules: lines that too many documents of a host share are removed, and documents that are
little else are rejected, after plain rules on words.

A line is what stands between line feeds; only lines with a word count. It is normalised (A-Z in lower
case, white space as one space between words; digits stay, or rows of numbers would look alike) and hashed (XXH64). Distinct documents are
counted by host and hash over all documents; a line goes where more than LEAST_DOCUMENTS and more than
PERCENT of its host's documents have it. A document of which fewer than LEFT_PERCENT of the words are
left is depleted.

One pass reads the texts and writes their counts and line hashes; all that follows works on these.
Documents are counted after map-side combining, by (host, line, document) first, so that neither a host
with a third of the documents nor a line that they all share gathers in a task. The lines above the
limits are written, and are broadcast by Spark only if that table is small; otherwise they are joined,
and the skew join splits common lines. Verdicts come back by a number of each row.

Edge cases: a null text has no words, lines or symbols, and fails the rule on words like an empty one;
documents with a null host are a host of their own; repeated rows of a doc_id are one document to the
counts and each get their verdict; rows without a doc_id are documents of their own; a text of any
length is read whole; an empty table gives an empty result; other columns are not looked at (clean()
returns them as they were).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import aside, back, materialize, release_memory, small_batches

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Rules on words; limits on lines; the share of its words that a document must keep.
LEAST_WORDS, REPEATED_PERCENT, LEAST_DOCUMENTS, PERCENT, LEFT_PERCENT = 50, 50, 10, 10, 50

_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_FACTS = ", ".join(f"{c} long" for c in _COUNTS) + ", line_keys array<long>, line_words array<int>"


def line_key(words: list[bytes]) -> int:
    """The hash of a normalised line, as a signed number."""
    h = xxhash.xxh64_intdigest(b" ".join(words).translate(_PLAIN))
    return h - (1 << 64) if h >> 63 else h


def repeated(words: list[bytes], window: int = 3) -> int:
    """How many words lie in windows that are found twice or more, first ones included."""
    if len(words) < window + 1:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    keys = ids[: len(ids) - window + 1]
    for k in range(1, window):  # each step numbers the longer windows anew, so that products fit
        keys = np.unique(keys, return_inverse=True)[1] * len(numbers) + ids[k : len(ids) - window + 1 + k]
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    often, covered = times[which] > 1, np.zeros(len(ids), dtype=bool)
    for k in range(window):
        covered[k : len(ids) - window + 1 + k] |= often
    return int(covered.sum())


def facts_of(text: str | None) -> tuple:
    """The five counts of a text, and the hash and number of words of each of its lines."""
    data = (text or "").encode()
    words, keys, sizes, seen, again = [], [], [], set(), 0
    for line in data.split(b"\n"):
        own = line.split()  # of bytes: at spaces and the control characters tab to carriage return
        if own:
            again += line in seen
            seen.add(line)
            keys.append(line_key(own))
            sizes.append(len(own))
            words += own
    chars = len(text or "") - (len(data) - len(data.translate(None, SPACE)))
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), again, repeated(words), keys, sizes


def _host(host: str) -> Column:
    return F.xxhash64(F.col(host).isNull(), F.col(host).cast("string"))


def facts(docs: DataFrame, host: str, *more: str) -> DataFrame:
    """A written table: row_ (a number of its own for each row), doc_id, host_, the columns of more, and what facts_of() finds."""

    @F.pandas_udf(_FACTS)
    def found(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([facts_of(t) for t in texts], columns=[*_COUNTS, "line_keys", "line_words"])
        release_memory()
        return out

    small_batches(docs.sparkSession)
    of = docs.select("doc_id", _host(host).alias("host_"), *more, found("text").alias("found"))
    return materialize(of.select(F.monotonically_increasing_id().alias("row_"), "doc_id", "host_", *more, "found.*"))


def frequent_lines(known: DataFrame, least_documents: int = LEAST_DOCUMENTS, percent: int = PERCENT) -> DataFrame:
    """(host_, key) of the lines above the limits, a written table."""
    # A document is its doc_id, or its row where it has none.
    document = ["doc_id", F.when(F.col("doc_id").isNull(), F.col("row_")).alias("lone")]
    held = known.select("host_", *document, F.explode(F.array_distinct("line_keys")).alias("key")).distinct()
    counts = held.groupBy("host_", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_documents)
    hosts = known.filter(F.size("line_keys") > 0).select("host_", *document).distinct().groupBy("host_").agg(F.count(F.lit(1)).alias("docs"))
    return materialize(counts.join(hosts, "host_").filter(F.col("n") * 100 > F.col("docs") * percent).select("host_", "key"))


def removals(known: DataFrame, frequent: DataFrame) -> DataFrame:
    """By row_: how many lines and words go, and the hashes of these lines."""
    lines = known.select("row_", "host_", F.explode(F.arrays_zip("line_keys", "line_words")).alias("line"))
    lines = lines.select("row_", "host_", F.col("line.line_keys").alias("key"), F.col("line.line_words").alias("words"))
    # A row's lines all come from its own text, so that what is collected is bounded by it.
    return lines.join(frequent, ["host_", "key"]).groupBy("row_").agg(
        F.count(F.lit(1)).alias("n_lines_removed"), F.sum("words").alias("n_words_removed"), F.collect_set("key").alias("removed_")
    )


def _judged(known: DataFrame, gone: DataFrame, left_percent: int) -> DataFrame:
    none = F.lit(0).cast("long")
    out = known.join(gone, "row_", "left").withColumns({c: F.coalesce(c, none) for c in ("n_lines_removed", "n_words_removed")})
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    depleted = (F.col("n_words") - F.col("n_words_removed")) * 100 < F.col("n_words") * left_percent
    return out.withColumns({"base_failed": failed, "depleted": depleted, "kept": ~failed & ~depleted, "n_lines": F.size("line_keys").cast("long")})


def verdicts(
    docs: DataFrame, host: str = "source", least_documents: int = LEAST_DOCUMENTS, percent: int = PERCENT, left_percent: int = LEFT_PERCENT
) -> DataFrame:
    """One row per row of docs(doc_id, text, host): the counts, base_failed, kept, and what the lines did to it."""
    known = facts(docs, host)
    gone = removals(known, frequent_lines(known, least_documents, percent)).drop("removed_")
    return _judged(known, gone, left_percent).select("doc_id", *_COUNTS, "base_failed", "kept", "n_lines", "n_lines_removed", "n_words_removed", "depleted")


def clean(
    docs: DataFrame, host: str = "source", least_documents: int = LEAST_DOCUMENTS, percent: int = PERCENT, left_percent: int = LEFT_PERCENT
) -> DataFrame:
    """The rows of docs that are kept, with their columns; lines above the limits are gone from the texts."""
    apart = aside(docs, "doc_id", "text", host)
    known = facts(apart, host, *[f"`in_{c}`" for c in docs.columns], "text")
    judged = _judged(known, removals(known, frequent_lines(known, least_documents, percent)), left_percent).filter("kept")

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([_without(t, set(r)) for t, r in zip(texts, removed, strict=True)], dtype=object)

    text = F.when(F.col("n_lines_removed") == 0, F.col("text")).otherwise(without("text", F.coalesce("removed_", F.array().cast("array<long>"))))
    return back(judged.withColumn("text", text), docs.columns, text=F.col("text"))


def _without(text: str | None, removed: set[int]) -> str | None:
    if text is None or not removed:
        return text
    return "\n".join(line for line in text.split("\n") if not (own := line.encode().split()) or line_key(own) not in removed)
