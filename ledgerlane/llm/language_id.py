"""Language identification of mixed text.

Training counts hashed character trigrams of words (with their borders) per language over all labelled
rows, and the scripts that each language is written in. To label a text, every word's script narrows
the languages to those that use it, its trigrams give a log-likelihood per language, and Viterbi with
a penalty for switching finds the most likely language of each word; runs of one language are spans.
The text's language is the one with most letters; its score is the share of letters that got it. Its
fit tells whether the text looks like that language at all: how far the mean log-likelihood of its
words' trigrams lies above the middle between that of all labelled rows of the language and that of
the nearest other one (or of random trigrams), in standard errors; far below 0 is no known language.
No word counts for less than WORST standard deviations a letter, so that a key or an address in a
short text doesn't outweigh its words.

The model is a table of languages x 2^15 counts, so what comes to the driver and goes to the workers
is bounded by the number of languages. Viterbi advances many texts together, position by position.

Edge cases: a null text or one without letters is `und` with score and fit 0; words of a script that
no language uses count for none, so a text of such words alone has score 0 and no span; without any training row every text is `und`; ties go to the first
language by code; null labels are not learned from; repeated rows count as often as they occur; very
long texts are read whole; input columns stay, but one with the name of an output is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import lots, release_memory, small_batches

UNKNOWN = "und"
BUCKET_BITS, SMOOTHING, SWITCH, SCRIPT_SHARE = 15, 0.5, 8.0, 0.01
WORST = 1.5
#: Languages that a model may have.
MOST_LANGS = 400
#: Characters of text labelled together, and characters whose trigrams are looked up together.
_TOGETHER, _ABREAST = 1 << 20, 1 << 19
#: Words of a chunk, all of which are labelled abreast.
_CHUNK = 256

#: First code points of ranges, and the script of each (0: letters of no listed script).
SCRIPT_RANGES = (
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0900, 7), (0x0980, 8),
    (0x0A00, 0), (0x0B80, 9), (0x0C00, 10), (0x0C80, 0), (0x0E00, 11), (0x0E80, 0), (0x10A0, 12), (0x1100, 13), (0x1200, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0), (0x3400, 15), (0xA000, 0), (0xAC00, 13), (0xD7B0, 0),
    (0xF900, 15), (0xFB00, 0),
)
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPTS = np.array([s for _, s in SCRIPT_RANGES])
N_SCRIPTS = 16


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


@dataclass
class Words:
    """The words (runs of letters) of some lower-cased texts."""

    points: np.ndarray  # all code points, each text followed by a line feed; 32 where no letter is
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # the first word of each text, and the number of words

    @property
    def letters(self) -> np.ndarray:
        return self.ends - self.starts

    def of(self, text: int) -> slice:
        return slice(int(self.firsts[text]), int(self.firsts[text + 1]))

    def lots(self) -> Iterator[slice]:
        """Runs of words of bounded length in all (or one word)."""
        marks = self.starts // _ABREAST
        cuts = np.flatnonzero(np.diff(marks, prepend=-1))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(marks)], strict=False):  # without words: none
            yield slice(s, e)


def words_of(texts: list[str | None]) -> Words:
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _alphabet()[points]
    step = np.diff(letter.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    return Words(np.where(letter, points, np.uint32(32)), starts, ends, np.searchsorted(starts, at))


def trigrams(words: Words, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of some words, borders included, and where each word's begin."""
    starts, ends = words.starts[some], words.ends[some]
    n = ends - starts
    first = np.concatenate([[0], np.cumsum(n)])
    low = int(starts[0])
    points = np.concatenate([[32], words.points[low : int(ends[-1]) + 1]]) if low == 0 else words.points[low - 1 : int(ends[-1]) + 1]
    inside = np.flatnonzero(points[1:-1] != 32) + 1
    mixed = points.astype(np.uint64)
    mixed = mixed[inside - 1] * np.uint64(0x9E3779B97F4A7C15) ^ mixed[inside] * np.uint64(0xC2B2AE3D27D4EB4F) ^ mixed[inside + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    buckets = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)
    return buckets.astype(np.int32), first[:-1]


def scripts(words: Words) -> np.ndarray:
    return _SCRIPTS[np.searchsorted(_STARTS, words.points[words.starts], side="right") - 1]


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over labelled(lang, text); buckets from 2^15 on count words by script."""
    size = (1 << BUCKET_BITS) + N_SCRIPTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size, dtype=np.int64))
        for batch in batches:
            for lang, column in batch.groupby("lang", sort=False)["text"]:
                texts = column.to_list()
                for lot in lots(texts, _TOGETHER):
                    words = words_of([texts[k] for k in lot])
                    for some in words.lots():
                        tables[lang] += np.bincount(trigrams(words, some)[0], minlength=size)
                    tables[lang] += np.bincount(scripts(words) + (1 << BUCKET_BITS), minlength=size)
            release_memory()
        for lang, t in tables.items():
            used = np.flatnonzero(t)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": t[used].astype(np.int64)})

    counted = labelled.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # float32 (2^15, languages): log-probabilities
    uses: np.ndarray  # bool (scripts, languages)
    middle: np.ndarray  # mean log-likelihood between own and other text, by language
    spread: np.ndarray  # standard deviation of a trigram's log-likelihood in own text, by language

    def _scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log-likelihood under each language, and whether any language uses its script."""
        out = np.zeros((len(words.starts), len(self.langs)), dtype=np.float32)
        for some in words.lots():
            buckets, first = trigrams(words, some)
            out[some] = np.add.reduceat(self.weights[buckets], first, axis=0)
        can = self.uses[scripts(words)]
        written = can.any(axis=1)
        narrowed = np.where(can, out, out.min(axis=1, keepdims=True) - 1000) if len(out) else out
        return np.where(written[:, None], narrowed, 0), written

    def label(self, texts: list[str | None]) -> tuple[Words, np.ndarray, list[np.ndarray], np.ndarray]:
        """The words of the texts, their scores, the language number of each text's words, and whether
        any language can write a word."""
        words = words_of(texts)
        scores, written = self._scores(words)
        numbers = [np.arange(words.firsts[k], words.firsts[k + 1]) for k in range(len(texts))]
        return words, scores, viterbi(numbers, scores, SWITCH), written

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int, float]]:
        """Language, score, number of spans and fit of each text."""
        out = [(UNKNOWN, 0.0, 0, 0.0)] * len(texts)
        for lot in lots(texts, _TOGETHER) if self.langs else []:
            words, scores, paths, written = self.label([texts[k] for k in lot])
            letters = words.letters.astype(np.float32)
            for k, (at, path) in enumerate(zip(lot, paths, strict=True)):
                own = words.of(k)
                out[at] = self._verdict(path, scores[own], letters[own], written[own])
        return out

    def _verdict(self, path: np.ndarray, scores: np.ndarray, letters: np.ndarray, written: np.ndarray) -> tuple[str, float, int, float]:
        if not len(path):
            return UNKNOWN, 0.0, 0, 0.0
        got = np.bincount(path, letters * written, len(self.langs))
        best = int(got.argmax())
        n = float(got[best])  # a word has as many trigrams as letters
        if not n:
            return self.langs[best], 0.0, 0, 0.0
        mine = (path == best) & written
        above = (scores[mine, best] - letters[mine] * self.middle[best]) / self.spread[best]
        fit = float(np.maximum(above, -WORST * letters[mine]).sum(dtype=np.float64)) / n**0.5
        spans = 1 + int(np.count_nonzero(np.diff(path[written])))
        return self.langs[best], n / float(letters.sum(dtype=np.float64)), spans, fit


def viterbi(numbers: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """The best path of each sequence, where a change of label costs `switch`.

    Sequences are cut into chunks that all advance together, one position at a time. A chunk first
    runs from a state that knows nothing, then again from its predecessor's last state, until both runs
    have left every other label for the same one: from there on they agree. Most do after a few words. What
    is then still open goes from chunk to chunk, so that a word is looked at three times at most."""
    sizes = np.array([len(x) for x in numbers], dtype=np.int64)
    behind = np.cumsum(sizes)
    n, langs = int(sizes.sum()), scores.shape[1]
    if not n:
        return [np.zeros(0, np.int32) for _ in numbers]
    flat = np.concatenate(numbers)
    times = -(-sizes // _CHUNK)
    owner = np.repeat(np.arange(len(sizes)), times)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    begin = np.repeat(behind - sizes, times) + nth * _CHUNK
    end = np.minimum(begin + _CHUNK, behind[owner])
    follows = np.append(nth > 0, False)  # whether a chunk goes on where the one before it ends
    labels, cost = np.arange(langs, dtype=np.int16), np.float32(switch)
    back, path = np.zeros((n, langs), dtype=np.int16), np.zeros(n, dtype=np.int32)
    first, last = (np.zeros((len(owner), langs), dtype=np.float32) for _ in range(2))  # states, the best at 0

    def forward(on: np.ndarray, again: bool) -> None:
        state, at = first[on], begin[on]
        while len(on):
            top = state.argmax(axis=1).astype(np.int16)[:, None]
            stay = state >= -cost
            came = np.where(stay, labels, top)
            met = again & (came == top).all(axis=1) & (back[at] == top).all(axis=1)
            back[at] = came
            state = scores[flat[at]] + np.where(stay, state, -cost)
            state -= state.max(axis=1, keepdims=True)
            at = at + 1
            done = at == end[on]
            if done.any():
                last[on[done]] = state[done]
            go = ~(done | met)
            if not go.all():
                on, at, state = on[go], at[go], state[go]

    def trace(on: np.ndarray, here: np.ndarray, again: bool) -> None:
        at = end[on] - 1
        while len(on):
            go = (at > begin[on]) & ~(again & (path[at] == here))
            path[at] = here
            here = back[at, here]
            at = at - 1
            if not go.all():
                on, at, here = on[go], at[go], here[go]

    chunks = np.arange(len(owner))
    forward(chunks, again=False)
    open_ = np.zeros(len(owner) + 1, dtype=bool)
    done, whole = chunks, True
    while True:
        after = done[follows[done + 1]] + 1
        open_[after] = (first[after] != last[after - 1]).any(axis=1)
        done = np.flatnonzero(open_)
        if not len(done):
            break
        if not whole:  # the first of each sequence, whose beginning is certain
            done = done[np.unique(owner[done], return_index=True)[1]]
        first[done], open_[done], whole = last[done - 1], False, False
        forward(done, again=True)

    trace(chunks, last.argmax(axis=1), again=False)
    done, whole = chunks, True
    while True:
        before = done[follows[done]] - 1
        open_[before] = path[end[before] - 1] != back[end[before], path[end[before]]]
        done = np.flatnonzero(open_)
        if not len(done):
            break
        if not whole:  # the last of each sequence, whose end is certain
            done = done[::-1][np.unique(owner[done][::-1], return_index=True)[1]]
        open_[done], whole = False, False
        trace(done, back[end[done], path[end[done]]], again=True)
    return np.split(path, behind[:-1])


def train(labelled: DataFrame) -> Model:
    """The model of labelled(lang, text); rows with a null lang or text are left out. The model grows
    with the number of languages, so that more than MOST_LANGS are an error."""
    small_batches(labelled.sparkSession)
    many = labelled.select("lang").filter("lang is not null").distinct().limit(MOST_LANGS + 1).count()
    if many > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values: clean it first")
    counts = count_trigrams(labelled.filter("lang is not null and text is not null")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    n = np.zeros(((1 << BUCKET_BITS) + N_SCRIPTS, len(langs)))
    column = {x: k for k, x in enumerate(langs)}
    n[counts["bucket"].to_numpy(), [column[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    tri, script = n[: 1 << BUCKET_BITS], n[1 << BUCKET_BITS :]
    weights = np.log((tri + SMOOTHING) / (tri.sum(axis=0) + SMOOTHING * len(tri)))
    uses = script >= SCRIPT_SHARE * script.sum(axis=0)
    # What the counts tell of the log-likelihood of each language's rows (across) under each (down).
    share = tri / np.maximum(tri.sum(axis=0), 1)
    under = weights.T @ share
    own = np.diag(under)
    other = np.where(np.eye(len(langs), dtype=bool), -np.inf, under).max(axis=1, initial=-np.inf)
    middle = (own + np.maximum(other, weights.mean(axis=0))) / 2
    spread = np.sqrt(np.maximum((share * (weights - own) ** 2).sum(axis=0), 1e-6))
    return Model(langs, weights.astype(np.float32), uses & (script > 0), middle, spread)


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, n_spans and fit."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_spans int, fit double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(shared.value.predict(list(batch)), columns=["lang_pred", "score", "n_spans", "fit"])
            release_memory()

    # Else a filter on what is found would find it a second time, in workers of its own.
    run = run.asNondeterministic()
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "n_spans", "fit", "lid_")]
    return docs.select(*keep, run(docs["text"]).alias("lid_")).select(*keep, "lid_.*")


def label_spans(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_spans: array<struct<start, end, lang>> in code points, from a span's first word
    to its last."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([spans_of(shared.value, x) for x in batch], dtype=object)

    return docs.withColumn("lang_spans", run(docs["text"]))


def spans_of(model: Model, text: str | None) -> list[dict]:
    out: list[dict] = []
    if not model.langs:
        return out
    # Lower-casing can lengthen a text; where it does, such letters stay, so that offsets hold.
    low = (text or "").lower()
    if len(low) != len(text or ""):
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text or "")
    words, _, paths, written = model.label([low])
    for start, end, label, known in zip(words.starts.tolist(), words.ends.tolist(), paths[0].tolist(), written.tolist(), strict=True):
        if not known:
            continue
        if out and out[-1]["lang"] == model.langs[label]:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end, "lang": model.langs[label]})
    return out
