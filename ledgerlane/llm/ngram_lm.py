"""Interpolated modified Kneser-Ney model of order 2 or 3: counted in Spark, stored as sorted hash arrays,
memory-mapped by the workers that score.

Words are counted by 64-bit hash in buckets; a word's place in its bucket's sorted array is its number.
A task then takes some million tokens, counts their distinct n-grams, and deals them to buckets by the
middle word: a blob per bucket, of the numbers of its words once and the n-grams as places in that
list, in byte planes that compress well. So a bucket holds all of a word's
trigrams, and with them how often each bigram continues, what follows each pair of words, and what
follows the word. Words with a large share of the corpus (and the start mark) are spread over all
buckets by the word that follows; what they have in each is added up in a second step, which also
counts each word's distinct contexts. A bucket is one file of sorted arrays in the shared folder (a
path that machines mount, since files are memory-mapped), written under a temporary name and renamed,
so repeated tasks leave one copy. Words are known by all 64 bits of their hash. Keys of bigrams and
trigrams, which only the model's score reads, are the 48 leading bits of theirs: among the few million
n-grams of a bucket, one that doesn't occur is mistaken for one that does once in 10^8 times. A worker keeps
a bounded number of maps open. To the driver come sums, the spread words, and how many words each of
at most MOST_WORD_BUCKETS buckets of words has.

P(w|v) = (c(v,w) - D_c) / c(v) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v) * P(w), where P(w) discounts
the number of distinct contexts of w in the same way and gives the rest to V + 1 words evenly. A
document is its words after a start mark, and one end token.

With order 3, P(w|u,v) is interpolated in the same way with P(w|v), whose c(v,w) is then the number
of distinct u before it; a document has two start marks.

Edge cases: a null, empty or blank text is the end token alone; without training rows every text has
probability 1 per token under the model and the base score is 0; repeated rows count as often as they
occur; texts are read whole; a null doc_id is hashed as empty text; other columns are not looked at.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import folder as own_folder
from ledgerlane.llm.common import release_memory, small_batches

#: Bytes of text a bucket stands for; tokens a task gathers before it counts and sends them; bytes of
#: text scored together; a word is spread if it has more than this share of its bucket's tokens; maps
#: that a worker keeps open.
BUCKET_BYTES, HELD, TOGETHER, SPREAD, OPEN = 16 << 20, 2 << 20, 8 << 20, 0.05, 256
MOST_WORD_BUCKETS = 1 << 16
#: Keys from which their first bits stand in a table instead of with each.
MANY = 1 << 18
#: Bytes hashed together. The hashes of the end and start marks.
_PIECE, END, START = 1 << 19, 1, 2
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_DEALT = "bucket int, n int, m int, words binary, grams binary"
_SUMS = "bucket int, kind string, n int, key binary, value binary"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """A number for each byte (capitals as small letters), whether it separates words, and a factor for
    each place in a word."""
    value = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    value[space] = 0
    return value, space, _factors(2 * _PIECE)


def _factors(n: int) -> np.ndarray:
    """The first n of an endless row of random numbers, the same on every machine."""
    return np.random.default_rng(43).integers(0, 1 << 64, n, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where each word begins. A hash is the sum of the bytes'
    numbers times the factors of their places, modulo 2^64: the factors have no law, so that no pattern
    in words makes them meet. One running sum gives all; pieces end where words do."""
    value, space, factor = _tables()
    hashes, begin, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        x = np.frombuffer(data, dtype=np.uint8, count=min(end, len(data)) - at, offset=at)
        if len(x) > len(factor):  # a word longer than a piece
            factor = _factors(len(x))
        step = np.diff(np.concatenate([[True], space[x], [True]]).view(np.int8))
        starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        place = np.arange(len(x), dtype=np.int32)
        place -= np.repeat(np.concatenate([[0], starts]).astype(np.int32), np.diff(np.concatenate([[0], starts, [len(x)]])))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(value[x] * factor[place], out=sums[1:])
        h = sums[ends] - sums[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hashes.append(h ^ (h >> np.uint64(32)))
        begin.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begin)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of the texts, an end after each text, and the texts' lengths in tokens."""
    data = [(t or "").encode() for t in texts]
    hashes, begin = word_hashes(b"\n".join(data))
    at = np.cumsum([0, *[len(d) + 1 for d in data]])
    words = np.diff(np.searchsorted(begin, at))
    out = np.full(len(hashes) + len(data), np.uint64(END))
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(data)), words)] = hashes
    return out, words + 1


def runs(texts: Iterable[str | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What tokens() gives, for runs of texts of about `most` tokens."""
    held, some, chars, size = [], [], 0, 0
    for text in texts:
        some.append(text)
        chars += len(text or "")
        if chars >= _PIECE:
            held.append(tokens(some))
            size += len(held[-1][0])
            some, chars = [], 0
        if size >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
            release_memory()
    if some:
        held.append(tokens(some))
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def coded(texts: Iterable[str | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of words, the start mark's first; all tokens as numbers of these; the lengths of the texts;
    for runs of texts of about `most` tokens."""
    for hashes, lengths in runs(texts, most):
        words, number = np.unique(hashes, return_inverse=True)
        yield np.concatenate([np.array([START], np.uint64), words]), number.astype(np.int32) + np.int32(1), lengths


def before(token: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each one; the start mark at the beginning of a text."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[np.cumsum(lengths) - lengths] = 0
    return out


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context and a word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _alone(number: np.ndarray) -> np.ndarray:
    """The key of a single number: like all keys spread evenly, which a search relies on."""
    return mixed(np.zeros(len(number), dtype=np.uint64), number.astype(np.uint64)) >> np.uint64(16)


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns, in order of the first, then the next; n added up (rows of n
    where it is two-dimensional)."""
    if not len(n):
        return keys, n
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return [k[starts] for k in keys], np.add.reduceat(n, starts, axis=0)


def grouped(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """As summed(), for columns of small numbers, which are sorted as one where they fit in 63 bits;
    without n, rows are counted."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return summed(keys, np.ones(len(keys[0]), dtype=np.int64) if n is None else n)
    one = np.zeros(len(keys[0]), dtype=np.uint64)
    for k, b in zip(keys, bits, strict=True):
        one = (one << np.uint64(b)) | k.astype(np.uint64)
    if n is None:
        one.sort()
    else:
        order = np.argsort(one)
        one, n = one[order], n[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(one), 1), dtype=bool), one[1:] != one[:-1]]))
    n = np.diff(np.append(starts, len(one))) if n is None else np.add.reduceat(n, starts, axis=0) if len(n) else n
    one, out = one[starts], []
    for b in reversed(bits):
        out.append((one & np.uint64((1 << b) - 1)).astype(np.int32))
        one = one >> np.uint64(b)
    return out[::-1], n


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, byte plane by byte plane, compressed."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int, kind: str, width: int) -> np.ndarray:
    """The columns again, as the rows of an array."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.array(planes.reshape(width, size, n).transpose(0, 2, 1), order="C").view(kind)[:, :, 0]


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for s, e in zip(starts, [*starts[1:], len(bucket)], strict=False):
        yield int(bucket[s]), slice(s, e)


def _rows(value: np.ndarray) -> np.ndarray:
    return value if value.ndim == 2 else value[:, None]


def _delta(sorted_: np.ndarray) -> bytes:
    """Numbers in order, as steps."""
    return squeezed([np.diff(sorted_.astype(np.uint64), prepend=np.uint64(0))])


def _undelta(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueezed(data, n, "<u8", 1)[0], dtype=np.uint64)


def sums_for(kind: str, bucket: np.ndarray, key: np.ndarray, value: np.ndarray) -> list[tuple]:
    """Rows (bucket, kind, n, key, value) of what is to be added up in each bucket."""
    order = np.argsort(key)
    order = order[np.argsort(bucket[order], kind="stable")]
    bucket, key, value = bucket[order], key[order], _rows(value)[order].astype(np.int64)
    return [(b, kind, s.stop - s.start, _delta(key[s]), squeezed(list(np.ascontiguousarray(value[s].T)))) for b, s in _cuts(bucket)]


def _added(table: pa.Table, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of one kind of rows of sums_for()."""
    own = table.filter(pc.equal(table["kind"], kind))
    parts = [(_undelta(k, n), unsqueezed(v, n, "<i8", width).T) for n, k, v in zip(*(own[c].to_pylist() for c in ("n", "key", "value")), strict=True)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((0, width), np.int64)
    (key,), value = summed([np.concatenate([k for k, _ in parts])], np.concatenate([v for _, v in parts]))
    return key, value


def _valued(name: str, value: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of numbers, as places in a table of distinct rows."""
    value = _rows(value)
    tag = value[:, 0].astype(np.uint64)
    for k in range(1, value.shape[1]):
        tag = mixed(tag, value[:, k].astype(np.uint64))
    _, first, code = np.unique(tag, return_index=True, return_inverse=True)
    return {f"{name}-code": code.astype(np.min_scalar_type(max(len(first) - 1, 0))), f"{name}-table": value[first].astype(np.int64)}


def halves(key: np.ndarray, low: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The leading 32 bits of keys and the rest, which has the bits of low."""
    shift = np.uint64(8 * np.dtype(low).itemsize)
    return (key >> shift).astype(np.uint32), (key & ((np.uint64(1) << shift) - np.uint64(1))).astype(low)


def keyed(name: str, key: np.ndarray, value: np.ndarray, low: type = np.uint16) -> dict[str, np.ndarray]:
    """Sorted keys (of 32 bits and those of low) with their values. Of many keys of 48 bits, which are spread
    evenly, a table tells where those with the same first bits begin, a few each, and only the last 32 bits
    or less of each are kept."""
    order = np.argsort(key)
    key = key[order].astype(np.uint64)
    if low is np.uint16 and len(key) >= MANY:
        bits = max(16, len(key).bit_length() - 4)
        first = np.bincount((key >> np.uint64(48 - bits)).astype(np.int64), minlength=1 << bits)
        starts = np.concatenate([[0], np.cumsum(first)]).astype(np.uint32)
        return {f"{name}-starts": starts, f"{name}-rest": (key & np.uint64((1 << 48 - bits) - 1)).astype(np.uint32)} | _valued(name, value[order])
    high, rest = halves(key, low)
    return {f"{name}-high": high, f"{name}-low": rest} | _valued(name, value[order])


def _in_run(stored: dict[str, np.ndarray], name: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among those with its first bits, and where: a binary search of a few steps."""
    starts, rest = stored[f"{name}-starts"], stored[f"{name}-rest"]
    bits = (len(starts) - 1).bit_length() - 1
    run, want = (key >> np.uint64(48 - bits)).astype(np.int64), (key & np.uint64((1 << 48 - bits) - 1)).astype(np.uint32)
    place, end = starts[run].astype(np.int64), starts[run + 1].astype(np.int64)
    upto, on = end.copy(), np.flatnonzero(place < end)
    while len(on):
        middle = (place[on] + upto[on]) >> 1
        less = rest[middle] < want[on]
        place[on[less]] = middle[less] + 1
        upto[on[~less]] = middle[~less]
        on = on[place[on] < upto[on]]
    hit = place < end
    hit[hit] = rest[place[hit]] == want[hit]
    return hit, place


def _in_all(stored: dict[str, np.ndarray], name: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among all, and where."""
    high, low = stored[f"{name}-high"], stored[f"{name}-low"]
    want_high, want_low = halves(key, low.dtype)
    place = np.minimum(np.searchsorted(high, want_high), len(high) - 1)
    same, there = high[place] == want_high, low[place]
    hit = same & (there == want_low)
    late = np.flatnonzero(same & (there < want_low) & (place + 1 < len(high)))
    while len(late):  # few keys share their leading 32 bits
        place[late] += 1
        now = place[late]
        same, there = high[now] == want_high[late], low[now]
        hit[late] = same & (there == want_low[late])
        late = late[same & (there < want_low[late]) & (now + 1 < len(high))]
    return hit, place


def _path(folder: str, kind: str, bucket: int) -> str:
    return f"{folder}/{kind}-{bucket // 1000}/{bucket}"


def save(folder: str, kind: str, bucket: int, arrays: dict[str, np.ndarray]) -> None:
    """Writes a bucket's arrays in one file, whole or not at all: a line that says where each lies, then
    the arrays, aligned."""
    path = _path(folder, kind, bucket)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    told, at = {}, 0
    for name, a in arrays.items():
        told[name] = (a.dtype.str, a.shape, at)
        at += -(-a.nbytes // 64) * 64
    line = json.dumps(told).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(line)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 64))
    os.replace(own, path)


def mapped(folder: str, kind: str, bucket: int) -> dict[str, np.ndarray]:
    """A bucket's arrays, memory-mapped; none if it got nothing."""
    try:
        with open(_path(folder, kind, bucket), "rb") as f:
            line = f.readline()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    except FileNotFoundError:
        return {}
    out = {}
    for name, (dtype, shape, at) in json.loads(line).items():
        out[name] = np.frombuffer(data, dtype=dtype, count=int(np.prod(shape)), offset=len(line) + at).reshape(shape)
    return out


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _stats(n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Total and numbers of ones, twos and more, of each run of n."""
    if not len(starts):
        return np.zeros((0, 4), dtype=np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (n, n == 1, n == 2, n >= 3)], axis=1)


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of entries that occur once to four times; where these are too few
    to tell, the usual 0.5, 1, 1.5."""
    if min(n[:3]) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]


class Maps:
    """The files of a model, of which a bounded number is open."""

    def __init__(self, folder: str, firsts: np.ndarray) -> None:
        self.folder, self.files = folder, OrderedDict()
        #: The number of the first word of each bucket of words, and the number of words.
        self.firsts = firsts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": OrderedDict()}

    def get(self, kind: str, bucket: int) -> dict[str, np.ndarray]:
        got = self.files.pop((kind, bucket), None)
        if got is None:
            got = mapped(self.folder, kind, bucket)
            while len(self.files) >= OPEN:
                self.files.popitem(last=False)
        self.files[kind, bucket] = got
        return got

    def places(self, kind: str, name: str, bucket: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bucket: which keys are there, and where."""
        order = np.argsort(key)
        order = order[np.argsort(bucket[order], kind="stable")]
        for b, cut in _cuts(bucket[order]):
            stored, at = self.get(kind, b), order[cut]
            if not len(stored.get(f"{name}-code", ())):
                continue
            hit, place = (_in_run if f"{name}-starts" in stored else _in_all)(stored, name, key[at])
            yield b, at[hit], place[hit]

    def look_up(self, kind: str, name: str, width: int, bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The stored value of each key, or zeros."""
        out = np.zeros((len(key), width), dtype=np.int64)
        for b, at, place in self.places(kind, name, bucket, key):
            stored = self.get(kind, b)
            out[at] = stored[f"{name}-table"][stored[f"{name}-code"][place]]
        return out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, and its count; the start mark's is the number of words, that of words
        which don't occur one more."""
        number, n = np.full(len(hashes), int(self.firsts[-1]) + 1), np.zeros(len(hashes), dtype=np.int64)
        buckets = np.uint64(len(self.firsts) - 1)
        for b, at, place in self.places("word", "word", (hashes % buckets).astype(np.int64), hashes):
            number[at] = self.firsts[b] + place
            stored = self.get("word", b)
            n[at] = stored["word-table"][stored["word-code"][place], 0]
        number[hashes == np.uint64(START)] = self.firsts[-1]
        return number, n

    def home(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of words of each number, and the place there (the start mark's is behind the last)."""
        bucket = np.minimum(np.searchsorted(self.firsts, number, side="right"), len(self.firsts) - 1) - 1
        return bucket, number - self.firsts[bucket]


@dataclass
class Model:
    maps: Maps
    buckets: int
    spread: np.ndarray  # numbers of the words dealt out by what follows them, in order
    tokens: int
    pairs: int
    high: list[float]
    low: list[float]
    low_rest: float  # what the lower discounts take in all
    top: list[float] | None = None  # the trigrams' discounts, with order 3

    @property
    def vocabulary(self) -> int:
        return int(self.maps.firsts[-1])

    def probabilities(self, hashes: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's probability under the model, and its count in the training texts."""
        maps = self.maps
        number, raw = maps.numbers(hashes)
        home, place = maps.home(number)
        contexts = np.zeros(len(number), dtype=np.int64)
        for b in np.unique(home).tolist():
            at = np.flatnonzero((home == b) & (number < self.vocabulary))
            stored = maps.get("home", b)
            if stored:
                contexts[at] = stored["low-table"][stored["low-code"][place[at]], 0]
        wide = _wide(number, self.spread, self.vocabulary)
        own = np.zeros((len(number), 4), dtype=np.int64)
        own[wide] = maps.look_up("home", "spread", 4, home[wide], _alone(place[wide]))
        gram = number % self.buckets
        number = number.astype(np.uint64)
        own[~wide] = maps.look_up("gram", "context", 4, gram[~wide], _alone(number[~wide]))
        gap = np.take([0.0, *self.low], np.minimum(contexts, 3))
        lowest = (contexts - gap) / self.pairs + self.low_rest / self.pairs / (self.vocabulary + 1)
        p, context = lowest[word], before(word, lengths)
        pair = mixed(number[context], number[word])
        bucket = np.where(wide[context], _home(pair, self.buckets), gram[context])
        p = _interpolated(p, maps.look_up("gram", "pair", 1, bucket, pair >> np.uint64(16))[:, 0], own[context], self.high)
        if self.top:
            two = mixed(number[before(context, lengths)], number[context])
            triple = maps.look_up("gram", "triple", 1, bucket, mixed(two, number[word]) >> np.uint64(16))[:, 0]
            stats, far = np.zeros((len(word), 4), dtype=np.int64), wide[context]
            stats[~far] = maps.look_up("gram", "two", 4, gram[context[~far]], two[~far] >> np.uint64(16))
            stats[far] = maps.look_up("home", "two", 4, _home(two[far], self.buckets), two[far] >> np.uint64(16))
            p = _interpolated(p, triple, stats, self.top)
        return p, raw[word]

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        out = [pd.DataFrame({"n_tokens": np.zeros(0, np.int64), "n_known": np.zeros(0, np.int64), "base_score": np.zeros(0), "score": np.zeros(0)})]
        for hashes, word, lengths in coded(texts, TOGETHER // 8):
            first = np.cumsum(lengths) - lengths
            if not self.tokens:
                zero = np.zeros(len(lengths))
                out.append(pd.DataFrame({"n_tokens": lengths, "n_known": zero.astype(np.int64), "base_score": zero, "score": zero}))
                continue
            p, raw = self.probabilities(hashes, word, lengths)
            base = np.log10((raw + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
            out.append(pd.DataFrame({
                "n_tokens": lengths, "n_known": np.add.reduceat((raw > 0).astype(np.int64), first),
                "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first),
            }))
        return pd.concat(out, ignore_index=True)


def _interpolated(p: np.ndarray, n: np.ndarray, stats: np.ndarray, discounts: list[float]) -> np.ndarray:
    """p of the lower order, raised to the next where the context was seen."""
    total = np.maximum(stats[:, 0], 1)
    raised = (n - np.take([0.0, *discounts], np.minimum(n, 3)) + stats[:, 1:] @ np.array(discounts) * p) / total
    return np.where(stats[:, 0] > 0, raised, p)


def _home(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key % np.uint64(buckets)).astype(np.int64)


def _wide(number: np.ndarray, spread: np.ndarray, start: int) -> np.ndarray:
    """Whether words are spread over the buckets."""
    out = number == start
    if len(spread):
        out |= spread[np.minimum(np.searchsorted(spread, number), len(spread) - 1)] == number
    return out


def mapped_folder(spark: SparkSession) -> str:
    at = urlparse(own_folder(spark))
    if at.scheme not in ("", "file"):
        raise ValueError("the model is memory-mapped: spark.checkpoint.dir must be a mounted path (file://)")
    return f"{at.path}/lm-{uuid.uuid4().hex}"


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[str | None]:
    for batch in batches:
        yield from batch["text"]


def train(spark: SparkSession, docs: DataFrame, order: int = 2) -> Model:
    """The model of docs(text), of order 2 or 3."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: only 2 and 3 are built")
    small_batches(spark)
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder, buckets = mapped_folder(spark), 1 + size // BUCKET_BYTES
    few, often = min(buckets, MOST_WORD_BUCKETS), SPREAD * BUCKET_BYTES
    columns = [x.split()[0] for x in _SUMS.split(", ")]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hashes, _ in runs(_texts(batches), HELD):
            hashes.sort()
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            hashes, n = hashes[starts], np.diff(np.append(starts, len(hashes)))
            yield pd.DataFrame(sums_for("word", _home(hashes, few), hashes, n), columns=columns)

    def store_words(key: tuple, table: pa.Table) -> pa.Table:
        word, n = _added(table, "word", 1)
        save(folder, "word", key[0].as_py(), keyed("word", word, n, np.uint32))
        return pa.table(
            {"b": [key[0].as_py()], "tokens": [int(n.sum())], "words": [len(n)], "often": [np.flatnonzero(n[:, 0] > often).tolist()]},
            schema=pa.schema([("b", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()), ("often", pa.list_(pa.int64()))]),
        )

    counted = docs.mapInPandas(words, _SUMS).repartition(few, "bucket").groupBy("bucket").applyInArrow(store_words, "b long, tokens long, words long, often array<long>")
    told = counted.toArrow().sort_by("b").to_pydict()
    sizes = np.zeros(few, dtype=np.int64)
    sizes[told["b"]] = told["words"]
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    spread = np.array([int(firsts[b]) + x for b, some in zip(told["b"], told["often"], strict=True) for x in some], dtype=np.int64)
    start = int(firsts[-1])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = Maps(folder, firsts)
        for hashes, word, lengths in coded(_texts(batches), HELD):
            number, _ = maps.numbers(hashes)
            order_ = np.argsort(number)
            rank = np.empty(len(number), dtype=np.int32)
            rank[order_] = np.arange(len(number), dtype=np.int32)
            number = number[order_].astype(np.uint64)
            context = before(word, lengths)
            earlier = before(context, lengths) if order == 3 else np.zeros_like(word)
            (v, w, u), n = grouped([rank[context], rank[word], rank[earlier]])
            wide = _wide(number.astype(np.int64), spread, start)[v]
            bucket = _home(number, buckets)[v]
            bucket[wide] = _home(mixed(number[v[wide]], number[w[wide]]), buckets)
            at = np.argsort(bucket, kind="stable")
            v, w, u, n, bucket = v[at], w[at], u[at], n[at], bucket[at]
            out = []
            for b, s in _cuts(bucket):
                used, own = np.unique(np.concatenate([v[s], w[s], u[s]]), return_inverse=True)
                own = own.reshape(3, -1).astype(np.uint32)
                own[0] = np.diff(own[0], prepend=np.uint32(0))
                out.append((b, s.stop - s.start, len(used), _delta(number[used]), squeezed([*own, n[s].astype(np.uint32)])))
            yield pd.DataFrame(out, columns=["bucket", "n", "m", "words", "grams"])

    def store_grams(key: tuple, table: pa.Table) -> pa.Table:
        """Writes a bucket's n-grams and contexts; tells each word's home how many contexts it has here,
        and what spread words have."""
        at, lists, parts = 0, [], []
        for n, m, words_, grams in zip(*(table[c].to_pylist() for c in ("n", "m", "words", "grams")), strict=True):
            own = unsqueezed(grams, n, "<u4", 4)
            own[0] = np.cumsum(own[0], dtype=np.uint32)
            own[:3] += np.uint32(at)
            lists.append(_undelta(words_, m))
            parts.append(own)
            at += m
        word, number = np.unique(np.concatenate(lists), return_inverse=True)
        number = number.astype(np.int32)
        v, w, u, n = np.concatenate(parts, axis=1)
        del parts, lists
        (v, w, u), n = grouped([number[v], number[w], number[u]], n.astype(np.int64))
        wide, arrays, out = _wide(word.astype(np.int64), spread, start), {}, []
        pairs = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        if order == 3:
            arrays |= keyed("triple", mixed(mixed(word[u], word[v]), word[w]) >> np.uint64(16), n)
            out.append((0, "top", 1, b"", squeezed([np.array([x]) for x in _counts_of_counts(n)])))
            order_ = np.lexsort((u, v))
            cv, cu, cn = v[order_], u[order_], n[order_]
            starts = np.flatnonzero((np.diff(cv, prepend=-1) != 0) | (np.diff(cu, prepend=-1) != 0))
            two, stats, far = mixed(word[cu[starts]], word[cv[starts]]), _stats(cn, starts), wide[cv[starts]]
            arrays |= keyed("two", two[~far] >> np.uint64(16), stats[~far])
            out += sums_for("two", _home(two[far], buckets), two[far] >> np.uint64(16), stats[far])
            del cv, cu, cn, order_, two, stats
            n = np.diff(np.append(pairs, len(v)))
        v, w = v[pairs], w[pairs]
        arrays |= keyed("pair", mixed(word[v], word[w]) >> np.uint64(16), n)
        starts = np.flatnonzero(np.diff(v, prepend=-1))
        owner, stats, far = word[v[starts]], _stats(n, starts), wide[v[starts]]
        arrays |= keyed("context", _alone(owner[~far]), stats[~far])
        save(folder, "gram", key[0].as_py(), arrays)
        maps = Maps(folder, firsts)
        home, place = maps.home(owner[far].astype(np.int64))
        out += sums_for("spread", home, place, stats[far])
        times = np.bincount(w, minlength=len(word))
        home, place = maps.home(word[times > 0].astype(np.int64))
        out += sums_for("low", home, place, times[times > 0])
        out.append((0, "high", 1, b"", squeezed([np.array([x]) for x in _counts_of_counts(n)])))
        release_memory()
        return pa.Table.from_pandas(
            pd.DataFrame(out, columns=columns).astype({"bucket": "int32", "n": "int32"}), preserve_index=False,
            schema=pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("n", pa.int32()), ("key", pa.binary()), ("value", pa.binary())]),
        )

    def store_home(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        (place, times), (owner, stats), (two, two_stats) = (_added(table, k, n) for k, n in (("low", 1), ("spread", 4), ("two", 4)))
        all_ = np.zeros((int(sizes[b]) if b < few else 0, 1), dtype=np.int64)
        all_[place.astype(np.int64)] = times
        save(folder, "home", b, _valued("low", all_) | keyed("spread", _alone(owner), stats) | keyed("two", two, two_stats))
        told = {k: [unsqueezed(x, 1, "<i8", 4)[:, 0] for x in table.filter(pc.equal(table["kind"], k))["value"].to_pylist()] for k in ("high", "top")}
        times = times[:, 0]
        low = [*_counts_of_counts(times), int((times >= 3).sum()), int(times.sum())]
        high, top = (np.sum(x, axis=0).tolist() if x else [0] * 4 for x in (told["high"], told["top"]))
        release_memory()
        return pa.table({"high": [high], "low": [low], "top": [top]}, schema=pa.schema([(k, pa.list_(pa.int64())) for k in ("high", "low", "top")]))

    dealt = docs.mapInPandas(deal, _DEALT).repartition(buckets, "bucket")
    sent = dealt.groupBy("bucket").applyInArrow(store_grams, _SUMS).repartition(buckets, "bucket")
    homes = sent.groupBy("bucket").applyInArrow(store_home, "high array<long>, low array<long>, top array<long>")
    sums = homes.agg(*[F.coalesce(F.sum(F.col(k)[i]), F.lit(0)).alias(f"{k}{i}") for k, n in (("high", 4), ("low", 6), ("top", 4)) for i in range(n)]).first()
    high, low, top = ([sums[f"{k}{i}"] for i in range(n)] for k, n in (("high", 4), ("low", 6), ("top", 4)))
    d_low = _discounts(low[:4])
    rest = d_low[0] * low[0] + d_low[1] * low[1] + d_low[2] * low[4]
    return Model(
        Maps(folder, firsts), buckets, spread, sum(told["tokens"]), max(low[5], 1), _discounts(high), d_low, rest,
        _discounts(top) if order == 3 else None,
    )


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield shared.value.score(list(batch))
            release_memory()
        shared.value.maps.files.clear()

    run = run.asNondeterministic()  # once a text, also where a filter reads the result
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "lm_")
    keep = [c for c in docs.columns if c not in new]
    return docs.select(*keep, run(docs["text"]).alias("lm_")).select(
        *keep, "lm_.n_tokens", "lm_.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "lm_.base_score", "lm_.score"
    )
