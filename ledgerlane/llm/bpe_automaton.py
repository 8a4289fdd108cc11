"""Byte-level BPE by a deterministic tokenization automaton.

compile_merges() builds the automaton by one gadget per merge (a, b) -> c, in order. At first one
state loops on all 256 byte tokens. The gadget takes every path p -a-> q -b-> r: a's arcs are led to
a copy of q without the b arc, and each p that has an a arc gets a c arc to r. All arcs of a label
lead to one state, so a label points to a state and the table is one bit per (state, label class):
labels share a class as long as no gadget has told them apart, and states likewise. What the
automaton accepts is exactly the token sequences that applying the merges in order can give.

encode() runs a pre-split word through the table: from the start, every byte position is reached by
exactly one token; position by position, the tokens that begin there (a trie walk) and have an arc
from the state just reached are followed; the one path that ends the word is its tokenization.
decode() emits the arc labels' bytes.

Edge cases: a null text counts as empty; special tokens' strings in a text become their ids, leftmost
and longest first, as the vocabulary file's library does by default; ids decode to the same text;
repeated and very long words are fine (time is linear in the word, times the longest token). A
vocabulary file that asks for what isn't built (a normalizer, a prefix space, trimmed special tokens,
byte fallback, another model or splitter) is refused with an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import release_memory, small_batches


def _filled(letters: str, numbers: str, space: str) -> str:
    """The byte-level pre-split pattern (fixed value), with its three character classes filled in."""
    return (
        rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


#: White space by Unicode's property (the separators U+001C to U+001F are not in it), and the
#: letters, numbers and white space below U+0100.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LOW_CLASSES = (r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")
_HIGH = re.compile(r"[^\x00-\xff]")
#: Words kept by a worker, characters of text whose new words are learned together, words abreast,
#: tokens sent back together; bytes from which a word goes on its own; positions of it abreast.
_CACHE, _TOGETHER, _ABREAST, _SENT, _LONG, _RUN = 1 << 15, 1 << 19, 1 << 14, 1 << 19, 256, 1 << 12


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Trie:
    """All tokens by their bytes. Nodes are numbered level by level, so that a node's children stand
    together: the first child's number, and a bit for each byte that leads on, say where an arc goes."""

    def __init__(self, tokens: list[bytes]) -> None:
        names = sorted({t[:n] for t in tokens for n in range(1, len(t) + 1)}, key=lambda t: (len(t), t))
        number = {t: k for k, t in enumerate(names)}
        #: The label that ends at a node, or -1; the nodes of single bytes.
        self.ends = np.full(len(names) + 1, -1, dtype=np.int32)
        for label, t in enumerate(tokens):
            if t:
                self.ends[number[t]] = label
        self.roots = np.array([number.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        parent = np.array([number[t[:-1]] for t in names if len(t) > 1], dtype=np.int64)
        byte = np.array([t[-1] for t in names if len(t) > 1], dtype=np.int64)
        self.bits = np.zeros((len(names), 4), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (parent, byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
        counts = np.bitwise_count(self.bits).astype(np.int32)
        #: The number of the first child behind each of a node's four words of bits.
        single = sum(len(t) == 1 for t in names)
        first = single + np.cumsum(counts.sum(axis=1)) - counts.sum(axis=1)
        self.first = (first[:, None] + np.cumsum(counts, axis=1) - counts).astype(np.int32)

    def below(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to, or -1."""
        part, bit = byte >> 6, (byte & 63).astype(np.uint64)
        word = self.bits[node, part]
        rank = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where((word >> bit) & np.uint64(1), self.first[node, part] + rank, -1).astype(np.int32)


@dataclass
class Automaton:
    tokens: list[bytes]  # by label
    ids: np.ndarray  # by label
    state: np.ndarray  # the state that a label's arcs lead to
    group: np.ndarray  # the class of a label
    barred: np.ndarray  # bits (class, state), packed by state: no such arc
    special: dict[str, int]
    dead: frozenset[int]  # labels without arcs
    cache: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)
    by_id: dict = field(default_factory=dict)
    names: list = field(default_factory=list)
    table: Trie | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "older": {}, "by_id": {}, "names": [], "table": None}

    def _table(self) -> Trie:
        if self.table is None:
            self.table = Trie([b"" if label in self.dead else t for label, t in enumerate(self.tokens)])
        return self.table

    def labels(self, words: list[bytes]) -> list[list[int]]:
        """The labels of pre-split words."""
        flat, starts = self._flat_labels(words)
        return [x.tolist() for x in np.split(flat, starts[1:])] if words else []

    def _flat_labels(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The labels of pre-split words, one word after the other, and where each word's begin. All
        words advance together, position by position. Words are padded to the longest."""
        if len(words) == 1 and len(words[0]) > _LONG:
            return self._labels_of_one(words[0]), np.zeros(1, dtype=np.int64)
        trie = self._table()
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-size, kind="stable")  # the longest first
        longest = int(size.max(initial=0))
        text = np.zeros((len(words), longest + 1), dtype=np.uint8)
        text[np.arange(longest + 1) < size[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        text, falling = np.ascontiguousarray(text[order].T), size[order]
        last = np.zeros((longest + 1, len(words)), dtype=np.int32)
        for i in range(longest):
            rows = np.arange(np.searchsorted(-falling, -i))  # words longer than i
            state = self.state[last[i, rows]] if i else None
            node = trie.roots[text[i, rows]]
            for j in range(i, longest):
                if j > i:
                    on = falling[rows] > j
                    if not on.all():
                        rows, node, state = rows[on], node[on], state[on] if i else None
                    node = trie.below(node, text[j, rows])
                    on = node >= 0
                    rows, node, state = rows[on], node[on], state[on] if i else None
                if not len(rows):
                    break
                label = trie.ends[node]
                good = label >= 0
                if i:
                    bits = self.barred[self.group[label], state >> 3]
                    good &= (bits & (128 >> (state & 7))) == 0
                last[j + 1, rows[good]] = label[good]
        # Back from each word's end: at every step the label that ends there.
        lengths = np.array([len(t) for t in self.tokens])
        at, rows, found = falling.copy(), np.arange(len(words)), []
        while len(rows := rows[at[rows] > 0]):
            label = last[at[rows], rows]
            at[rows] -= lengths[label]
            found.append((order[rows], at[rows], label))
        if not found:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        word, begin, label = (np.concatenate(x) for x in zip(*found, strict=True))
        sequence = np.argsort(word * (longest + 1) + begin)
        counts = np.bincount(word, minlength=len(words))
        return label[sequence], np.cumsum(counts) - counts

    def _labels_of_one(self, word: bytes) -> np.ndarray:
        """The labels of one long word. The tokens that begin at its positions do not depend on states, so
        a run of positions walks the trie together; the arcs are then followed one by one in plain numbers."""
        trie, text, n = self._table(), np.frombuffer(word, dtype=np.uint8), len(word)
        state, group = self.state.tolist(), self.group.tolist()
        barred, width = memoryview(np.ascontiguousarray(self.barred).reshape(-1)), self.barred.shape[1]
        last = [0] * (n + 1)
        for start in range(0, n, _RUN):
            at = np.arange(start, min(start + _RUN, n))
            node, depth, found = trie.roots[text[at]], 1, []
            while len(at):
                label = trie.ends[node]
                good = label >= 0
                found.append((at[good], at[good] + depth, label[good]))
                on = at + depth < n
                at, node = at[on], node[on]
                node = trie.below(node, text[at + depth])
                on = node >= 0
                at, node, depth = at[on], node[on], depth + 1
            begin, end, label = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(begin, kind="stable")
            for i, j, arc in zip(begin[order].tolist(), end[order].tolist(), label[order].tolist(), strict=True):
                if i:
                    s = state[last[i]]
                    if barred[group[arc] * width + (s >> 3)] & 128 >> (s & 7):
                        continue
                last[j] = arc
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return np.array(out[::-1], dtype=np.int32)

    def _learn(self, words: list[str]) -> list[str]:
        """Each word's token ids in decimal, joined by commas. Words of one call are padded to the
        longest: pass like lengths."""
        if not self.names:
            self.names += map(str, self.ids.tolist())
        labels, starts = self._flat_labels([w.encode() for w in words])
        ids = list(map(self.names.__getitem__, labels.tolist()))
        starts = starts.tolist()
        return [",".join(ids[s:e]) for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]

    def forget(self) -> None:
        self.cache.clear()
        self.older.clear()

    def parts(self, texts: list[str | None]) -> Iterator[list[str]]:
        """For each text, what _learn() gives for its words, in order. Words are kept in a bounded
        cache; new ones are learned together for texts of _TOGETHER characters in all."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars < _TOGETHER):
                chars += len(texts[end] or "")
                end += 1
            yield from self._parts(texts[start:end])
            start = end

    def _parts(self, texts: list[str | None]) -> list[list[str]]:
        # Two generations: words in use move on to the younger one, so that common words stay known.
        cache, older = self.cache, self.older
        if len(cache) > _CACHE:
            older.clear()
            self.cache, self.older = cache, older = older, cache
        words = [
            [w for part in self._split(t or "") for w in ([part] if part in self.special else splitter(part).findall(part))]
            for t in texts
        ]
        unseen = set().union(*words).difference(cache)
        cache.update((w, older[w]) for w in unseen.intersection(older))
        fresh = unseen.difference(older)
        for s in fresh & self.special.keys():
            cache[s] = str(self.special[s])
        fresh -= self.special.keys()
        # Longer words in smaller lots, since a lot is padded to its longest word.
        by_size = sorted(fresh, key=len)
        sizes = [len(w) for w in by_size]
        cuts = [0, *(bisect_right(sizes, n) for n in (4, 8, 16, 256)), len(by_size)]
        for s, e, lot in zip(cuts[:-1], cuts[1:], (_ABREAST, _ABREAST, _ABREAST, 256, 1), strict=True):
            for k in range(s, e, lot):
                some = by_size[k : min(k + lot, e)]
                cache.update(zip(some, self._learn(some), strict=True))
        got = [list(map(cache.__getitem__, ws)) for ws in words]
        for w in by_size[cuts[-2] :]:
            del cache[w]
        return got

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids in next(self.parts([text])) for i in ids.split(",")]

    def bytes_of(self, ids: list[str]) -> bytes:
        """The bytes that the arcs of token ids (in decimal) emit."""
        by_id = self.by_id
        if not by_id:
            by_id |= {str(i): t for i, t in zip(self.ids.tolist(), self.tokens, strict=True)}
            by_id |= {str(i): s.encode() for s, i in self.special.items()}
        return b"".join(map(by_id.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(list(map(str, ids))).decode("utf-8", "replace")

    def _split(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text] if text else []
        longest = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        return [p for p in regex.split(f"({longest})", text) if p]


@lru_cache(maxsize=2)
def _pattern(low: bool) -> re.Pattern | regex.Pattern:
    return re.compile(_filled(*_LOW_CLASSES)) if low else regex.compile(_filled(r"\p{L}", r"\p{N}", _SPACE))


def splitter(text: str) -> re.Pattern | regex.Pattern:
    """The pre-split pattern; a faster form of it for text below U+0100."""
    return _pattern(_HIGH.search(text) is None)


def compile_merges(merges: list[tuple[bytes, bytes]], ids: dict[bytes, int], special: dict[str, int]) -> Automaton:
    """The automaton of an ordered list of merges; both parts of each must exist before it."""
    labels = {bytes([b]): b for b in range(256)}
    n = 256 + len(merges)
    state, group = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    led, held = [256], [256]  # labels that lead to a state; labels of a class
    barred = np.zeros((1024, 1024), dtype=bool)
    dead: set[int] = set()
    for c, (left, right) in enumerate(merges, start=256):
        a, b = labels[left], labels[right]
        if labels.setdefault(left + right, c) != c:
            raise ValueError("two merges make one token")
        if a in dead or b in dead or barred[group[b], state[a]]:
            dead.add(c)  # no path has a, then b: the merge never applies
            continue
        target, kind = state[b], group[a]
        old = state[a]
        if len(held) == barred.shape[0] or len(led) == barred.shape[1]:
            barred = np.pad(barred, ((0, barred.shape[0] // 2), (0, barred.shape[1] // 2)))
        if led[old] > 1 or a == b:  # copy q for a alone; c keeps the old one
            new = len(led)
            barred[: len(held), new] = barred[: len(held), old]
            led[old] -= 1
            led.append(1)
            state[a] = new
        if held[group[b]] > 1:  # tell b from its class
            new = len(held)
            barred[new, : len(led)] = barred[group[b], : len(led)]
            held[group[b]] -= 1
            held.append(1)
            if a == b:
                kind = new
            group[b] = new
        barred[group[b], state[a]] = True
        # c arcs: from every state with an a arc, to where b's arcs led.
        state[c], group[c] = target, kind
        led[target] += 1
        held[kind] += 1
    tokens = sorted(labels, key=labels.__getitem__)
    return Automaton(
        tokens, np.array([ids[t] for t in tokens], dtype=np.int64), state, group,
        np.packbits(barred[: len(held), : len(led)], axis=1), special, frozenset(dead),
    )


def _refuse_unbuilt(spec: dict) -> None:
    """Raises an error where a vocabulary file asks for what the automaton doesn't do."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [
        ("normalizer", spec.get("normalizer")),
        ("model", model.get("type", "BPE") != "BPE"),
        ("pre_tokenizer", split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)),
        *[(k, model.get(k)) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")],
        *[("added token " + t["content"], t.get(k)) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")],
    ]
    if found := [name for name, asked in odd if asked]:
        raise ValueError(f"not built for this vocabulary file: {', '.join(found)}")


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary file (JSON with vocab, merges, added tokens)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _refuse_unbuilt(spec)
    letters = _byte_letters()
    raw = lambda s: bytes(letters[ch] for ch in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return compile_merges([(raw(a), raw(b)) for a, b in merges], ids, special)


def encoded(docs: DataFrame, vocabulary: str, spark: SparkSession, with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256, and on request token_ids. vocabulary is read on
    the driver; the compiled table (about 20 MB, bounded by the vocabulary) is broadcast."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(vocabulary))
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for batch in texts:
            rows, tokens = [], 0
            for parts in automaton.parts(list(batch)):
                joined = ",".join(parts)
                ids = joined.split(",") if joined else []
                # Decoding starts from the ids alone and replaces what isn't UTF-8, as decode() does.
                text = automaton.bytes_of(ids).decode("utf-8", "replace").encode()
                row = (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                rows.append((*row, np.fromstring(joined, dtype=np.int32, sep=",")) if with_ids else row)
                tokens += row[0]
                if tokens >= _SENT:  # in parts, so that few ids are held at a time
                    yield pd.DataFrame(rows, columns=names)
                    rows, tokens = [], 0
            yield pd.DataFrame(rows, columns=names)
            del rows, batch
            release_memory()
        automaton.forget()
        release_memory()

    run = run.asNondeterministic()  # once a text, also where a filter reads the result
    keep = [c for c in docs.columns if c not in (*names, "bpe_")]
    return docs.select(*keep, run(docs["text"]).alias("bpe_")).select(*keep, "bpe_.*")
