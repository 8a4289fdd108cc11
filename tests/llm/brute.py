"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash

BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def pii(text: str | None) -> tuple:
    counts, spans = [], []
    for rank, (kind, pattern) in enumerate(BASE):
        n = 0
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                n += 1
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest())


def fingerprint(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, linked) -> dict:
    """id -> smallest id reachable, by comparing all pairs of positions with linked(i, j)."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return {x: least[root(i)] for i, x in enumerate(ids)}


def conversation(turns: list[tuple]) -> tuple:
    """n_turns, turns_sha256, loss_chars, loss_sha256 of (turn, role, text) rows."""
    rows = sorted((t, r or "", x or "") for t, r, x in turns)
    said = "".join(f"{r}\n{x}\n" for _, r, x in rows)
    loss = "".join(x for _, r, x in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(said), len(loss), sha(loss)


def targets(sizes: dict) -> dict:
    """Water-filling by repeated resharing; sizes by source (None last)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def kneser_ney(train: list, texts: list) -> list[float]:
    """log10 probability of each text under the interpolated modified Kneser-Ney bigram model."""
    import math
    from collections import Counter

    def tokens(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]

    pairs = Counter()
    for t in train:
        ws = tokens(t)
        pairs.update(zip(["<s>", *ws], ws, strict=False))
    contexts = Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(n[:3]) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))]

    high, low = discounts(pairs.values()), discounts(contexts.values())
    total, vocabulary = sum(contexts.values()), len(contexts)
    rest = sum(low[min(c, 3)] for c in contexts.values()) / total

    def one(w):
        c = contexts[w]
        return (c - low[min(c, 3)]) / total + rest / (vocabulary + 1)

    follow: dict = {}
    for (v, w), c in pairs.items():
        follow.setdefault(v, {})[w] = c

    def two(v, w):
        own = follow.get(v)
        if not own:
            return one(w)
        n = sum(own.values())
        c = own.get(w, 0)
        return (c - high[min(c, 3)]) / n + sum(high[min(x, 3)] for x in own.values()) / n * one(w)

    out = []
    for t in texts:
        ws = tokens(t)
        out.append(sum(math.log10(two(v, w)) for v, w in zip(["<s>", *ws], ws, strict=False)))
    return out
