import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerlane.llm.hilbert_shards import bits_for, hilbert_index, shards


def test_curve_visits_every_cell_by_unit_steps():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        index = hilbert_index(points, bits)
        assert sorted(index.tolist()) == list(range(len(points)))
        path = points[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_law_slots_and_sizes(make_docs):
    rows = [(i, "w " * (i % 50), "en" if i % 3 else None, f"s{i % 7}" if i % 5 else None) for i in range(1003)] + [(None, None), (3, "x"), (3, "x"), (2, "ü" * 50_000)]
    got = shards(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want


def skilling(point, bits):
    """The Hilbert index of one point, bit by bit (the transform's usual form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def brute(rows, n_shards):
    """Every row's shard and slot, by sorting all rows by their curve index."""
    name = lambda s: 42 if s is None else (h := xxhash.xxh64_intdigest(s.encode(), seed=42)) - (h >> 63 << 64)
    bits, n = bits_for(n_shards), len(rows)
    whole = []
    for doc_id, text, lang, source in rows:
        data = (text or "").encode()
        whole.append((doc_id, len(data) + 1, zlib.crc32(data), (name(source), name(lang), len(data) + 1, -(1 << 63) if doc_id is None else doc_id)))
    cells = 1 << bits
    # Quantiles come as doubles, so that cuts between hashes are rounded.
    cuts = [[int(float(sorted(r[3][d] for r in whole)[-(-n * i // cells) - 1])) for i in range(1, cells)] for d in range(4)]
    cell = lambda r: skilling([bisect.bisect_left(c, v) for c, v in zip(cuts, r[3], strict=True)], bits)
    order = sorted(whole, key=lambda r: (cell(r), r[0] is not None, r[0] or 0, r[2], r[1]))
    out = []
    for rank, r in enumerate(order):
        shard = rank * n_shards // n
        out.append((r[0], r[1], r[2], shard, rank - -(-shard * n // n_shards)))
    return out


@pytest.mark.parametrize("n, n_shards", [(700, 8), (333, 5), (60, 64), (3, 8)])
def test_rows_lie_as_sorting_all_by_the_curve_puts_them(make_docs, n, n_shards):
    rng = random.Random(n)
    rows = [(rng.choice([None, i, i * 1000]), rng.choice([None, "", "w " * rng.randint(1, 400)]), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", f"s{rng.randint(0, 9)}", None])) for i in range(n)]
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shards(make_docs(rows), n_shards).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, n_shards), key=str)


def test_few_rows_and_none(make_docs):
    docs = make_docs([(1, "a"), (2, "b")])
    assert sorted(r["slot"] for r in shards(docs).collect()) == [0, 0]
    assert shards(docs.limit(0)).count() == 0


def test_shards_are_compact(make_docs):
    """Rows of one source fall into few shards."""
    rows = [(i, "w " * 20, "en", f"source {i % 4}") for i in range(400)]
    docs = make_docs(rows)
    placed = shards(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "shard").distinct().count()
    assert placed <= 16  # 32 if sources were spread evenly


def test_filters_on_any_dimension_prune_shards(make_docs):
    """How many of 64 shards the rows of a filter lie in; spread at random, each would lie in nearly all.
    Ids have gaps, sizes a long tail, and one source a third of all rows."""
    rng = np.random.default_rng(3)
    n, n_shards = 6000, 64
    ids = np.cumsum(np.where(rng.random(n) < 0.01, 10**6, 1))
    source = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 20, n))
    lang, size = rng.integers(0, 4, n), np.exp(rng.normal(4, 1.5, n)).astype(int)
    rows = [(int(ids[i]), "x" * int(size[i]), f"l{lang[i]}", f"s{source[i]}") for i in range(n)]
    shard = {r["doc_id"]: r["shard"] for r in shards(make_docs(rows), n_shards).collect()}
    at = np.array([shard[int(i)] for i in ids])
    counts = np.bincount(at, minlength=n_shards)
    assert counts.max() - counts.min() <= 1
    few = lambda picked: len(np.unique(at[picked]))
    read = {
        "source": np.mean([few(source == s) for s in range(1, 20)]), "lang": np.mean([few(lang == x) for x in range(4)]),
        "size": np.mean([few((size >= lo) & (size <= hi)) for lo, hi in np.quantile(size, [[0, 0.1], [0.45, 0.55], [0.9, 1]])]),
        "doc_id": np.mean([few((ids >= lo) & (ids <= hi)) for lo, hi in np.quantile(ids, [[0, 0.1], [0.45, 0.55], [0.9, 1]])]),
    }
    assert all(v <= 40 for v in read.values()), read


def test_cells_grow_with_shards():
    assert [bits_for(n) for n in (1, 8, 4096, 4097, 100_000)] == [4, 4, 4, 5, 6]
