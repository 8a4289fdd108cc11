import random

import brute

from ledgerlane.llm.simhash_dedup import deduplicate, fingerprint_of, links, near_duplicates


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    near = [b.replace(b.split()[30], "changed", 1) for b in base[:6]]
    return [*base, *near, base[0], base[0].upper(), None, "", "  \t\n", "one", "one two", "é" * 50, "a b c " * 3000]


def test_fingerprints_match_brute_force():
    for t in texts():
        assert fingerprint_of(t) == brute.fingerprint(t)


def test_components_match_brute_force(make_docs, by_id):
    rows = list(enumerate(texts()))
    rows += [rows[3], rows[3]]
    got = by_id(near_duplicates(make_docs(rows)))
    prints = [brute.fingerprint(t) for _, t in rows]
    want = brute.components([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["fingerprint"] == f"{p:016x}" for (i, _), p in zip(rows, prints, strict=True))


def test_links_are_exactly_the_pairs_within_two_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    flipped = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + flipped})
    got = {(r["a"], r["b"]) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    pairs = ((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :])
    assert got == {(a, b) for a, b in pairs if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}


def test_null_ids_and_empty_table(make_docs):
    rows = [(None, "a b c d"), (7, "a b c d"), (None, "only null ids here"), (3, "x")]
    got = [(r["doc_id"], r["component_id"]) for r in near_duplicates(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 7), (7, 7), (None, None), (3, 3)], key=repr)
    assert near_duplicates(make_docs([(1, "x")]).limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(make_docs):
    rows = [(5, "a b c d"), (4, "A b c d"), (4, "A b c d"), (9, "other words in here"), (None, "a b c d"), (None, None), (8, "")]
    docs = make_docs(rows)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(4, "A b c d"), (8, ""), (9, "other words in here")]
