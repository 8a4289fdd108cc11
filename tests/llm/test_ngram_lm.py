import math
import os
import random
import resource
from collections import Counter

import brute
import numpy as np
import pytest

from ledgerlane.llm import ngram_lm
from ledgerlane.llm.ngram_lm import scored, summed, train


def rows(n=80):
    rng = random.Random(6)
    words = [f"W{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("bucket_bytes", [1 << 23, 500])
def test_scores_match_brute_force(spark, make_docs, monkeypatch, bucket_bytes):
    """With small buckets some contexts are spread over all of them."""
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", bucket_bytes)
    learn = [*rows(), (900, None), (901, ""), (902, "w1 W1"), (902, "w1 W1")]
    score = [*learn, (903, "never seen words"), (904, "w1 " * 20_000)]
    model = train(spark, make_docs(learn))
    assert (bucket_bytes == 500) == (len(model.spread) > 0)
    got = scored(spark, make_docs(score), model).orderBy("doc_id", "text").collect()
    score = sorted(score, key=lambda r: (r[0], r[1] or ""))
    want = brute.kneser_ney([t for _, t in learn], [t for _, t in score])
    assert [r["score"] for r in got] == pytest.approx(want)
    counts = Counter(w for _, t in learn for w in [*(t or "").lower().split(), ""])
    n, v = sum(counts.values()), len(counts)
    for r, (_, t) in zip(got, score, strict=True):
        tokens = [*(t or "").lower().split(), ""]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(tokens), n, sum(counts[w] > 0 for w in tokens))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))


@pytest.mark.parametrize("n", [0, 1, 5, 3_000, 400_000])
@pytest.mark.parametrize("many", [1, 1 << 18])
def test_keys_are_found(tmp_path, monkeypatch, n, many):
    monkeypatch.setattr(ngram_lm, "MANY", many)
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
    if n > 5:
        key = np.unique(np.concatenate([key, key[:50] + np.uint64(1), np.array([0, (1 << 48) - 1], np.uint64)]))
    value = rng.integers(1, 9, len(key))
    mixed_up = rng.permutation(len(key))
    ngram_lm.save(str(tmp_path), "gram", 0, ngram_lm.keyed("x", key[mixed_up], value[mixed_up]))
    asked = np.concatenate([key, key + np.uint64(1), rng.integers(0, 1 << 48, 1_000, dtype=np.uint64)]) & np.uint64((1 << 48) - 1)
    known = dict(zip(key.tolist(), value.tolist(), strict=True))
    got = ngram_lm.Maps(str(tmp_path), np.zeros(1)).look_up("gram", "x", 1, np.zeros(len(asked), dtype=np.int64), asked)[:, 0]
    assert got.tolist() == [known.get(k, 0) for k in asked.tolist()]


def thue_morse(n, a, b):
    word, other = a, b
    while len(word) < n:
        word, other = word + other, other + word
    return word


def test_patterned_words_are_told_apart(spark, make_docs):
    """Two words of which polynomials modulo 2^64 make one, whatever their base; the other never occurs."""
    pairs = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (64, 1024, 4096) for a, b in (("a", "b"), ("x", "\u00e9"))]
    for a, b in pairs:
        h, begin = ngram_lm.word_hashes(f"{a} {b} {a}".encode())
        assert h[0] == h[2] != h[1] and begin.tolist() == [0, len(a.encode()) + 1, len(a.encode()) + len(b.encode()) + 2]
    model = train(spark, make_docs([(k, a) for k, (a, _) in enumerate(pairs)]))
    assert model.vocabulary == len(pairs) + 1
    got = scored(spark, make_docs([(k, f"{a} {b}") for k, (a, b) in enumerate(pairs)]), model).collect()
    assert [r["n_known"] for r in got] == [2] * len(pairs)


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(2)
    data = " ".join("".join(rng.choices("abcDE\u00fc", k=rng.choice([1, 3, 9, 200]))) + rng.choice(["", "\n\t ", "  "]) for _ in range(400)).encode()
    whole = ngram_lm.word_hashes(data)
    monkeypatch.setattr(ngram_lm, "_PIECE", 50)
    assert all((a == b).all() for a, b in zip(whole, ngram_lm.word_hashes(data), strict=True))
    words = data.decode().split()
    assert len(set(whole[0].tolist())) == len({w.encode().lower() for w in words}) and len(whole[0]) == len(words)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, make_docs, order):
    """Over all words, the end and one word that doesn't occur, after contexts that were seen and not."""
    learn = rows(30)
    model = train(spark, make_docs(learn), order=order)
    words = sorted({w for _, t in learn for w in (t or "").lower().split()})
    for context in ("", "w3 ", "w0 w1 ", "w1 w0 ", "w39 w38 ", "unseen w2 ", "w2 unseen "):
        place = len(context.split())
        total = sum(_probability(model, context + w, place) for w in [*words, "unseen"]) + _probability(model, context, place)
        assert total == pytest.approx(1)


def _probability(model, text, place):
    hashes, word, lengths = next(ngram_lm.coded([text], 1))
    return model.probabilities(hashes, word, lengths)[0][place]


def test_more_buckets_than_open_files(spark, make_docs, monkeypatch):
    """Scores stay right where a process may hold fewer descriptors than there are buckets."""
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 50)
    monkeypatch.setattr(ngram_lm, "OPEN", 8)
    learn = rows(60)
    model = train(spark, make_docs(learn), order=3)
    assert model.buckets > 64
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 24, hard))
    try:
        got = model.score([t for _, t in learn])["score"].tolist()
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(model.maps.files) <= 8
    assert got == pytest.approx(trigram_scores([t for _, t in learn], [t for _, t in learn]))


def test_no_training_rows_and_empty_table(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    model = train(spark, docs.limit(0))
    assert [(r["score"], r["base_score"], r["n_tokens"], r["n_known"]) for r in scored(spark, docs.orderBy("doc_id"), model).collect()] == [(0, 0, 3, 0), (0, 0, 1, 0)]
    assert scored(spark, docs.limit(0), model).count() == 0


def test_summed():
    keys, n = summed([np.array([2, 1, 2]), np.array([5, 5, 5])], np.array([1, 2, 3]))
    assert [k.tolist() for k in keys] == [[1, 2], [5, 5]] and n.tolist() == [2, 4]


def trigram_scores(train_texts, texts):
    """Plain Python: each order discounts by its own counts and hands the rest to the one below."""
    tokens = lambda t: ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
    grams = lambda t: zip(tokens(t), tokens(t)[1:], tokens(t)[2:], strict=False)
    three = Counter(g for t in train_texts for g in grams(t))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def discount(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        d = ngram_lm._discounts(n)
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    levels = [(x, discount(x)) for x in (one, two, three)]

    def p(gram):
        counts, d = levels[len(gram) - 1]
        own = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        below = p(gram[1:]) if len(gram) > 1 else 1 / (len(one) + 1)
        if not own:
            return below
        c = counts[gram]
        return (c - d(c) + sum(map(d, own)) * below) / sum(own)

    return [sum(math.log10(p(g)) for g in grams(t)) for t in texts]


@pytest.mark.parametrize("bucket_bytes", [1 << 23, 500])
def test_trigram_scores_match_brute_force(spark, make_docs, monkeypatch, bucket_bytes):
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", bucket_bytes)
    learn = [*rows(), (900, None), (901, ""), (902, "w1 W1"), (902, "w1 W1")]
    score = [*learn, (903, "never seen words"), (904, "w1 w2 " * 50)]
    got = scored(spark, make_docs(score), train(spark, make_docs(learn), order=3)).orderBy("doc_id", "text").collect()
    score = sorted(score, key=lambda r: (r[0], r[1] or ""))
    assert [r["score"] for r in got] == pytest.approx(trigram_scores([t for _, t in learn], [t for _, t in score]))
