import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlane.llm import language_id
from ledgerlane.llm.language_id import BUCKET_BITS, SMOOTHING, SWITCH, UNKNOWN, identify, label_spans, train, trigrams, viterbi, words_of
from ledgerlane.llm.queries import op2_language_id

EN, DE = "the house and this thing with".split(), "das haus und schön nicht größe".split()
RU = "дом и это слово когда".split()


def sentences(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def model(make_docs):
    rows = [(i, t, lang) for lang, words in (("en", EN), ("de", DE), ("ru", RU)) for i, t in enumerate(sentences(words, 30, 1))]
    return train(make_docs([*rows, (900, "ignored words", None), (901, None, "en"), (902, "", "de")]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(40, 3)).astype(np.float32)
    for length in (1, 2, 5, 7):
        numbers = rng.integers(0, 40, length)
        path = viterbi([numbers, numbers[:1]], scores, 1.0)[0]

        def cost(p):
            return sum(scores[n, x] for n, x in zip(numbers, p, strict=True)) - sum(a != b for a, b in zip(p, p[1:], strict=False))

        best = max(cost(p) for p in np.stack(np.meshgrid(*[range(3)] * length), -1).reshape(-1, length))
        assert cost(path) == pytest.approx(best, abs=1e-4)


def plain_viterbi(scores, switch):
    """One word after the other."""
    state, back = np.zeros(scores.shape[1], np.float32), []
    for now in scores:
        top = int(state.argmax())
        stay = state >= -np.float32(switch)
        back.append(np.where(stay, np.arange(len(now)), top))
        state = now + np.where(stay, state, -np.float32(switch))
        state = state - state.max()
    path = [int(state.argmax())]
    for came in back[:0:-1]:
        path.append(int(came[path[-1]]))
    return path[::-1] if len(scores) else []


@pytest.mark.parametrize("scale", [0.0, 0.3, 3.0, 20.0])
@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_chunks_do_not_change_paths(monkeypatch, chunk, scale):
    monkeypatch.setattr(language_id, "_CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    for labels in (1, 2, 5):
        sizes = [*rng.integers(0, 60, 6).tolist(), 0, 1, 700]
        scores = np.round(rng.standard_normal((sum(sizes), labels)) * scale, 1).astype(np.float32)
        scores[rng.random(len(scores)) < 0.3] = 0
        ends = np.cumsum(sizes)
        got = viterbi([np.arange(e - s, e) for s, e in zip(sizes, ends, strict=True)], scores, SWITCH)
        assert [p.tolist() for p in got] == [plain_viterbi(scores[e - s : e], SWITCH) for s, e in zip(sizes, ends, strict=True)]
    assert viterbi([], scores, SWITCH) == []


def test_held_out_accuracy(spark, make_docs, model):
    rows = [(i, t, lang) for lang, words in (("en", EN), ("de", DE), ("ru", RU)) for i, t in enumerate(sentences(words, 20, 9))]
    got = identify(spark, make_docs(rows), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.9 <= r["score"] <= 1 for r in got)


def test_edge_cases(spark, make_docs, model, by_id):
    docs = make_docs([(1, None), (2, ""), (3, "12 34 !? ²"), (4, "中文字"), (5, "the house " * 30_000), (5, "the house")])
    out = identify(spark, docs, model)
    got = {(r["doc_id"], r["lang_pred"]) for r in out.collect()}
    assert {(1, UNKNOWN), (2, UNKNOWN), (3, UNKNOWN), (5, "en")} <= got
    assert {x for i, x in got if i == 4} <= set(model.langs)
    assert out.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in out.collect())
    assert identify(spark, docs.limit(0), model).count() == 0


def test_no_training_rows(spark, make_docs):
    empty = train(make_docs([(1, "text", None)]))
    assert [r["lang_pred"] for r in identify(spark, make_docs([(1, "some text")]), empty).collect()] == [UNKNOWN]


def test_spans_of_mixed_text(spark, make_docs, model):
    first, second = " ".join(EN * 3), " ".join(DE * 3)
    text = f"{first} {second} {' '.join(RU)}"
    spans = label_spans(spark, make_docs([(1, text)]), model).first()["lang_spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert text[spans[1]["start"] : spans[1]["end"]] == second


def test_trigrams_belong_to_their_words():
    words = words_of(["ab c", None, "It's ÄÖ 12x"])
    text = "ab c\n\nit's äö 12x\n"
    assert [text[i:j] for i, j in zip(words.starts, words.ends, strict=True)] == ["ab", "c", "it", "s", "äö", "x"]
    assert words.firsts.tolist() == [0, 2, 2, 6] and words.letters.tolist() == [2, 1, 2, 1, 2, 1]
    buckets, first = trigrams(words, slice(0, 6))
    assert first.tolist() == [0, 2, 3, 5, 6, 8] and len(buckets) == 9
    assert trigrams(words, slice(2, 5))[0].tolist() == buckets[3:8].tolist()


def plain_prediction(train_rows, texts):
    """lang and score by counters and a dynamic programme over words, one text at a time."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    tri = lambda w: [f" {w} "[i : i + 3] for i in range(len(w))]
    counts = {}
    for _, t, lang in train_rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(x for w in words(t) for x in tri(w))
    langs = sorted(x for x in counts if counts[x])
    total = {x: sum(counts[x].values()) + SMOOTHING * 2**BUCKET_BITS for x in langs}
    score = lambda w, x: sum(math.log((counts[x][g] + SMOOTHING) / total[x]) for g in tri(w))
    for t in texts:
        ws = words(t)
        if not ws:
            yield UNKNOWN, 0.0
            continue
        best, back = {x: score(ws[0], x) for x in langs}, []
        for w in ws[1:]:
            step = {x: max(langs, key=lambda y: best[y] - SWITCH * (y != x)) for x in langs}
            best = {x: best[y] - SWITCH * (y != x) + score(w, x) for x, y in step.items()}
            back.append(step)
        path = [max(langs, key=best.__getitem__)]
        for step in reversed(back):
            path.append(step[path[-1]])
        letters = Counter()
        for w, x in zip(ws, reversed(path), strict=True):
            letters[x] += len(w)
        lang = max(langs, key=lambda x: letters[x])
        yield lang, letters[lang] / sum(letters.values())


def test_query_matches_brute_force(spark, tmp_path):
    """The registered query over a small table of mixed texts, nulls and repeated rows."""
    rng = random.Random(12)
    lists = {"en": EN, "de": DE, "fr": "une maison et cette chose avec des mots".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(list(lists))
        other = rng.choice(list(lists))
        text = " ".join(rng.choices(lists[lang], k=rng.randint(1, 9)) + rng.choices(lists[other], k=rng.randint(0, 9))) + rng.choice([".", " 12!", ""])
        rows.append((i, rng.choice([text, text.upper()]), rng.choice([lang, None])))
    rows += [(200, None, "en"), (201, "", None), (202, "12 ?", "de"), (203, rows[3][1], "en"), (203, rows[3][1], "en"), (None, "the house", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 5)) for r in op2_language_id(spark, str(tmp_path)).collect()), key=repr)
    plain = plain_prediction([r for r in rows if not held(r[0])], [t for _, t, _ in rows])
    want = sorted(((i, held(i), lang, round(score, 5)) for (i, _, _), (lang, score) in zip(rows, plain, strict=True)), key=repr)
    assert got == want


def test_words_that_no_language_can_write_count_for_none(spark, make_docs, model, by_id):
    foreign = "中文字 ภาษาไทย "
    got = by_id(identify(spark, make_docs([(1, foreign * 20), (2, foreign + "the house and this thing"), (3, "the house and this thing")]), model))
    assert (got[1]["score"], got[1]["n_spans"], got[1]["fit"]) == (0, 0, 0)
    assert got[2]["lang_pred"] == "en" and 0.5 < got[2]["score"] < 0.9 and got[2]["n_spans"] == 1
    assert got[2]["fit"] == pytest.approx(got[3]["fit"]) and got[3]["score"] == 1
    spans = label_spans(spark, make_docs([(1, foreign)]), model).first()["lang_spans"]
    assert spans == []


def test_fit_tells_unknown_languages_apart(spark, make_docs, model, by_id):
    unknown = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"
    got = by_id(identify(spark, make_docs([(1, unknown), (2, " ".join(EN)), (3, " ".join(DE)), (4, " ".join(RU)), (5, "the house QXZKWJVVXQQZKJ and this thing")]), model))
    assert got[1]["fit"] < -5 and all(got[i]["fit"] > 0 for i in (2, 3, 4)) and got[5]["fit"] > -5
