import hashlib
import random
import time

import pytest

from ledgerlane.llm import bpe_automaton
from ledgerlane.llm.bpe_automaton import compile_merges, encoded

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
BITS = [
    "a", "b", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", "é", "ß", "中", "文", "😀", "'s", "'re", "'", "1", "²", "ª", "<|endoftext|>", "<|endof", "!", "...",
    "the", "aaa", "==", "\x00", "́", "٣", "Ⅷ", "\r\n", "Straße",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_equal_the_librarys(library):
    rng = random.Random(0)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 15))) for _ in range(2000)] + ["a" * 3001, "ab" * 2000, " " * 999, "中" * 800, "the" * 1500, "=" * 700]
    automaton = bpe_automaton.load(PATH)
    for text, parts in zip(texts, automaton.parts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        got = [int(i) for p in parts for i in p.split(",")]
        assert got == want, repr(text)
        assert automaton.decode(got) == library.decode(want, skip_special_tokens=False)
        assert automaton.bytes_of(",".join(parts).split(",") if parts else []).decode() == text


@pytest.mark.parametrize("letter", ["a", "=", "중", None])
def test_a_megabyte_without_a_space(library, letter):
    """Long words take seconds, and the library's ids."""
    word = letter * (1_000_000 // len(letter.encode())) if letter else "".join(random.Random(5).choices("abcdefghiklmnoprstuéß", k=900_000))
    began = time.time()
    got = bpe_automaton.load(PATH).encode(word)
    assert time.time() - began < 30
    assert got == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("long, run", [(256, 4096), (0, 3)])
def test_any_ordered_merges(monkeypatch, long, run):
    """Random small merge lists against applying the merges one after the other; words abreast and alone."""
    monkeypatch.setattr(bpe_automaton, "_LONG", long)
    monkeypatch.setattr(bpe_automaton, "_RUN", run)
    rng = random.Random(3)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 12:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        ids = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        automaton = compile_merges(merges, ids, {})
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 14))) for _ in range(60)]
        found = automaton.labels(words) if long else [automaton.labels([w])[0] for w in words]
        for word, labels in zip(words, found, strict=True):
            parts = [bytes([b]) for b in word]
            for a, b in merges:
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [automaton.tokens[x] for x in labels] == parts


def test_query_rows_and_edge_cases(spark, make_docs, library):
    rows = [(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "x" * 50_000), (4, "<|endoftext|>x")]
    got = encoded(make_docs(rows), PATH, spark, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["token_ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert encoded(make_docs(rows).limit(0), PATH, spark).count() == 0


def test_one_token_by_two_merges_is_refused():
    with pytest.raises(ValueError):
        compile_merges([(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")], {}, {})


def test_files_that_ask_for_more_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    strip = [spec["added_tokens"][0] | {"lstrip": True}]
    split = spec["pre_tokenizer"] | {"add_prefix_space": True}
    for k, change in enumerate([{"normalizer": {"type": "NFC"}}, {"added_tokens": strip}, {"pre_tokenizer": split}, {"model": spec["model"] | {"unk_token": "?"}}]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="not built"):
            bpe_automaton.load(str(path))
