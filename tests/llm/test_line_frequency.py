import random
import re
from collections import defaultdict

import pytest

from ledgerlane.llm.line_frequency import clean, repeated, verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(line):
    return " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute(rows, least=10, percent=10, left=50):
    """By row: the contract's counts, base_failed, kept, by comparing strings."""
    held, docs = defaultdict(set), defaultdict(set)
    for n, (doc_id, text, _, host) in enumerate(rows):
        who = (doc_id, None if doc_id is not None else n)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                held[host, plain(line)].add(who)
                docs[host].add(who)
    often = {k for k, v in held.items() if len(v) > least and 100 * len(v) > percent * len(docs[k[0]])}
    out = []
    for doc_id, text, _, host in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        on = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        gone = sum(len(WORD.findall(x)) for x in lines if (host, plain(x)) in often)
        failed = len(words) < 50 or 100 * len(on) > 50 * len(words)
        kept = not failed and 100 * (len(words) - gone) >= left * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(on), failed, kept))
    return out


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["Ähm", "naïve", "x#", "a|b", "<p>", "東京", "one", "Two", "3rd", "𝒳", "\x1c", "\x85\xa0", "tab", "of", "$5"] + [f"w{i}" for i in range(300)]
    footer = "All rights RESERVED 2024 " + " ".join(f"footer{i}" for i in range(60))
    rows = []
    for i in range(160):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(rng.randint(1, 9))]
        host = ("hot", "hot", "b", None)[i % 4]
        if i % 3 == 0:  # a line that differs in case and white space only
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([footer, footer.upper()]).replace(" ", rng.choice([" ", "\t ", "  "])))
        if i % 5 == 0:
            lines += lines[:2]
        rows.append((i, rng.choice(["\n", "\n", "\r\n"]).join(lines), None, host))
    return rows


ODD = [
    (900, None, None, "b"), (901, "", None, "b"), (902, "\n \n\t", None, None), (903, "x" * 40_000, None, "b"), (904, "same line here\n" * 3_000, None, "b"),
    (None, "no id " * 30, None, "b"), (None, "no id " * 30, None, "b"), (905, " ".join(f"v{i}" for i in range(30_000)), None, "b"),
]


def test_counts_and_verdicts_match_brute_force(spark, make_docs):
    rows = corpus() + ODD[:-1] + [corpus()[0], corpus()[0]]  # one document repeated
    got = sorted((tuple(r[c] for c in COLUMNS) for r in verdicts(make_docs(rows)).collect()), key=str)
    want = brute(rows)
    assert got == sorted(want, key=str)
    assert {w[-2:] for w in want} == {(True, False), (False, False), (False, True)}  # both rules decide


def test_long_texts(spark, make_docs):
    got = {r["doc_id"]: r for r in verdicts(make_docs([(1, " ".join(f"v{i}" for i in range(200_000)), "en", "h"), (2, "same line here\n" * 100_000, "en", "h")])).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["kept"]) == (200_000, 0, True)
    assert (got[2]["n_words"], got[2]["n_repeat_words"], got[2]["n_dup_lines"], got[2]["base_failed"]) == (300_000, 300_000, 99_999, True)


@pytest.mark.parametrize("hosts, removed", [(1, True), (20, False)])
def test_documents_are_counted_by_host(spark, make_docs, hosts, removed):
    """A line in 20 documents goes where one host has them all, and stays where each host has one."""
    body = lambda i: " ".join(f"d{i}w{k}" for k in range(80))
    rows = [(i, f"{body(i)}\nSubscribe to our newsletter", None, f"h{i % hosts}") for i in range(20)]
    got = verdicts(make_docs(rows)).collect()
    assert {(r["n_lines_removed"], r["kept"]) for r in got} == {(int(removed), True)}


def test_copies_of_a_row_are_one_document(spark, make_docs):
    rows = [(1, " ".join(f"w{k}" for k in range(80)), None, "h")] * 30
    assert {(r["n_lines_removed"], r["kept"]) for r in verdicts(make_docs(rows)).collect()} == {(0, True)}


def test_limits_are_parameters(spark, make_docs):
    rows = [(i, "\n".join([" ".join(f"d{i}w{k}" for k in range(60)), *["common line " + " ".join(f"c{k}" for k in range(70))] * (i < 4)]), None, "h") for i in range(40)]
    kept = lambda **limits: {r["doc_id"] for r in verdicts(make_docs(rows), **limits).collect() if r["kept"]}
    assert kept() == set(range(40))
    assert kept(least_documents=3, percent=5) == set(range(4, 40))
    assert kept(least_documents=3, percent=5, left_percent=40) == set(range(40))


def test_clean_removes_lines_and_keeps_columns(spark, make_docs):
    footer = "Subscribe to our newsletter 7"
    rows = [(i, f"{' '.join(f'd{i}w{k}' for k in range(70))}\n{footer.upper() if i % 2 else footer}\n\nend of {' '.join(f'e{i}x{k}' for k in range(5))}", "en", "h") for i in range(30)]
    rows.append((99, footer, "en", "h"))
    docs = make_docs(rows)
    out = clean(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(range(30))
    for i, text, *_ in rows[:-1]:
        first, _, blank, last = text.split("\n")
        assert got[i]["text"] == "\n".join([first, blank, last]) and got[i]["score"] == "x" and got[i]["lang"] == "en"


def test_empty_table(spark, make_docs):
    docs = make_docs([(1, "x", None, "h")]).limit(0)
    assert verdicts(docs).collect() == [] and clean(docs).collect() == []


def test_repeated_words():
    assert repeated("a b c a b c".encode().split()) == 6
    assert repeated("a b c a b d".encode().split()) == 0
    assert repeated("x x x x".encode().split()) == 4
    assert repeated("a b c z a b c y".encode().split()) == 6
    assert repeated([]) == repeated([b"a", b"a", b"a"]) == 0
