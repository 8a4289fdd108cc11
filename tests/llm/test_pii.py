import random
import re
import time

import brute

from ledgerlane.llm.pii import KINDS, detect, digest, redact

PIECES = [
    "a.b@c.de", "x@y", "@", ".", "..", "a@b.c.d-e", "_%+-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "010.0.0.001", "4111 1111 1111 1111",
    "4111-1111-1111-1111", "4111111111111112", "37828 2246310005", "30569309025904", "+1 (415) 555-0100", "+49 1234567890123456", "+1", " ", "  ", "-", "é", "😀", "card", "\n",
    "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "DE89370400440532013000", "0", "12", "word",
]


def check(make_docs, by_id, texts):
    got = by_id(digest(make_docs(list(enumerate(texts)))))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.pii(t), t


def test_base_spans_match_brute_force(make_docs, by_id):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(400)] + [" ".join(rng.choices(PIECES, k=20)) for _ in range(100)]
    check(make_docs, by_id, [*texts, None, "", " "])


def test_very_long_texts_and_many_matches(make_docs, by_id):
    check(make_docs, by_id, ["x" * 20_000, "1" * 20_000, "a@b." * 5_000, "q@w.er " * 3000, "+1 " + " " * 20_000 + "2", "1.1.1.1 " * 2000])


def test_scanning_is_linear_in_a_run(make_docs, by_id):
    """A run without an at sign, which plain backtracking would scan from every start."""
    assert by_id(digest(make_docs([(1, "x" * 3_000_000 + " a@b.co")])))[1]["spans"] == "email:3000001:3000007"


def test_iban_is_added_and_context_moves_the_score(make_docs, by_id):
    got = by_id(detect(make_docs([(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "GB83WEST12345698765432"), (3, "call +1 415 555 0100"), (4, "to +1 415 555 0100")])))
    spans = {i: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["pii"]] for i, r in got.items()}
    assert spans == {1: [("iban", 5, 32, 0.9)], 2: [], 3: [("phone", 5, 20, 0.8)], 4: [("phone", 3, 18, 0.7)]}
    assert [k.name for k in KINDS][:4] == ["email", "ip", "card", "phone"]


def test_ibans_before_capitals_digits_and_other_ibans(make_docs, by_id):
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    rest = ["", " Please confirm", " BIC: COBADEFFXXX", " 2024-01-01", " I paid", f" {de} X", f" {gb} 7", f" {no} {no} A", " AB12 CD", "."]
    texts = [f"to {x}{r}" for x in (de, gb, no) for r in rest] + [f"{de}{de}", f"{de}x", f"x{de}", "DE88370400440532013000 Please"]
    got = by_id(detect(make_docs(list(enumerate(texts)))))
    for i, t in enumerate(texts[:-4]):
        want = sorted((m.start(), m.end()) for x in (de, gb, no) for m in re.finditer(x, t))
        assert [(s["start"], s["end"]) for s in got[i]["pii"] if s["kind"] == "iban"] == want, t
    assert all(s["kind"] != "iban" for i in range(len(texts) - 4, len(texts)) for s in got[i]["pii"])
    redacted = by_id(redact(make_docs([(1, f"{de} Please, {gb} I paid, {de} {gb} {no} 12")])))[1]["text"]
    assert redacted == "[IBAN] Please, [IBAN] I paid, [IBAN] [IBAN] [IBAN] 12"


def test_iban_of_no_known_country_and_many_ibans(make_docs, by_id):
    """Without a length of its country the longest prefix that passes is taken."""
    bare = "ZZ00" + "1" * 16
    digits = int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4]))
    zz = f"ZZ{98 - digits % 97:02d}" + bare[4:]
    got = by_id(digest(make_docs([(1, f"{zz} Or"), (2, "DE89370400440532013000 " * 5000)])))
    assert got[1]["spans"].split(",")[-1] == "iban:0:20"
    ibans = [x for x in got[2]["spans"].split(",") if x.startswith("iban")]
    assert ibans == [f"iban:{23 * i}:{23 * i + 22}" for i in range(5000)]


def test_redact_replaces_the_union_of_spans(make_docs, by_id):
    docs = make_docs([(1, "mail a@b.co, ip 10.0.0.1!"), (2, None), (3, ""), (4, "clean text 12"), (5, "+1 415 555 01.2.3.4x"), (6, "é😀 a@b.co")])
    out = redact(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"]) for r in out.filter("text is not null").collect())
    assert got == [(1, "mail [EMAIL], ip [IP]!"), (3, ""), (4, "clean text 12"), (5, "[PHONE]x"), (6, "é😀 [EMAIL]")]
    assert out.filter("text is null").count() == 1
    assert digest(docs.limit(0)).count() == 0


def test_cost_follows_the_length(make_docs, by_id):
    """100,000 matches in one text, in seconds."""
    n = 100_000
    mails, ibans = "a.é@b.co c@d.ef " * n, "DE89370400440532013000 " * (n // 5)
    began = time.monotonic()
    got = by_id(digest(make_docs([(1, mails), (2, ibans)])))
    assert got[1]["n_email"] == n and got[2]["spans"].count("iban") == n // 5
    clean = by_id(redact(make_docs([(1, mails), (2, ibans)])))
    assert clean[1]["text"] == "a.é@b.co [EMAIL] " * n and clean[2]["text"] == "[IBAN] " * (n // 5)
    assert time.monotonic() - began < 60


def test_redaction_of_many_overlapping_spans(make_docs, by_id):
    text = "é+1 415 555 01.2.3.4x 4111 1111 1111 1111@b.co " * 700
    assert by_id(redact(make_docs([(1, text)])))[1]["text"] == "é[PHONE]x [CARD] " * 700
