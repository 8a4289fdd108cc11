import random

import brute
from pyspark.sql import functions as F

from ledgerlane.llm.chat_format import END, START, digest, escape, format_conversations, parse, unescape, with_loss_spans

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
BITS = ["<", "|", "\\", "im_start", "im_end", ">", "<|", "|>", START, END, "<\\|", "<\\\\|", "\n", "é😀", " ", "$1"]


def rows():
    rng = random.Random(2)
    out = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(BITS, k=rng.randint(0, 9)))) for c in range(60) for t in range(5)]
    out += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    out += [(101, 0, None, None), (101, None, "assistant", "early"), (101, 1, "odd|role\n\\s", "x"), (101, 1, "odd|role\n\\s", "x"), (101, 1, "assistant", "tie")]
    return [*out, (None, 0, "user", "no id"), (102, 0, "assistant", "y" * 100_000)]


def test_read_back_matches_brute_force(spark):
    data = rows()
    got = {r["conv_id"]: r for r in digest(spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)).collect()}
    want = {}
    for c, t, role, text in data:
        want.setdefault(c, []).append((-(1 << 62) if t is None else t, role, text))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == brute.conversation(turns), c


def test_escape_is_reversible_and_hides_marks(spark):
    rng = random.Random(4)
    texts = spark.createDataFrame([("".join(rng.choices(BITS, k=8)),) for _ in range(300)], "t string")
    both = texts.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("back"))
    assert all(r["back"] == r["t"] and "<|" not in r["e"] for r in both.collect())


def test_plain_texts_are_not_escaped_and_loss_spans_fit(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a < b", ""), (1, 1, "assistant", "né 😀", ""), (1, 2, "assistant", "", "")], SCHEMA)
    r = with_loss_spans(format_conversations(turns)).select("formatted", F.col("loss_spans").alias("spans"), parse(F.col("formatted")).alias("turns")).first()
    assert r["formatted"] == "<|im_start|>user\na < b<|im_end|>\n<|im_start|>assistant\nné 😀<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [r["formatted"][s["start"] : s["end"]] for s in r["spans"]] == ["né 😀", ""]
    assert [t["text"] for t in r["turns"]] == ["a < b", "né 😀", ""]
    assert digest(turns.limit(0)).count() == 0
