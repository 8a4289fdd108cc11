"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written `<|im_start|>role LF text <|im_end|> LF`. A deterministic parser reads it back; where
what it reads differs from the source, the text is escaped (one more backslash between `<` and `|`)
and read again until both are the same. The parser takes one backslash from every `<\\...\\|`, so a text
that merely looks escaped also fails the first reading, and the second reading always succeeds.
Roles are written with `\\s`, `\\n`, `\\p` for backslash, line feed and bar, hence never clash.

A conversation is gathered in two steps, chunks of neighbouring turns first and then the chunks, so
that no task sorts all turns of a long one. Its text is one string, since that is the result.

Edge cases: null role or text counts as empty; rows without conv_id form one conversation with a null
id; turns without number come first; rows of one turn number are ordered by role and text, and
repeated rows are kept; an empty table gives no conversations; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import running_sums

START, END = "<|im_start|>", "<|im_end|>"
TURNS_A_CHUNK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<$1\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)\\\|"), F.lit("<$1|"))


def _role(role: Column) -> Column:
    for plain, code in (("\\", r"\s"), ("\n", r"\n"), ("|", r"\p")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unrole(code: Column) -> Column:
    for plain, written in (("\n", r"\n"), ("|", r"\p"), ("\\", r"\s")):
        code = F.replace(code, F.lit(written), F.lit(plain))
    return code


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _role(role), F.lit("\n"), text, F.lit(END + "\n"))


def _pieces(formatted: Column) -> Column:
    """What follows each turn's start mark."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _turn(piece: Column) -> Column:
    """struct<role, text> of a piece; null where it is not role, line feed, text, end mark, line feed."""
    line, end = F.instr(piece, "\n"), F.instr(piece, END)
    whole = (line > 0) & (end > line) & (end + len(END) == F.length(piece)) & piece.endswith("\n")
    return F.when(
        whole,
        F.struct(
            _unrole(F.substr(piece, F.lit(1), line - 1)).alias("role"),
            unescape(F.substr(piece, line + 1, end - line - 1)).alias("text"),
        ),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    return F.transform(_pieces(formatted), _turn)


def render_turn(role: Column, text: Column) -> Column:
    """A turn, its text escaped as far as reading it back needs."""

    def read_back(written: Column) -> Column:
        source = F.array(F.struct(role.alias("role"), text.alias("text")))
        return F.coalesce(parse(written) == source, F.lit(False))

    plain, escaped = _render(role, text), _render(role, escape(text))
    lost = F.raise_error(F.lit("a turn is not read back as written")).cast("string")
    return F.when(read_back(plain), plain).when(read_back(escaped), escaped).otherwise(lost)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) of turns(conv_id, turn, role, text)."""
    written = turns.select(
        "conv_id", "turn", F.floor(F.col("turn") / TURNS_A_CHUNK).alias("chunk"),
        render_turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("written"),
    )

    def joined(first: str, text: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(first), F.lit(-(1 << 62))).alias("k"), F.col(text).alias("t"))))
        return F.array_join(F.transform(listed, lambda x: x["t"]), "")

    chunks = written.groupBy("conv_id", "chunk").agg(joined("turn", "written").alias("written"))
    return chunks.groupBy("conv_id").agg(joined("chunk", "written").alias("formatted"))


def with_loss_spans(formatted: DataFrame, role: str = "assistant", length: Callable[[Column], Column] = F.length) -> DataFrame:
    """formatted(formatted, ...) with loss_spans: array<struct<start, end>>, the mask of what training
    counts in a conversation. length says what they count: code points, or bytes with F.octet_length."""
    pieced = formatted.withColumn("pieces_", _pieces(F.col("formatted")))
    stepped = pieced.withColumn("steps_", F.transform("pieces_", lambda p: length(p) + len(START)))
    marked = F.zip_with(
        F.col("pieces_"), F.slice(running_sums(F.col("steps_")), 1, F.size("pieces_")),
        lambda p, at: F.struct(
            (at + len(START) + length(F.substring_index(p, "\n", 1)) + 1).alias("start"), (at + len(START) + length(F.substring_index(p, END, 1))).alias("end"),
            _turn(p)["role"].alias("role"),
        ),
    )
    own = F.transform(F.filter(marked, lambda x: x["role"] == role), lambda x: F.struct(x["start"], x["end"]))
    return stepped.withColumn("loss_spans", own).drop("pieces_", "steps_")


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the mask's spans (in bytes) cut out of a formatted conversation, unescaped, in order."""

    def cut(written: Column) -> Column:
        piece = lambda x: unescape(F.substring(written, x["start"] + 1, x["end"] - x["start"]).cast("string"))
        return F.array_join(F.transform(spans, piece), "")

    # A lambda's variable is read without copying, so that cutting takes time by the pieces' length.
    return F.get(F.transform(F.array(formatted.cast("binary")), cut), 0)


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from what was written: the turns by the parser, the loss by the mask."""
    written = with_loss_spans(format_conversations(turns), length=F.octet_length)
    read = written.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = read.withColumn("said", F.array_join(said, "")).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return loss.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
