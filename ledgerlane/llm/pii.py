"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts a score.

DataFrame functions only. For each kind, split() gives the gaps between the matches and
regexp_extract_all() the matches themselves, so a running sum of their lengths gives the offsets.
Sums, maxima and choices run in blocks, context is read from the gaps, and redaction cuts the text by
bytes, so that the cost of a text is in proportion to its length, however many matches it has.

Kinds: email; ip (parts at most 255); card (14 to 19 digits, Luhn); phone (10 to 15 digits after a
plus); and, beyond these four, iban (country, check digits, 11 to 30 further characters, mod 97 = 1).
What follows an account number may look like more of it, so of the prefixes that end at a word's end
the one of its country's length is taken, else the longest that passes; the search goes on after it.
Offsets are code points, end exclusive. A span's score is its kind's base score, plus 0.1 when one of
the kind's words stands in the 40 characters before it, less 0.1 when a word of another use does; what
stands before the last match of the kind's pattern belongs to that match and isn't read.

Edge cases: a null or empty text has no spans (redact() leaves it as it is); repeated rows are
handled one by one; other columns stay; a column with the name of an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.scalar import once
from ledgerlane.llm.common import aside, back, running, running_sums

# Possessive quantifiers and the lookbehinds keep scanning linear; they match what the plain forms
# match. An e-mail may start inside a run of its characters only where the last match ended (\G).
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Only the first four characters are consumed; the group is the longest candidate from there.
_IBAN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}"
_IBAN_HEAD = 4
_CONTEXT, _BLOCK = 40, 256

#: Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    near: str
    far: str
    hint: str  # what any confirmed match holds: a cheap test of the text


KINDS = (
    Kind("email", _EMAIL, 0.8, "mail|contact|write|schreib|correo|courriel", "example|noreply", "@"),
    Kind("ip", _IP, 0.6, r"ip|address|host|server|adresse", r"version|release|section|v\.", r"[0-9]\.[0-9]"),
    Kind("card", _CARD, 0.8, "card|visa|credit|payment|karte|tarjeta|carte", "order|serial|tracking|isbn", r"[0-9](?:[ -]?[0-9]){13}"),
    Kind("phone", _PHONE, 0.7, r"phone|call|tel|mobile|fax|telefon", "fax only|sku", r"\+[0-9]"),
    Kind("iban", _IBAN, 0.8, "iban|account|konto|bank|compte|cuenta", "key|token|secret", "[A-Z]{2}[0-9]{2}"),
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits pass Luhn: every second digit from the right counts double, less 9 over 9."""
    d = F.split(F.reverse(_digits(s)), "(?<=.)(?=.)")

    def worth(x: Column, i: Column) -> Column:
        v = x.cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(d, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(s: Column) -> Column:
    """Whether the account number, its first four characters moved to the end and letters read as
    10 to 35, leaves 1 modulo 97."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(a: Column, x: Column) -> Column:
        v = F.ascii(x)
        return F.when(v >= 65, a * 100 + v - 55).otherwise(a * 10 + v - 48) % 97

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _account(s: Column) -> Column:
    """The confirmed prefix of a candidate, or null."""
    words = F.split(s, " ")
    prefixes = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    bare = lambda p: F.length(F.replace(p, F.lit(" "), F.lit("")))
    good = F.filter(prefixes, lambda p: F.when(bare(p).between(15, 34), _mod97(p)).otherwise(False))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    fits = F.filter(good, lambda p: F.coalesce(bare(p) == F.try_element_at(lengths, F.substring(p, 1, 2)), F.lit(False)))
    return F.get(F.concat(fits, good), 0)


def _confirmed(kind: Kind, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind.name == "ip":
        part = F.regexp_replace(s, r"(?<![0-9])0+(?=[0-9])", "")
        return ~F.exists(F.split(part, r"\."), lambda x: (F.length(x) > 3) | (F.lpad(x, 3, "0") > "255"))
    if kind.name == "card":
        return F.when(n.between(14, 19), _luhn(s)).otherwise(False)
    if kind.name == "phone":
        return n.between(10, 15)
    if kind.name == "iban":
        return s.isNotNull()  # detect() has replaced candidates by what is confirmed of them
    return F.lit(True)


def _consumed(kind: Kind, match: Column, length: Callable[[Column], Column]) -> Column:
    """How much of the text the pattern takes for a match."""
    return F.lit(_IBAN_HEAD) if kind.name == "iban" else length(match)


def _apart(spans: Column) -> Column:
    """Spans in order, without those that begin before the end of one that is kept. They are chosen
    in blocks, each of which hands the last end on."""
    none = F.slice(spans, 1, 0)

    def choose(state: Column, x: Column) -> Column:
        taken = F.struct(F.array_append(state["kept"], x).alias("kept"), x["end"].alias("last"))
        return F.when(x["start"] < state["last"], state).otherwise(taken)

    def block(state: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(spans, b * _BLOCK + 1, _BLOCK), F.struct(none.alias("kept"), state["last"].alias("last")), choose)
        added = lambda o: F.struct(F.array_append(state["kept"], o["kept"]).alias("kept"), o["last"].alias("last"))
        return F.get(F.transform(F.array(own), added), 0)

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int"))
    kept = F.flatten(F.aggregate(blocks, F.struct(F.slice(F.array(none), 1, 0).alias("kept"), F.lit(-1).alias("last")), block)["kept"])
    met = F.exists(F.zip_with(spans, F.slice(spans, 2, F.size(spans)), lambda x, y: x["end"] > y["start"]), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(met, kept).otherwise(spans)


def _test(kind: Kind) -> Callable[[Column], Column]:
    return lambda match: _confirmed(kind, match)


def _step(kind: Kind, length: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda gap, match: length(gap) + _consumed(kind, match, length)


def _of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda span: span["rank"] == rank


def _spans_of(kind: Kind, found: Column, gaps: Column, steps: Column, length: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, kind, rank, score>> of one kind, in order, from its matches, the gaps
    before them, and what each consumes of the text with its gap."""
    ends = F.slice(running_sums(steps), 2, F.size(found))
    matched = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.substring(g, -_CONTEXT, _CONTEXT).alias("before")))
    good = F.filter(
        F.zip_with(matched, ends, lambda x, e: F.struct(x["m"].alias("m"), x["before"].alias("before"), e.alias("e"))),
        lambda x: _confirmed(kind, x["m"]),
    )

    def scored(x: Column) -> Column:
        start = x["e"] - _consumed(kind, x["m"], length)
        before = F.lower(x["before"])
        near = F.when(F.rlike(before, F.lit(rf"\b(?:{kind.near})")), 0.1).otherwise(0.0)
        far = F.when(F.rlike(before, F.lit(rf"\b(?:{kind.far})")), 0.1).otherwise(0.0)
        return F.struct(
            start.alias("start"), (start + length(x["m"])).alias("end"), F.lit(kind.name).alias("kind"),
            F.lit(KINDS.index(kind)).alias("rank"), F.round(F.lit(kind.score) + near - far, 2).alias("score"),
        )

    return F.transform(good, scored)


def detect(docs: DataFrame, length: Callable[[Column], Column] = F.length) -> DataFrame:
    """docs with pii: array<struct<start, end, kind, rank, score>>, by start, then kind as listed.
    length says what offsets count: code points, or bytes with F.octet_length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,rank:int,score:double>>")
    # Each step is a projection of its own, so that matches are searched for once and lambdas read
    # columns instead of evaluating expressions again and again.
    out = docs.withColumns({
        f"pii_{k.name}_": F.when(F.rlike(text, F.lit(k.hint)), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(int(k.name == "iban"))))
        for k in KINDS
    })
    out = out.withColumn("pii_iban_", F.transform("pii_iban_", _account))
    found, gaps, steps = ({k: F.col(f"pii_{k.name}_{x}") for k in KINDS} for x in ("", "gaps_", "steps_"))
    out = out.withColumns({
        f"pii_{k.name}_gaps_": F.when(F.exists(found[k], _test(k)), F.slice(F.split(text, k.pattern, -1), 1, F.size(found[k])))
        for k in KINDS
    })
    out = out.withColumns({f"pii_{k.name}_steps_": F.zip_with(gaps[k], found[k], _step(k, length)) for k in KINDS})
    parts = [
        F.when(steps[k].isNotNull(), _spans_of(k, found[k], gaps[k], steps[k], length)).otherwise(none)
        for k in KINDS
    ]
    out = out.withColumn("pii_iban_", parts.pop()).withColumn("pii_all_", F.concat(*parts, _apart(F.col("pii_iban_"))))
    in_order = F.sort_array(F.transform("pii_all_", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x.alias("s"))))
    # A filter on what is found must not repeat the search in its condition: hence once().
    return out.withColumn("pii", once(F.transform(in_order, lambda x: x["s"]))).drop(
        "pii_all_", *[f"pii_{k.name}_{x}" for k in KINDS for x in ("", "gaps_", "steps_")]
    )


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs, same columns, with the union of all spans of each text replaced by [KIND]; overlapping
    spans become one, named for the first."""
    found = detect(aside(docs, "text"), F.octet_length)
    found = found.withColumn("ends_", F.transform("pii", lambda x: x["end"])).withColumn("bytes_", F.col("text").cast("binary"))
    found = found.withColumn("done_", running(F.col("ends_"), lambda a, x: F.greatest(a, x), F.lit(0)))  # where the spans before each end

    def pieces(text: Column) -> Column:
        def piece(x: Column, done: Column) -> Column:
            between = F.substring(text, done + 1, x["start"] - done).cast("string")
            return F.when(x["start"] >= done, F.concat(between, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        return F.array_join(F.zip_with(F.col("pii"), F.slice("done_", 1, F.size("pii")), piece), "")

    # A binary column is copied whenever it is read from a row, a lambda's variable isn't.
    cleaned = F.get(F.transform(F.array("bytes_"), pieces), 0)
    last = F.element_at("done_", -1)
    tail = F.substring(F.col("bytes_"), last + 1, F.octet_length("bytes_") - last).cast("string")
    whole = F.when(F.size("pii") > 0, F.concat(cleaned, tail)).otherwise(F.col("text"))
    return back(found.withColumn("whole_", once(whole)), docs.columns, text=F.col("whole_"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, the hash of the base spans, and all spans."""
    found = detect(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda x: x["rank"] < 4)
    counts = [
        F.size(F.filter("pii", _of_rank(k))).cast("long").alias(f"n_{KINDS[k].name}")
        for k in range(4)
    ]
    scores = F.array_join(F.transform("pii", lambda x: F.format_string("%.2f", x["score"])), ",")
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"), scores.alias("scores"),
    )
