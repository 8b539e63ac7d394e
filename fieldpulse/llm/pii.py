"""Personal data: patterns propose spans, checks confirm them, context words adjust the score.

Everything happens inside the row, so the operator neither shuffles nor explodes. The
pieces of a text between matches and the matches themselves come from the same pattern;
their running lengths are the positions. Patterns are written so that a failed attempt
is not repeated inside a run of characters, which keeps long texts linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed

# A span is reported from this score on.
LEAST_SCORE = 0.5
# Characters before and after a span in which context words count.
CONTEXT_CHARS = 40
# Added to the score when a context word is near.
CONTEXT_BONUS = 0.3
# Running sums are taken in chunks of so many matches.
_CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``score`` is that of a confirmed span without context; a span that its check does
    not confirm is dropped. ``hint`` is a string without which a text has no match.
    """

    name: str
    pattern: str
    score: float
    context: tuple[str, ...]
    hint: str = ""


# Kinds in the order of their rank, and their patterns. Lookbehind, \G (the
# end of the match before) and possessive repeats change no match: a match that starts
# inside a run of its first class would have started at the head of that run.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        ("mail", "contact", "kontakt", "correo", "courriel"),
        "@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6,
        ("ip", "host", "server", "address", "adresse"),
        ".",
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9])++",
        0.7,
        ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        0.6,
        ("phone", "call", "tel", "fax", "mobil", "llame"),
        "+",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        0.8,
        ("iban", "account", "konto", "compte", "cuenta"),
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        0.3,
        ("ssn", "social", "security"),
        "-",
    ),
)
BASE_KINDS = ("email", "ip", "card", "phone")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """The check of an IBAN: first four characters last, letters as 10 to 35, modulo 97."""
    compact = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    codes = F.transform(F.split(turned, ""), F.ascii)
    return F.aggregate(
        codes,
        F.lit(0),
        lambda rest, code: (
            F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97
        ).cast("int"),
    )


def _confirmed(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        # As a double, so that a part of any length is compared by its value.
        return F.forall(F.split(text, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        length = F.length(F.replace(text, F.lit(" "), F.lit("")))
        return length.between(15, 34) & (_mod97(text) == 1)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sum of all entries before each entry."""

    def before(values: Column) -> Column:
        sums = F.aggregate(
            values,
            F.array(F.lit(0).cast("long")),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        )
        return F.slice(sums, 1, F.size(values))

    last = F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), last), lambda c: F.slice(lengths, c * _CHUNK + 1, _CHUNK)
    )
    totals = F.transform(
        chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    )
    parts = F.zip_with(chunks, before(totals), lambda c, b: F.transform(before(c), lambda p: p + b))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(parts))


def _with_spans(df: DataFrame, text: str, kind: Kind, rank: int) -> DataFrame:
    """Add the confirmed spans of one kind as an array ``_spans_<kind>``."""
    pattern, kept = F.lit(kind.pattern), df.columns
    possible = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    none = F.array().cast("array<string>")
    found = df.withColumn(
        "_found", F.when(possible, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)
    )
    # Most texts have no match and are not split.
    some = F.size("_found") > 0
    found = found.withColumn("_gaps", F.when(some, F.split(text, kind.pattern, -1)).otherwise(none))
    steps = F.zip_with("_gaps", "_found", lambda g, m: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0)))
    found = found.withColumn("_before", F.when(some, _running(steps)))
    words = r"(?i)\b(?:" + "|".join(kind.context) + r")\b"

    def span(match: Column, i: Column) -> Column:
        start = F.get("_before", i) + F.char_length(F.get("_gaps", i))
        near = F.concat_ws(
            " ",
            F.right(F.get("_gaps", i), F.lit(CONTEXT_CHARS)),
            F.left(F.get("_gaps", i + 1), F.lit(CONTEXT_CHARS)),
        )
        bonus = F.when(F.rlike(near, F.lit(words)), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            start.cast("long").alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            (start + F.char_length(match)).cast("long").alias("end"),
            match.alias("text"),
            F.least(F.lit(1.0), F.lit(kind.score) + bonus).alias("score"),
        )

    spans = F.transform("_found", span)
    checked = F.filter(spans, lambda s: _confirmed(kind.name, s["text"]))
    return found.select(*kept, checked.alias(f"_spans_{kind.name}"))


def find_pii(docs: DataFrame, text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """Add ``pii``: the spans of personal data in each text, by start and rank of kind.

    A span has ``start`` and ``end`` in code points (end exclusive), ``rank``, ``kind``,
    ``text`` and ``score``. Matches of a kind are the leftmost ones without overlap; one
    that fails its check is dropped and not tried again. Spans of the base kinds are
    always reported, those of other kinds from ``least_score`` on. Null and empty texts
    have an empty list. All rows and columns are returned; a column named ``pii`` is
    replaced. An empty table gives an empty table.
    """
    sealed = Sealed.of(docs)
    text = F.coalesce(F.col(sealed.name(text_col)), F.lit(""))
    found = sealed.frame.withColumn("_text", text)
    for rank, kind in enumerate(KINDS):
        found = _with_spans(found, "_text", kind, rank)
    spans = F.concat(*[f"_spans_{k.name}" for k in KINDS])
    good = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS) | (s["score"] >= least_score))
    return sealed.open(found, {"pii": F.array_sort(good)})
