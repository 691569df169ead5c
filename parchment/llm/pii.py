"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

DataFrame functions only. Kinds: email, ip, card (Luhn), phone; and beyond these iban (mod 97) and ssn, which count only
if their score reaches `threshold`. Spans of the first four kinds stay whatever their score.

Defined results: a null text counts as empty and has no spans; repeated rows are searched each; other columns are left
out; offsets are code points, end exclusive; overlapping spans of different kinds are all reported; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import blocks_of, cut_out, found, listed, merged, n_of, stretch

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
PATTERNS = {
    # \G: right after the last match a run may begin in its middle
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and what a context word within reach adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|courriel|correo",
    "ip": r"(?i)\bip\b|host|server|address|adresse",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel\b|call|mobile|fax|telefon|m[oó]vil",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social|security|insurance",
}
CONTEXT_GAIN, REACH = 0.3, 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    reversed_digits = F.split(F.reverse(digits), "")

    def value(d, i):
        twice = d.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(reversed_digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, leave 1 by 97."""
    turned = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)) == 1


def _confirmed(kind: str):
    """Of a match of this kind, whether its checksum or size confirms it; None if nothing has to."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    bare = lambda m: F.replace(m, F.lit(" "))
    return {
        "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda m: (F.length(m) >= 14) & F.length(digits(m)).between(14, 19) & luhn(digits(m)),
        "phone": lambda m: F.length(digits(m)).between(10, 15),
        "iban": lambda m: F.length(bare(m)).between(15, 34) & mod_97(bare(m)),
    }.get(kind)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, text, spans): spans sorted by start and kind, each with its match and score."""
    hints = {
        "email": lambda t: t.contains("@"),
        "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
        "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": lambda t: t.rlike(r"\+[0-9]"),
        "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
        "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    }
    df = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    text = F.col("__text")
    df = df.select("*", *[found(text, rx, kind, i, hints[kind](text), _confirmed(kind)).alias(f"__{kind}") for i, (kind, rx) in enumerate(PATTERNS.items())])
    df = df.select("__id", "__text", merged(*[F.col(f"__{kind}") for kind in PATTERNS]).alias("__spans"))
    df = df.select("*", F.when(F.size("__spans") > 0, blocks_of(text)).alias("__blocks"))
    blocks = F.col("__blocks")

    def scored(s):
        around = F.concat(
            stretch(blocks, F.greatest(s["start"] - REACH, F.lit(0)), F.least(s["start"], F.lit(REACH))),
            F.lit(" "),
            stretch(blocks, s["end"], F.lit(REACH)),
        )
        score = F.lit(0.0)
        for kind in PATTERNS:
            score = F.when(s["kind"] == kind, PRIOR[kind] + F.when(around.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)).otherwise(score)
        return F.struct(s["start"], s["rank"], s["end"], s["kind"], s["match"], F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform("__spans", scored)
    kept = F.filter(spans, lambda s: s["kind"].isin(*BASE) | (s["score"] >= threshold))
    return df.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), kept.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    return cut_out(text, spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def digest(found_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, digest and list that the query returns."""
    df = found_rows.select(id_col, "spans", F.filter("spans", lambda s: s["kind"].isin(*BASE)).alias("__base"))
    return df.select(
        id_col,
        *[n_of(F.col("__base"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(F.col("__base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
