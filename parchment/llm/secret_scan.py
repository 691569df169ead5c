"""Secrets: patterns, and a battery of randomness tests with control of false discoveries.

DataFrame functions only. Kinds: assign (a keyword, a separator and a value), access (key ids), hex, and `random`: runs
of 20 or more characters of an encoding's alphabet that no pattern covers and that look drawn at random.

For each run the smallest fitting encoding is inferred (hex 16 in lower, upper or mixed case and in dashed groups, upper or
lower alphanumeric 36, alphanumeric 62, base64 66 with its URL form). Dashes of groups and the case of mixed hex carry no
digit, so they are taken out before the tests. Three tests of uniform randomness follow: chi-squared over the characters of the
alphabet (Wilson-Hilferty, one-sided), the number of runs above and below the alphabet's middle (Wald-Wolfowitz), and lag-1
serial correlation (both two-sided). Three times the least p-value is the battery's p, kept as its logarithm so that it
has no floor.

Which runs count is decided by false-discovery control over all runs of a document. The null hypothesis is ordinary text, and a
run's e-value against it is the likelihood ratio of the uniform alphabet to a unigram model of written text, times
the battery's p: a longer run can have a larger ratio, so the evidence grows with length, and a run that doesn't look
uniform loses as much as its p-value is small; one with p below `alpha` has none, as written numbers are no ordinary text either. A
factor of at most 1 keeps an e-value one. Its inverse is a p-value, and these pass Benjamini-Hochberg at rate `fdr`, which for
e-values is valid under any dependence.

Defined results: a null text counts as empty and has no spans; repeated rows are searched each; other columns are left
out; offsets are code points, end exclusive; pattern spans stay whatever the tests say; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import cut_out, found, listed, merged, n_of

_VALUE = "[A-Za-z0-9+/_.=-]"
_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
PATTERNS = {
    "assign": rf"""{_KEYWORD}["']?\x20*+[:=]\x20*+["']?{_VALUE}++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
VALUE_OF = rf"""^{_KEYWORD}["']?\x20*+[:=]\x20*+["']?({_VALUE}++)$"""
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "hex_mixed": "0123456789abcdef",
    "hex_dashed": "0123456789abcdef",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_",
}
#: Encodings from the smallest: what a run of each looks like. Mixed and dashed hex, and lower, need a digit (and a letter), so
#: that words, dates and numbers are none; groups between dashes have at least four characters.
FITS = [
    ("hex", r"^[0-9a-f]++$"),
    ("hex_upper", r"^[0-9A-F]++$"),
    ("hex_mixed", r"^(?=[^0-9]*+[0-9])[0-9A-Fa-f]++$"),
    ("hex_dashed", r"^(?=[^0-9]*+[0-9])(?=[^A-Fa-f]*+[A-Fa-f])(?!.*-[^-]{0,3}(?:-|$))[0-9A-Fa-f]{4}[0-9A-Fa-f-]++$"),
    ("upper", r"^[0-9A-Z]++$"),
    ("lower", r"^(?=[^0-9]*+[0-9])[0-9a-z]++$"),
    ("alnum", r"^[0-9A-Za-z]++$"),
]
#: Share of each letter in written English, in 1/1000 (published counts); 1.5 % each go to capitals, digits and signs.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", [127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1]))


def _surprise() -> dict[str, float]:
    """Bits of each character in ordinary text."""
    total = sum(LETTERS.values())
    bits = {c: -math.log2(0.955 * n / total) for c, n in LETTERS.items()}
    bits |= {c.upper(): -math.log2(0.015 * n / total) for c, n in LETTERS.items()}
    bits |= {c: -math.log2(0.015 / 10) for c in "0123456789"}
    return bits | {c: -math.log2(0.015 / 4) for c in "+/-_"}


def _bits_two_sided(z: Column) -> Column:
    """-log2 of the two-sided p-value of a standard normal: a logistic approximation good to 0.0002 up to 4, the tail's
    leading terms beyond."""
    a = F.abs(z)
    near = F.log2((1.0 + F.exp(1.5976 * a + 0.07056 * a * a * a)) / 2.0)
    far = a * a / 2.0 * math.log2(math.e) + F.log2(a * math.sqrt(math.pi / 2)) - F.log2(1.0 - 1.0 / (a * a))
    return F.when(a <= 4.0, near).otherwise(far)


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def battery(run: Column) -> Column:
    """(encoding, n, misfit, bits): misfit is -log2 of the battery's p, bits log2 of the likelihood ratio against ordinary text.

    One fold over the characters gathers all sums but those of chi-squared, which come from the run's length without each
    character in turn; so the cost is linear in the run's length.
    """
    bare = F.regexp_replace(run, "=+$", "")
    encoding = reduce(lambda other, fit: F.when(bare.rlike(fit[1]), fit[0]).otherwise(other), reversed(FITS), F.lit("base64"))
    surprise = F.create_map(*[F.lit(x) for pair in _surprise().items() for x in pair])
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("n", "s1", "s2", "lag", "last", "n1", "runs", "bits")], F.lit(-1.0).alias("first"), F.lit(-1).alias("side"))

    def body(e: Column) -> Column:
        return F.when(e.isin("hex_mixed", "hex_dashed"), F.lower(F.translate(bare, "-", ""))).otherwise(bare)

    def fold(e: Column) -> Column:
        alphabet = alphabets[e]
        k = F.length(alphabet)

        def add(a, char):
            def with_code(x):
                side = F.when(x * 2 >= k, 1).otherwise(0)
                return F.struct(
                    (a["n"] + 1).alias("n"),
                    (a["s1"] + x).alias("s1"),
                    (a["s2"] + x * x).alias("s2"),
                    (a["lag"] + F.when(a["n"] > 0, a["last"] * x).otherwise(0.0)).alias("lag"),
                    x.alias("last"),
                    (a["n1"] + side).alias("n1"),
                    (a["runs"] + F.when(a["side"] != side, 1.0).otherwise(0.0)).alias("runs"),
                    (a["bits"] + surprise[char]).alias("bits"),
                    F.when(a["n"] > 0, a["first"]).otherwise(x).alias("first"),
                    side.alias("side"),
                )

            return _let((F.position(char, alphabet) - 1).cast("double"), with_code)

        return F.aggregate(F.split(body(e), ""), zero, add)

    def squares(e: Column) -> Column:
        """Sum of the squared number of each character of the alphabet."""

        def of(text: Column) -> Column:
            n = F.length(text).cast("double")
            left = F.transform(F.split(alphabets[e], ""), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
            return F.aggregate(left, F.lit(0.0), lambda a, x: a + x * x)

        return _let(body(e), of)

    def misfit(a: Column, squared: Column, k: Column) -> Column:
        n, n1 = a["n"], a["n1"]
        df = k - 1.0
        chi = squared * k / n - n
        z_chi = (F.cbrt(chi / df) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        n0 = n - n1
        mean_runs = 2.0 * n1 * n0 / n + 1.0
        var_runs = F.greatest((mean_runs - 1.0) * (mean_runs - 2.0) / F.greatest(n - 1.0, F.lit(1.0)), F.lit(1e-9))
        # all on one side, or all the same: as far off as that many equal draws are unlikely
        z_runs = F.when((n1 == 0) | (n0 == 0), F.sqrt(n)).otherwise((a["runs"] - mean_runs) / F.sqrt(var_runs))
        mean = a["s1"] / n
        var = a["s2"] - n * mean * mean
        cov = a["lag"] - mean * (2.0 * a["s1"] - a["first"] - a["last"]) + (n - 1.0) * mean * mean
        z_serial = F.when(var <= 1e-9, F.sqrt(n)).otherwise((cov / var + 1.0 / n) * F.sqrt(n))
        # too even is no sign of a hand-made string, so chi-squared counts one-sided
        chi_bits = F.when(z_chi <= 0, 0.0).otherwise(_bits_two_sided(z_chi) + 1.0)
        return F.greatest(F.lit(0.0), F.greatest(chi_bits, _bits_two_sided(z_runs), _bits_two_sided(z_serial)) - math.log2(3))

    def done(t: Column) -> Column:
        a, k = t["sums"], F.length(alphabets[t["encoding"]]).cast("double")
        return F.struct(t["encoding"].alias("encoding"), a["n"].cast("int").alias("n"), misfit(a, t["squared"], k).alias("misfit"), (a["bits"] - a["n"] * F.log2(k)).alias("bits"))

    return _let(_let(encoding, lambda e: F.struct(e.alias("encoding"), fold(e).alias("sums"), squares(e).alias("squared"))), done)


def discoveries(tested: Column, alpha: float, fdr: float) -> Column:
    """Of (span, battery) pairs of one document, those whose p is at least alpha and that pass Benjamini-Hochberg over all of them."""
    m = F.size(tested)
    passing = F.filter(tested, lambda t: t["test"]["misfit"] <= -math.log2(alpha))
    evidence = lambda t: t["test"]["bits"] - t["test"]["misfit"]
    order = F.sort_array(F.transform(passing, evidence), asc=False)
    enough = F.filter(F.transform(order, lambda b, i: F.struct(b.alias("bits"), (F.log2(m / (fdr * (i + 1)))).alias("least"))), lambda x: x["bits"] >= x["least"])
    threshold = F.array_min(F.transform(enough, lambda x: x["bits"]))
    return F.when(F.size(enough) > 0, F.filter(passing, lambda t: evidence(t) >= threshold)).otherwise(F.slice(passing, 1, 0))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.001, fdr: float = 0.001) -> DataFrame:
    """(id, text, spans): spans sorted by start and kind, each with its match."""
    found_rows = _with_spans(docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")), F.col("__text"), alpha, fdr)
    return found_rows.select(F.col("__row.__id").alias(id_col), F.col("__text").alias(text_col), F.col("__spans").alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", alpha: float = 0.001, fdr: float = 0.001) -> DataFrame:
    """docs with all columns; each secret in the text is replaced by [SECRET]. Where that changes a text, size_col, if there
    is one of this name, gets its new length in code points; other rows, also those of null texts, stay as they are."""
    found_rows = _with_spans(docs, docs[text_col], alpha, fdr)
    changed = F.size("__spans") > 0
    new = {text_col: redacted(F.col("__text"), F.col("__spans"))}
    rows = found_rows.select("__row", changed.alias("__changed"), F.when(changed, new[text_col]).otherwise(F.col("__row")[text_col]).alias("__new"))

    def column(name: str, kind) -> Column:
        old = F.col("__row").getField(name)
        if name == text_col:
            return F.col("__new").alias(name)
        if name == size_col:
            return F.when(F.col("__changed"), F.length("__new").cast(kind)).otherwise(old).alias(name)
        return old.alias(name)

    return rows.select(*[column(f.name, f.dataType) for f in docs.schema])


def _with_spans(docs: DataFrame, text: Column, alpha: float, fdr: float) -> DataFrame:
    """(__row, __text, __spans): the row as a struct, so that no column name clashes; its text, not null; its spans."""
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.coalesce(text, F.lit("")).alias("__text"))
    text = F.col("__text")
    hints = {"assign": text.rlike(f"{_KEYWORD}[\"']?\\x20*+[:=]"), "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{24}")}
    keep = {"assign": lambda m: F.length(F.regexp_extract(m, VALUE_OF, 1)) >= 6}
    df = df.select("*", *[found(text, rx, kind, i, hints[kind], keep.get(kind)).alias(f"__{kind}") for i, (kind, rx) in enumerate(PATTERNS.items())], found(text, RUN, "random", len(PATTERNS), text.rlike("[A-Za-z0-9+/_-]{20}")).alias("__runs"))
    df = df.select("__row", "__text", "__runs", merged(*[F.col(f"__{kind}") for kind in PATTERNS]).alias("__base"))
    free = F.filter("__runs", lambda r: ~F.exists("__base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    df = df.select("__row", "__text", "__base", free.alias("__free"))
    tested = F.transform("__free", lambda r: F.struct(r.alias("span"), battery(r["match"]).alias("test")))
    df = df.select("__row", "__text", "__base", F.when(F.size("__free") > 0, tested).otherwise(F.slice(tested, 1, 0)).alias("__tested"))
    added = F.transform(discoveries(F.col("__tested"), alpha, fdr), lambda t: t["span"])
    spans = F.when(F.size("__tested") > 0, merged(F.col("__base"), added)).otherwise(F.col("__base"))
    return df.select("__row", "__text", spans.alias("__spans"))


def redacted(text: Column, spans: Column) -> Column:
    return cut_out(text, spans, lambda s: F.lit("[SECRET]"))


def digest(found_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, digest and list that the query returns."""
    df = found_rows.select(id_col, "spans", F.filter("spans", lambda s: s["kind"].isin(*PATTERNS)).alias("__base"))
    return df.select(
        id_col,
        *[n_of(F.col("__base"), kind).alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(listed(F.col("__base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
