"""Text functions as Column expressions. Regular expressions name their character classes, so that Unicode counts as it
should whatever the engine's shorthands mean: WORD is a letter, digit or underscore, SPACE any Unicode white space."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment import config as C

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD}./-]+"
EVAL_TOKEN = rf"[{WORD}./'-]+"
START, END = rf"(?:^|[^{WORD}])", rf"(?:$|[^{WORD}])"

# What headings, furniture and tags look like.
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
CONTENTS_LINE = rf"\.{{5,}}[{SPACE}]*\p{{Nd}}+[{SPACE}]*$"
HEADER_LINE = rf"^(?:MS ID/Ver|Dok-ID/Vers)[{SPACE}]"
NUMBER_LINE = r"^\p{Nd}{1,3}$"
FOOTER_LINE = (
    rf"(?s)^(?:\p{{Nd}}{{1,2}}\.[{SPACE}]*(?:{MONTHS})[{SPACE}]+\p{{Nd}}{{4}}|©.*Folie[{SPACE}]*\p{{Nd}}+.*"
    rf"|Folie[{SPACE}]*\p{{Nd}}+|©[{SPACE}]*[^{SPACE}].*(?:AG|GmbH))[{SPACE}]*$"
)
NUMBERED_HEADING = rf"(?s)^(\p{{Nd}}{{1,2}}(?:\.\p{{Nd}}{{1,2}}){{0,3}})[{SPACE}]+([A-ZÄÖÜ].{{2,80}})$"
MARKED_HEADING = rf"(?s)^(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*#*$"
TAGS = {
    "frist": rf"{START}(?:frist(?:en)?|innerhalb|binnen|spätestens|spaetestens|werktag[{WORD}]*|arbeitstag[{WORD}]*|stunden?|tagen?|wochen?|monaten?){END}",
    "schwellenwert": rf"(?:chf[{SPACE}]*\p{{Nd}}|franken|schwellenwert[{WORD}]*|\p{{Nd}}['’]\p{{Nd}}{{3}}|[≥≤<>][{SPACE}]*\p{{Nd}}|mindestens|höchstens|hoechstens)",
    "zustaendigkeit": rf"{START}(?:zuständig[{WORD}]*|zustaendig[{WORD}]*|verantwortlich[{WORD}]*|obliegt|verantwortliche stelle|federführ[{WORD}]*|federfuehr[{WORD}]*){END}",
}
STOP_WORDS = """
aber alle allen aller alles als also andere anderen auch auf aus bei beim dass dazu dann der die das dem den des dieser
diese dieses dort durch eine einen einem eines einer eine fuer für hat haben hier ihre ihrer ist kann kein keine koennen
können mehr muss müssen nach nicht noch nur oder sein sich sind sowie über und unter vom von vor wenn werden wird wurde
zum zur zwischen dabei damit daher jedoch sowohl bzw etwa insbesondere gemaess gemäss grundsaetzlich grundsätzlich regel
falls sofern soweit welche welcher
""".split()
# End of fixed values.


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def in_python(regex: str) -> re.Pattern:
    """A pattern of this module for Python, whose \\w, \\s and \\d are WORD, SPACE and \\p{Nd}."""
    return re.compile(regex.replace(f"[^{SPACE}]", r"\S").replace(f"[{SPACE}]", r"\s").replace(WORD, r"\w").replace(r"\p{Nd}", r"\d"))


HYPHEN, CONTENTS, FOOTER, BLANKS = (in_python(rx) for rx in (rf"-[{SPACE}]*\n[{SPACE}]*", CONTENTS_LINE, FOOTER_LINE, r"[ \t]{2,}"))
HEADERS = ("MS ID/Ver", "Dok-ID/Vers")


def joined(text: str) -> str:
    """text without soft hyphens and without hyphens at line ends."""
    return HYPHEN.sub("", text.replace("\u00ad", ""))


def is_plain_furniture(x: str) -> bool:
    """A trimmed line that matches CONTENTS_LINE, HEADER_LINE or NUMBER_LINE. Plain tests say which lines need a pattern."""
    if "....." in x and CONTENTS.search(x):
        return True
    if x.startswith(HEADERS) and any(x.startswith(h) and x[len(h) : len(h) + 1].isspace() for h in HEADERS):
        return True
    return len(x) <= 3 and x.isdecimal()


def is_furniture(x: str) -> bool:
    """The same, or one that matches FOOTER_LINE."""
    return is_plain_furniture(x) or (x[0].isdecimal() or x[0] in "©F") and bool(FOOTER.match(x))


def lines_of(text: str) -> list[str]:
    """clean_lines() of one text."""
    out = []
    for x in joined(text).split("\n"):
        if x != C.PAGE_BREAK:
            x = x.strip()
            if not x or is_furniture(x):
                continue
            if "  " in x or "\t" in x:
                x = BLANKS.sub(" ", x)
        out.append(x)
    return out


def clean_lines(text: Column) -> Column:
    """The lines that carry text, trimmed; page breaks stay as lines of their own."""

    @F.pandas_udf("array<string>")
    def cleaned(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else lines_of(t))

    return cleaned(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: A text that has none of these, once its case is folded, has no match of the tag's pattern.
TAG_PARTS = {
    "frist": "frist innerhalb binnen spätestens spaetestens werktag arbeitstag stunde tagen woche monate".split(),
    "schwellenwert": "chf franken schwellenwert ' ’ ≥ ≤ < > mindestens höchstens hoechstens".split(),
    "zustaendigkeit": "zuständig zustaendig verantwortlich obliegt federführ federfuehr".split(),
}
TAG_PATTERNS = {tag: re.compile(in_python(rx).pattern, re.I) for tag, rx in TAGS.items()}


def tags_of(text: str) -> list[str]:
    """Heuristic tags of one text in fixed order."""
    low = text.casefold()
    dotless = "\u0130" in text or "\u0131" in text  # these count as i, but don't fold to it
    return [tag for tag, rx in TAG_PATTERNS.items() if (dotless or any(p in low for p in TAG_PARTS[tag])) and rx.search(text)]


def tags(text: Column, seeds: Column | None = None) -> Column:
    """Heuristic tags in fixed order, then lower-cased seeds; each once."""

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if t is None else tags_of(t))

    own = found(text)
    return own if seeds is None else F.array_distinct(F.concat(own, F.transform(seeds, F.lower)))


def garbage_metrics(text: Column) -> tuple[Column, Column, Column]:
    """Share of letters, words of three letters or more by 100 characters, share of broken characters."""
    n = F.length(text)

    def share(rx: str, empty: float, by: float = 1.0) -> Column:
        return F.when(n > 0, F.regexp_count(text, F.lit(rx)) * by / n).otherwise(F.lit(empty))

    return share(r"\p{L}", 1.0), share(r"\p{L}{3,}", 100.0, 100.0), share(r"[\x{fffd}\x{80}-\x{9f}]", 0.0)


def is_garbage(alpha: Column, density: Column, broken: Column) -> Column:
    return ((alpha < C.GARBAGE_ALPHA) & (density < C.GARBAGE_DENSITY)) | (broken > C.GARBAGE_MOJIBAKE)


def gold_terms(answer: Column) -> Column:
    """Terms of a model answer: with a digit, or long enough and no stop word; the first of each, at most MAX_TERMS."""
    found = F.regexp_extract_all(F.lower(answer), F.lit(EVAL_TOKEN), F.lit(0))
    bare = F.filter(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"^[./'-]+|[./'-]+$", ""))), lambda t: t != "")
    useful = F.filter(bare, lambda t: t.rlike(r"\p{Nd}") | ((F.length(t) >= C.MIN_TERM) & ~t.isin(*STOP_WORDS)))
    return F.slice(useful, 1, C.MAX_TERMS)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def sender_label(header: Column) -> Column:
    """The name of a From header, else the local part of its address with blanks for dots, else the header."""
    raw = strip(header)
    name = strip(F.regexp_extract(raw, rf"""^[{SPACE}]*"?([^"<]+?)"?[{SPACE}]*<[^>]+>[{SPACE}]*$""", 1))
    name = F.regexp_replace(name, """^["']+|["']+$""", "")
    local = F.replace(F.regexp_extract(raw, rf"([{WORD}.\-]+)@", 1), F.lit("."), F.lit(" "))
    return F.when(name != "", name).when(local != "", local).otherwise(raw)


def label(text: Column) -> Column:
    """A name that is safe in a file's name."""
    return F.substring(F.regexp_replace(text, rf"[^{WORD}.-]", "_"), 1, 60)


def term_of(question: Column, topic: Column) -> Column:
    """The heading of a glossary entry: its topic, else what the question asks about."""
    asked = F.regexp_extract(question, rf"(?isu)^[{SPACE}]*(?:Was[{SPACE}]+(?:ist|bedeutet|sind)|Wof(?:ue|ü)r[{SPACE}]+steht)[{SPACE}]+(.+?)[{SPACE}]*\??$", 1)
    term = F.regexp_replace(F.when(asked != "", asked).otherwise(question), r"^[ ?]+|[ ?]+$", "")
    return F.when(topic != "", topic).otherwise(F.substring(term, 1, 80))


def title_of(source: Column) -> Column:
    """A readable title from a file's name; empty where fewer than three letters are left."""
    stem = F.regexp_replace(source, r"(?<=.)\.[^./]*$", "")
    ids = r"(?<![A-Za-z0-9])(?:ar-)?[A-Z]-?[0-9A-F]{6,}(?:/\d+)?(?![A-Za-z0-9])|(?<![A-Za-z0-9])v?\d{8}v\d{2}(?![A-Za-z0-9])"
    bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, ids, " "), r"[_\-.]+", " "), rf"[{SPACE}]+", " "))
    return F.when(F.regexp_count(bare, F.lit("[A-Za-zÄÖÜäöü]")) < 3, "").otherwise(F.rtrim(F.substring(bare, 1, C.TITLE_MAX)))


def front_matter(raw: Column) -> Column:
    """struct(text, title, tags) of a Markdown file; text begins with the title as a heading."""
    block = F.regexp_extract(raw, rf"(?s)^---[ \t]*\n(.*?)(?<=\n)---[ \t]*(?:\n|$)", 1)
    has = raw.rlike(r"(?s)^---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|$)")
    body = F.regexp_replace(raw, r"(?s)^---[ \t]*\n(?:.*?(?<=\n))?---[ \t]*(?:\n|$)", "")
    value = lambda key: strip(F.regexp_extract(block, rf"(?im)^[ \t]*{key}[ \t]*:[ \t]*(.*)$", 1))
    bare = lambda x: F.regexp_replace(x, """^["']+|["']+$""", "")
    title = F.when(has, bare(value("title"))).otherwise("")
    listed = F.regexp_replace(value("tags"), r"^\[(.*)\]$", "$1")
    parts = F.filter(F.transform(F.split(listed, ","), strip), lambda t: t != "")
    found = F.when(has, F.transform(parts, lambda t: F.lower(bare(t)))).otherwise(F.array().cast("array<string>"))
    text = F.when(has, body).otherwise(raw)
    return F.struct(F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n"), text)).otherwise(text).alias("text"), title.alias("title"), found.alias("tags"))


def is_contents_junk(text: Column) -> Column:
    """More than 30 dots and little besides dots, digits and white space."""
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return (dots > 30) & (F.length(F.regexp_replace(text, rf"[.\p{{Nd}}{SPACE}]", "")) < 40)


def normalised(vec: Column) -> Column:
    """A vector of length 1, in double; a zero vector stays."""
    wide = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
