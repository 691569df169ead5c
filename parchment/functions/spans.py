"""Where a pattern matches, in code points: the start of a match is the length of the pieces and matches before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that are set aside for a program's own use and stand for no character.
BEFORE, AFTER = "\ufdd0", "\ufdd1"
SPANS = "array<struct<start:int,end:int,rank:int,text:string>>"


def pattern_spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """All leftmost non-overlapping matches that keep(match) allows. The pattern must not match the empty string."""
    twice = _placed(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rank, keep)

    def cut(parts):
        rest = F.slice(parts, 2, F.size(parts))
        pieces = F.concat(F.slice(parts, 1, 1), F.transform(rest, lambda x: F.substring_index(x, AFTER, -1)))
        return _placed(pieces, F.transform(rest, lambda x: F.substring_index(x, AFTER, 1)), rank, keep)

    # one search: matches are put between two marks that no text should hold, then cut out; texts that do hold one are searched twice
    once = F.element_at(F.transform(F.array(F.split(F.regexp_replace(text, pattern, f"{BEFORE}$0{AFTER}"), BEFORE, -1)), cut), 1)
    return F.when(F.contains(text, F.lit(BEFORE)) | F.contains(text, F.lit(AFTER)), twice).otherwise(once)


def literal_spans(text: Column, term: Column, rank: int = 0) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, quoted, -1)
    return _placed(pieces, F.array_repeat(term, F.size(pieces) - 1), rank, None)


def _placed(pieces: Column, found: Column, rank: int, keep) -> Column:
    both = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        longer = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), x["m"].alias("text"))))
        return F.struct(end.alias("at"), (longer if keep is None else F.when(keep(x["m"]), longer).otherwise(acc["out"])).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])


def sweep(spans: Column) -> Column:
    """From spans in order of start, length (longer first) and rank: each that begins at or after the end of the last one kept."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"], (s["start"] - s["end"]).alias("neg"), s["rank"], s["end"], s["text"]))

    def step(acc, s):
        one = F.array(F.struct(s["start"], s["end"], s["rank"], s["text"]))
        take = s["start"] >= acc["last"]
        return F.struct(F.when(take, s["end"]).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(keyed), F.struct(F.lit(-1).alias("last"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])


def replaced(text: Column, spans: Column, replacement) -> Column:
    """text with replacement(span) for each span; spans in order, those inside an earlier one are left out."""

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        clear = s["start"] >= acc["at"]
        return F.struct(F.when(clear, s["end"]).otherwise(acc["at"]).alias("at"), F.when(clear, F.concat(acc["out"], before, replacement(s))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
