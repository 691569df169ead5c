"""Spans of regular expressions with DataFrame functions only: where each match begins and ends, in code points.

The start of match i is the length of the pieces and matches before it, so no user function is needed. Patterns must not
match the empty string. Patterns here repeat possessively where nothing can be given back, so that Java neither
recurses nor goes back over very long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span as (start, rank of its kind, end, kind, match): sorts by start, then by kind.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


#: Matches that are added one by one to an array.
TOGETHER = 256


def no_spans() -> Column:
    return F.array().cast(SPAN)


def found(text: Column, pattern: str, kind: str, rank: int, only_if: Column | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """All leftmost non-overlapping matches. only_if: a cheap condition without which there is none; keep: of a match,
    whether it counts. Adding to an array copies it, so matches are added in groups and the groups joined: a text with very many costs
    little more for each of them than one with few."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"))

    def add(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("match"))
        longer = F.concat(acc["spans"], F.array(one))
        return F.struct(end.alias("at"), (longer if keep is None else F.when(keep(x["m"]), longer).otherwise(acc["spans"])).alias("spans"))

    def in_groups(all_of):
        def add_group(acc, i):
            start = F.struct(acc["at"].alias("at"), no_spans().alias("spans"))
            made = F.aggregate(F.slice(all_of, i * TOGETHER + 1, F.lit(TOGETHER)), start, add)
            return F.element_at(F.transform(F.array(made), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["groups"], F.array(x["spans"])).alias("groups"))), 1)

        groups = F.sequence(F.lit(0), F.floor(F.size(all_of) / TOGETHER).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("groups"))
        return F.flatten(F.aggregate(groups, start, add_group, lambda acc: acc["groups"]))

    # bound once: inside the folds it would be made again for each group
    out = F.element_at(F.transform(F.array(both), in_groups), 1)
    has = F.size(matches) > 0 if only_if is None else only_if
    return F.when(has, out).otherwise(no_spans())


BLOCK = 4096


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that stretches of it are found without a walk from its start."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def stretch(blocks: Column, start: Column, n: Column) -> Column:
    """n code points, at most BLOCK, from start (0-based) on."""
    first = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, first), F.lit("")), F.coalesce(F.get(blocks, first + 1), F.lit("")))
    return F.substring(two, start - first * BLOCK + 1, n)


def merged(*spans: Column) -> Column:
    return F.array_sort(reduce(F.concat, spans))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def cut_out(text: Column, spans: Column, replacement) -> Column:
    """text with replacement(span) in place of each span; a span that begins inside one before it is part of that one."""

    def add(acc, s):
        clear = s["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(clear, F.concat(acc["out"], before, replacement(s))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
