"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with at most k = floor(m * budget) edits. Cut into k + 1 pieces, at least one piece of
every such occurrence is untouched, so the exact hits of all pieces (one Aho-Corasick pass over a text) are the only
places to look at, and Myers' bit-parallel distance decides them. Pieces are the leaves of a tree of halves: of a part with k
edits, one half has at most its own share of k - 1. So a hit is first held against the two pieces above it, then four and so
on, and only hits that every part up to the whole allows are compared as a whole: chance hits end after a few characters. Texts and items are compared in lower case with white
space as one space. Items are read in blocks of bounded size, each an automaton of its own; blocks are broadcast.

Defined results: null texts and items count as empty and match nothing; items shorter than `least` characters match
exactly, between word boundaries; items without an id have no rows but count for the filter; repeated rows are searched each; equal items match each under its own id; the best occurrence of an item in a
document is the one of least distance, then the earliest end; other columns are left out; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, by_rows, id_and_text, worker_takes

#: Characters of items in a block; a worker holds one automaton of these at a time.
BLOCK_CHARS = 4_000_000
_loaded: dict = {}


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(begin: int, end: int, k: int, above: tuple = ()) -> Iterator[tuple[int, int, tuple]]:
    """(begin, end, parts above it from the smallest, each as (begin, end, edits)) of the k + 1 pieces of a part with k edits. The whole is left out."""
    if not k:
        yield begin, end, above[:-1]
        return
    first = (k - 1) // 2  # the halves' edits add up to k - 1
    middle = begin + (end - begin) * (first + 1) // (k + 1)
    yield from pieces(begin, middle, first, ((begin, end, k), *above))
    yield from pieces(middle, end, k - 1 - first, ((begin, end, k), *above))


@lru_cache(65_536)
def _places(pattern: str) -> dict[str, int]:
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    return eq


def myers(pattern: str, text: str, enough: int = -1) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of text, end of the first such substring); one integer step a
    character. Stops at the first distance of at most `enough`."""
    m, eq = len(pattern), _places(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        x = eq.get(c, 0)
        d0 = ((((x & pv) + pv) ^ pv) | x | mv) & full
        hp, hn = mv | (full & ~(d0 | pv)), pv & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full  # a match may begin anywhere, so no carry enters
        hn = hn << 1 & full
        pv, mv = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, at = score, j + 1
            if best <= enough:
                break
    return best, at


def _in_word(text: str, at: int) -> bool:
    """Whether a word goes on from the character before this place to the one at it; scripts without spaces have none."""
    return 0 < at < len(text) and all((c.isalnum() or c == "_") and not "\u2e80" <= c < "\uac00" for c in text[at - 1 : at + 1])


class Matcher:
    """Finds the items of one block. items: (id, text)."""

    def __init__(self, items: list[tuple[int, str]], budget: float, least: int):
        import ahocorasick

        self.items, self.short, self.automaton = [], set(), ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int, tuple]]] = {}
        for i, text in items:
            if text := normal(text):
                k = int(len(text) * budget) if len(text) >= least else 0
                if len(text) < least:
                    self.short.add(len(self.items))
                for a, b, above in pieces(0, len(text), k):
                    where.setdefault(text[a:b], []).append((len(self.items), a, above))
                self.items.append((i, text, k))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, least distance, its end in the normal form, item's budget) of each item that occurs."""
        if not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for item, offset, above in places:
                start = end + 1 - n - offset
                if item in self.short and (_in_word(text, start) or _in_word(text, end + 1)):
                    continue
                if start not in starts.get(item, ()) and self.allowed(self.items[item][1], text, start, above):
                    starts.setdefault(item, set()).add(start)
        found = []
        for item, at in starts.items():
            i, pattern, k = self.items[item]
            best = (k + 1, 0)
            for low, high in self.windows(at, len(pattern), k, len(text)):
                distance, end = myers(pattern, text[low:high])
                best = min(best, (distance, low + end))
            if best[0] <= k:
                found.append((i, best[0], best[1], k))
        return found

    @staticmethod
    def allowed(pattern: str, text: str, start: int, above: tuple) -> bool:
        """Whether each part above a hit occurs where the hit puts it, with its share of edits."""
        return all(myers(pattern[a:b], text[max(0, start + a - k) : max(0, start + b + k)], k)[0] <= k for a, b, k in above)

    @staticmethod
    def windows(starts: set[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
        """The stretches that occurrences near these starts lie in, joined where they overlap, so that each character is looked at once."""
        low = high = None
        for s in sorted(starts):
            a, b = max(0, s - k), min(n, s + m + k)
            if low is None or a > high:
                if low is not None:
                    yield low, high
                low, high = a, b
            else:
                high = max(high, b)
        if low is not None:
            yield low, high


def _matcher(key: str, items, budget: float, least: int) -> Matcher:
    if _loaded.get("key") != key:
        _loaded["key"], _loaded["matcher"] = key, Matcher(items, budget, least)
    return _loaded["matcher"]


def _forget() -> None:
    _loaded.clear()
    _places.cache_clear()


def item_blocks(items: DataFrame, id_col: str, text_col: str, without_id: bool = False) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_CHARS, read one after another, never all at once."""
    block, size = [], 0
    rows = id_and_text(items, id_col, text_col)
    for row in (rows if without_id else rows.where("__id is not null")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = 0.1, least: int = 20) -> DataFrame:
    """(id, item_id, distance, end, budget): a row for each document and item that occurs in it; a pass over the documents for each block of items."""
    import uuid

    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("distance", pa.int64()), ("end", pa.int64()), ("budget", pa.int64())])
    fields = "id long, item long, distance long, end long, budget long"
    spark, rows, out = docs.sparkSession, id_and_text(docs, id_col, text_col), None
    for block in item_blocks(items, item_id, item_text):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            worker_takes("decontam", _forget)
            matcher = _matcher(key, shared.value, budget, least)

            def of_rows(columns):
                hits = [(i, *hit) for i, t in zip(*columns) for hit in matcher.find(t)]
                return list(zip(*hits)) if hits else [[]] * 5

            return by_rows(batches, of_rows, schema)

        found = rows.mapInArrow(run, fields)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], fields)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "distance", "end", "budget")


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = 0.1, least: int = 20) -> DataFrame:
    """The rows of docs, with all columns, in whose text no item occurs. Rows pass a filter for each block of items: no shuffle, and ids need not be unique."""
    import uuid

    out, place = docs, docs.columns.index(text_col)
    for block in item_blocks(items, item_id, item_text, without_id=True):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            worker_takes("decontam", _forget)
            matcher = _matcher(key, shared.value, budget, least)
            for batch in batches:
                clean = [not t or not matcher.find(t) for at in range(0, batch.num_rows, ROWS_AT_ONCE) for t in batch.column(place).slice(at, ROWS_AT_ONCE).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
