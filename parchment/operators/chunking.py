"""Documents into chunks: a fold over the cleaned lines of each document, inside the row, so nothing is shuffled."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from parchment import config as C
from parchment.functions import text as T


NUMBERED, MARKED, LOWER = T.in_python(T.NUMBERED_HEADING), T.in_python(T.MARKED_HEADING), re.compile("[a-zäöü]")
SIZED = T.in_python(r"(?s)^(\p{Nd}+(?:\.\p{Nd}+){0,3})[" + T.SPACE + r"]+([A-ZÄÖÜ].{2,80})$")


def _kind(x: str) -> tuple[str, str, str]:
    """A line's kind (page, head, line), what the chunk starts with and what its heading is."""
    if x == C.PAGE_BREAK:
        return "page", x, ""
    if x[:1].isdecimal():
        m = NUMBERED.match(x)
        if m and LOWER.search(m[2]):
            return "head", x, f"{m[1]} {m[2]}".strip()
    elif x[:1] == "#":
        m = MARKED.match(x)
        if m:
            return "head", m[2].strip(), m[2].strip()
    return "line", x, ""


def _fold(kinds, target: int, hard: int, least: int, shown) -> list[str]:
    """Texts of the chunks of lines with their kinds; shown(heading) stands before each. A heading or page break ends a chunk; so
    does a line that would pass `hard`, and a sentence's end beyond `target`. Single lines are never cut."""
    out: list[str] = []
    cur, head, size = "", "", 0

    def flush():
        body = cur.strip()
        if len(body) >= least:
            out.append(shown(head) + body)

    for kind, line, own in kinds:
        n = len(line)
        if kind == "page":
            flush()
            cur, head, size = "", "", 0
        elif kind == "head":
            flush()
            cur, head, size = line, own, n
        else:
            if size + n > hard:
                flush()
                cur, size = "", 0
            cur = f"{cur} {line}" if cur else line
            size += n + 1
            if size >= target and line[-1:] in (".", ";", ":"):
                flush()
                cur, size = "", 0
    flush()
    return out


def _titled(prefix: str | None):
    """What stands before a chunk: the prefix and its heading."""

    def shown(head: str) -> str:
        parts = " > ".join(p for p in (prefix, head) if p)
        return f"{parts}: " if parts else ""

    return shown


def pack(lines: Column, target: int = C.CHUNK_TARGET, hard: int = C.CHUNK_HARD, least: int = C.CHUNK_MIN, prefix: Column | None = None) -> Column:
    """Texts of the chunks of an array of lines."""

    @F.pandas_udf("array<string>")
    def packed(lines: pd.Series, prefix: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _fold(map(_kind, x), target, hard, least, _titled(p)) for x, p in zip(lines, prefix)])

    return packed(lines, F.lit("") if prefix is None else prefix)


def _exploded(rows: DataFrame, pieces) -> DataFrame:
    """The columns of rows but text and prefix, with ord and text of each of pieces(text, prefix). One scan of a Python string for
    each step, where folds of expressions copy what they have at each line."""
    kept = [c for c in rows.columns if c not in ("text", "prefix")]
    schema = StructType([rows.schema[c] for c in kept]).add("ord", IntegerType()).add("text", StringType())

    def run(batches):
        for batch in batches:
            at, ords, out = [], [], []
            prefixes = batch.column("prefix").to_pylist() if "prefix" in batch.schema.names else [""] * len(batch)
            for i, (text, prefix) in enumerate(zip(batch.column("text").to_pylist(), prefixes)):
                own = pieces(text, prefix) if text is not None else ()
                at.extend([i] * len(own))
                ords.extend(range(len(own)))
                out.extend(own)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), pa.array(ords, pa.int32()), pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seeds_col: str | None = None, titles: bool = False) -> DataFrame:
    """(doc_id, source, ord, text, tags) for every chunk. titles: put the source's readable title before each chunk."""
    own = [docs[id_col].alias("doc_id"), docs[source_col].alias("source"), *([docs[seeds_col].alias("seeds")] if seeds_col else [])]
    prefix = [T.title_of(docs[source_col]).alias("prefix")] if titles else []
    rows = docs.select(*own, F.coalesce(docs[text_col], F.lit("")).alias("text"), *prefix)
    packed = _exploded(rows, lambda text, prefix: _fold(map(_kind, T.lines_of(text)), C.CHUNK_TARGET, C.CHUNK_HARD, C.CHUNK_MIN, _titled(prefix)))
    return packed.select("doc_id", "source", "ord", "text", T.tags(F.col("text"), F.col("seeds") if seeds_col else None).alias("tags"))


def flat_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 350, overlap: int = 80, least: int = 20) -> DataFrame:
    """(doc_id, ord, text): windows of fixed size over the text with white space folded."""
    step = max(1, size - overlap)

    def cut(text: str, _) -> list[str]:
        t = " ".join(T.joined(text).split())
        if not t:
            return []
        last = max(0, -((size - len(t)) // step))
        return [x for i in range(last + 1) if len(x := t[i * step : i * step + size].strip()) >= least]

    return _exploded(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), cut)


def sized_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target: int = 1100, hard: int = 1600, least: int = 40) -> DataFrame:
    """(doc_id, ord, text): larger chunks that end at numbered headings only, each with "[source | heading] " before it."""

    def kind(x: str):
        m = SIZED.match(x) if x[:1].isdecimal() else None
        return ("head", x, f"{m[1]} {m[2]}") if m else ("line", x, "")

    def cut(text: str, source: str) -> list[str]:
        lines = [x for line in T.joined(text).split("\n") if (x := line.strip()) and not T.is_plain_furniture(x)]
        return _fold(map(kind, lines), target, hard, least, lambda head: f"[{source} | {head}] " if head else f"[{source}] ")

    return _exploded(docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.coalesce(docs[source_col], F.lit("")).alias("prefix")), cut)


def screened(chunk_rows: DataFrame) -> DataFrame:
    """(source, n, bad, ratio, alpha_avg, density_avg, doc_bad): how much of each source looks broken."""
    alpha, density, broken = T.garbage_metrics(F.col("text"))
    rows = chunk_rows.select("source", alpha.alias("alpha"), density.alias("density"), broken.alias("broken"))
    bad = T.is_garbage(F.col("alpha"), F.col("density"), F.col("broken")).cast("long")
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"), F.avg("alpha").alias("alpha_avg"), F.avg("density").alias("density_avg"))
    ratio = F.col("bad") / F.col("n")
    return out.select("source", "n", "bad", ratio.alias("ratio"), "alpha_avg", "density_avg", (ratio > C.GARBAGE_DOC_MAX).alias("doc_bad"))


def reject_garbage(chunk_rows: DataFrame) -> DataFrame:
    """Chunks without the broken ones, and without sources that are broken as a whole."""
    ok = chunk_rows.join(screened(chunk_rows).where("not doc_bad").select("source"), "source", "left_semi")
    return ok.where(~T.is_garbage(*T.garbage_metrics(F.col("text"))))
