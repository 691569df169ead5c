"""Files of a folder, or given bytes, as rows of text.

Reading is Spark's binaryFile source, so files are split over tasks and names can be filtered before any content is read.
Formats that need a parser run in one Arrow pass; register() adds others or replaces one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.config import PAGE_BREAK
from parchment.functions import text as T
from parchment.operators import chunking, store

from . import office, outlook, pdf, plain

#: Readers by suffix, from bytes to text.
READERS: dict[str, Callable[[bytes], str]] = {
    ".docx": office.docx, ".xlsx": office.xlsx, ".xlsm": office.xlsx, ".pptx": office.pptx, ".csv": plain.delimited, ".txt": plain.decoded,
    ".md": plain.decoded, ".markdown": plain.decoded, ".eml": plain.mail, ".msg": outlook.message, ".pdf": pdf.pdf,
}
#: Suffixes that a folder scan reads.
KNOWN = set(READERS)
#: The tag of every chunk of a glossary.
GLOSSARY_TAG = "glossar"


def register(suffix: str, reader: Callable[[bytes], str]) -> None:
    READERS[suffix.lower()] = reader
    KNOWN.add(suffix.lower())


def read_folder(spark: SparkSession, path: str, skip: DataFrame | None = None) -> DataFrame:
    """(path, name, content) of all files below path with a known suffix, without temporary and hidden ones. skip: names
    (source) that are known already, left out before their content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    files = files.select("path", name.alias("name"), "content")
    files = files.where(~F.col("name").rlike(r"^(~\$|\.)") & F.regexp_extract(F.lower("name"), r"(\.[^.]*)$", 1).isin(*sorted(KNOWN)))
    return files if skip is None else files.join(F.broadcast(skip.select(F.col("source").alias("name")).distinct()), "name", "left_anti")


def _plain_path(path: str) -> str:
    """A path without file scheme, doubled slashes and steps up, so that what lies below a folder begins with its path."""
    import posixpath
    import re

    scheme, place = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    bare = posixpath.normpath("/" + place.lstrip("/")) if scheme in (None, "file") else f"{scheme}:{posixpath.normpath(place)}"
    return bare.rstrip("/")


def extract(files: DataFrame, glossary_below: str | None = None) -> DataFrame:
    """(path, name, text, seed_tags, error) of (path, name, content). Workbooks below glossary_below are read as glossaries.
    A file that can't be read has an error and no text."""
    import pandas as pd

    readers, known = dict(READERS), set(KNOWN)
    glossary = None if glossary_below is None else _plain_path(glossary_below) + "/"

    def run(batches):
        for batch in batches:
            texts, errors, tags = [], [], []
            for path, name, content in zip(batch["path"], batch["name"], batch["content"]):
                suffix = "." + name.rpartition(".")[2].lower()
                reader = readers.get(suffix)
                is_glossary = glossary is not None and suffix in (".xlsx", ".xlsm") and _plain_path(path).startswith(glossary)
                try:
                    if reader is None:
                        raise ValueError(f"no reader for {suffix}" if suffix in known else f"unknown format {suffix}")
                    texts.append(glossary_text(content) if is_glossary else reader(content))
                    errors.append(None)
                except Exception as e:  # one broken file must not end the scan; what is wrong is in its row
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                tags.append([GLOSSARY_TAG] if is_glossary else [])
            yield pd.DataFrame({"path": batch["path"], "name": batch["name"], "text": texts, "seed_tags": tags, "error": errors})

    read = files.select("path", "name", "content").mapInPandas(run, "path string, name string, text string, seed_tags array<string>, error string")
    is_markdown = F.lower("name").rlike(r"\.(md|markdown)$") & F.col("text").isNotNull()
    front = T.front_matter(F.col("text"))
    return read.select("path", "name", F.when(is_markdown, front["text"]).otherwise(F.col("text")).alias("text"), F.when(is_markdown, front["tags"]).otherwise(F.col("seed_tags")).alias("seed_tags"), "error")


def _is_header(first: str, words: tuple[str, ...]) -> bool:
    return first.lower().startswith(words)


def glossary_text(content: bytes) -> str:
    """Entries of question, answer, topic and source as headings and text, with page breaks between; sheets that begin with _ are left out."""
    entries = []
    for sheet, n, values in office.xlsx_rows(content):
        question, answer, topic, source = [*values, "", "", "", ""][:4]
        if sheet.startswith("_") or n == 0 and _is_header(question, ("frage", "begriff", "term")) or not question or not answer:
            continue
        note = f" (Quelle: {source}; Blatt: {sheet})" if source else ""
        entries.append(f"## {term_of(question, topic)}\n{question.rstrip('?')}? {answer}{note}")
    return f"\n{PAGE_BREAK}\n".join(entries)


def term_of(question: str, topic: str) -> str:
    """functions.text.term_of for one entry, where a workbook is read."""
    import re

    asked = re.match(r"\s*(?:Was\s+(?:ist|bedeutet|sind)|Wof(?:ue|ü)r\s+steht)\s+(.+?)\s*\??$", question, re.I | re.S)
    return topic or (asked[1] if asked else question).strip(" ?")[:80]


def workbook_rows(files: DataFrame) -> DataFrame:
    """(name, sheet_no, sheet, row_no, vals) of every row of every workbook of (name, content)."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"]):
                numbers: dict[str, int] = {}
                for sheet, n, values in office.xlsx_rows(content):
                    out.append((name, numbers.setdefault(sheet, len(numbers)), sheet, n, values))
            yield pd.DataFrame(out, columns=["name", "sheet_no", "sheet", "row_no", "vals"])

    return files.select("name", "content").mapInPandas(run, "name string, sheet_no int, sheet string, row_no int, vals array<string>")


def questions(files: DataFrame) -> DataFrame:
    """(name, qid, question, answer, topic, origin, sheet) of question workbooks: a header row that begins with "frage" is left
    out, as are rows without question or answer. qid counts through a workbook from 0."""
    value = lambda i: F.coalesce(F.get("vals", F.lit(i)), F.lit(""))
    rows = workbook_rows(files).select("name", "sheet_no", "sheet", "row_no", value(0).alias("question"), value(1).alias("answer"), value(2).alias("topic"), value(3).alias("origin"))
    rows = rows.where(~((F.col("row_no") == 0) & F.lower("question").startswith("frage")) & (F.col("question") != "") & (F.col("answer") != ""))
    qid = F.row_number().over(Window.partitionBy("name").orderBy("sheet_no", "row_no")) - 1
    return rows.select("name", qid.alias("qid"), "question", "answer", "topic", "origin", "sheet")


def term_rules(files: DataFrame) -> list[tuple[str, str, str]]:
    """(term, type, replacement) of the sheets that begin with _anon, for anonymise.rules_of_terms; a hand-kept list, so small."""
    value = lambda i: F.coalesce(F.get("vals", F.lit(i)), F.lit(""))
    rows = workbook_rows(files).where(F.col("sheet").startswith("_anon")).orderBy("name", "sheet_no", "row_no")
    found, seen = [], set()
    for r in rows.select("name", value(0).alias("term"), value(1).alias("kind"), value(2).alias("replacement")).toLocalIterator():
        first = r["name"] not in seen
        seen.add(r["name"])
        if r["term"] and not (first and _is_header(r["term"], ("begriff", "term"))):
            found.append((r["term"], r["kind"] or "wort", r["replacement"] or "[BEGRIFF]"))
    return found


def new_chunks(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(source, ord, text, tags, doc_hash) of extracted texts whose content is in no known chunk; of equal contents the
    first by name stays, of equal names the last by path."""
    rows = texts.where(F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("doc_hash", store.content_hash(F.col("text")))
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("path")))
    rows = rows.withColumn("__r", last).where("__r = 1").drop("__r")
    firsts = rows.groupBy("doc_hash").agg(F.min(F.struct(F.lower("name").alias("low"), F.col("name").alias("name")))["name"].alias("name"))
    rows = store.unseen(rows.join(firsts, ["doc_hash", "name"], "left_semi"), known)
    packed = chunking.chunks(rows, "doc_hash", "text", "name", "seed_tags")
    return packed.select("source", "ord", "text", "tags", F.col("doc_id").alias("doc_hash"))
