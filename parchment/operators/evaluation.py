"""Retrieval evaluation: how much of a model answer the found chunks hold, by question, sheet and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment import config as C
from parchment.functions import text as T


def coverage(questions: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, coverage, hit, first_rank, terms) for (qid, answer), found (qid, rank from 1, text) and the index's (term, idf).

    A term counts where a found text contains it, with its idf (6 where it isn't in the index, 8 at most, 1 for 0).
    """
    gold = questions.select("qid", F.explode_outer(T.gold_terms(F.col("answer"))).alias("term"))
    idf = F.least(F.coalesce("idf", F.lit(C.UNKNOWN_IDF)), F.lit(C.MAX_IDF))
    weighted = gold.join(terms.select("term", "idf"), "term", "left").select("qid", "term", F.when(idf == 0, 1.0).otherwise(idf).alias("w"))
    low = found.select("qid", "rank", F.lower("text").alias("low"))
    ranks = weighted.where("term is not null").join(low, "qid").where(F.contains("low", "term")).groupBy("qid", "term").agg(F.min("rank").alias("at"))
    rows = weighted.join(ranks, ["qid", "term"], "left").groupBy("qid").agg(
        F.sum(F.when(F.col("at").isNotNull(), F.col("w")).otherwise(0.0)).alias("got"),
        F.sum(F.when(F.col("term").isNotNull(), F.col("w")).otherwise(0.0)).alias("total"),
        F.coalesce(F.min("at"), F.lit(0)).cast("long").alias("first_rank"),
        F.count("term").alias("terms"),
    )
    share = F.when(F.col("total") > 0, F.col("got") / F.col("total")).otherwise(0.0)
    return rows.select("qid", F.round(share, 4).alias("coverage"), (share >= C.HIT_COVERAGE).alias("hit"), "first_rank", "terms")


def by_sheet(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(sheet, n, hits, recall, coverage, mrr), rates rounded to 4 places."""
    reciprocal = F.when(F.col("first_rank") > 0, 1.0 / F.col("first_rank")).otherwise(0.0)
    out = results.join(questions.select("qid", "sheet"), "qid").groupBy("sheet").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"), F.avg("coverage").alias("coverage"), F.avg(reciprocal).alias("mrr"))
    return out.select("sheet", "n", "hits", F.round(F.col("hits") / F.col("n"), 4).alias("recall"), F.round("coverage", 4).alias("coverage"), F.round("mrr", 4).alias("mrr"))


def overall(sheets: DataFrame) -> DataFrame:
    """One row over the sheets: means of their rounded rates, weighted by their number of questions."""
    n = F.sum("n")
    mean = lambda c: F.round(F.coalesce(F.sum(F.col(c) * F.col("n")) / n, F.lit(0.0)), 4)
    return sheets.agg(F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.round(F.coalesce(F.sum("hits") / n, F.lit(0.0)), 4).alias("recall"), mean("coverage").alias("coverage"), mean("mrr").alias("mrr"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sheets that both runs have, with recall and MRR of each and the change in recall."""
    a, b = before.alias("a"), after.alias("b")
    return a.join(b, F.col("a.sheet") == F.col("b.sheet")).select(
        F.col("b.sheet").alias("sheet"), F.col("b.n").alias("n"), F.col("a.recall").alias("recall_before"), F.col("b.recall").alias("recall_after"),
        F.round(F.col("b.recall") - F.col("a.recall"), 4).alias("delta"), F.col("a.mrr").alias("mrr_before"), F.col("b.mrr").alias("mrr_after"),
    )


# The golden set, questions with what an answer has to hold.
GOLDEN = [
    ("Wie oft fuehrt die MAA eine Betriebspruefung durch?", "24 Monate"),
    ("Welches KESO-Produkt hat Patentschutz bis 2044?", "8000-Omega-3"),
    ("Was kostet ein ZUKO XXI Zutrittspunkt?", "20'000"),
    ("Welche Risikostufe gilt fuer Risikoindex 9 bis 14?", "Low"),
    ("Innerhalb welcher Frist sind Maengel der MAA zu melden?", "72 Stunden"),
    ("Welche ISO-Norm legitimiert das Ideenmanagement?", "9001"),
    ("Welche Widerstandsklasse muss ein Schluesselrohr mindestens haben?", "RC 3"),
    ("Was bedeutet die Abkuerzung VS?", "Verantwortliche Stelle"),
]
# End of fixed values.


def golden_set(spark: SparkSession) -> DataFrame:
    """(qid, question, expected) of the golden set; qid counts from 0."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(GOLDEN)], "qid long, question string, expected string")


def golden(questions: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """One row: questions (qid, expected) whose expected text is in one of the first k found, and their share."""
    low = found.where(F.col("rank") <= k).select("qid", F.lower("text").alias("low"))
    hit = questions.join(low, "qid", "left").groupBy("qid").agg(F.max(F.coalesce(F.contains("low", F.lower("expected")), F.lit(False)).cast("long")).alias("hit"))
    return hit.agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.sum("hit") / F.count("*"), 4).alias("recall"))


def pick(questions: DataFrame, sheet: str | None = None, limit: int = 0) -> DataFrame:
    """The questions of a sheet (of all without one), and of these the first `limit` by qid if it is more than 0."""
    rows = questions.where(F.col("sheet") == sheet) if sheet else questions
    return rows.orderBy("qid").limit(limit) if limit > 0 else rows


def top_sources(found: DataFrame, most: int = 3) -> DataFrame:
    """(qid, top_source, sources): the sources of the first `most` of found (qid, rank from 1, source), in their order."""
    first = found.where(F.col("rank") <= most).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "source"))).alias("s"))
    return first.select("qid", F.get("s", F.lit(0))["source"].alias("top_source"), F.transform("s", lambda x: x["source"]).alias("sources"))


def export(results: DataFrame, questions: DataFrame, path: str, label: str, at: str, chunks: int = 0) -> str:
    """Writes a run below path as JSON lines, in a folder eval_<at>_<label> with parts overall, sheets and details; returns it.
    at: the time as text that sorts, such as 20250131_120000."""
    import re

    safe = re.sub(r"[^\w.-]", "_", label or "run")[:60]
    folder = f"{path.rstrip('/')}/eval_{at}_{safe}"
    sheets = by_sheet(results, questions)
    sheets.write.json(f"{folder}/sheets")
    overall(sheets).select("*", F.lit(safe).alias("label"), F.lit(chunks).alias("indexed_chunks"), F.lit(C.HIT_COVERAGE).alias("hit_coverage")).write.json(f"{folder}/overall")
    results.join(questions.select("qid", "sheet", "question"), "qid").write.json(f"{folder}/details")
    return folder


SHEET = "sheet string, n long, hits long, recall double, coverage double, mrr double"


def compare_last(spark: SparkSession, path: str) -> DataFrame:
    """difference() of the last two exports below path by name, the largest loss first."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/eval_*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    names = sorted(x.getPath().toString() for x in found)[-2:]  # a name for each export
    if len(names) < 2:
        raise ValueError(f"{path} has fewer than two exports")
    before, after = (spark.read.schema(SHEET).json(f"{name}/sheets") for name in names)
    return difference(before, after).orderBy("delta", "sheet")
