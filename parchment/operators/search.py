"""Hybrid search: query language, hard filters, cosine and BM25 ranks, reciprocal rank fusion.

Chunks are (id, source, text, vec, tags); those without a vector, or with one of another size than the first's, are
invisible to both rankings. Ranks of the cosine are global and taken before the filter, those of BM25 are taken among the
chunks that pass it, and statistics are those of all chunks. Where the vectors are a table of their own, chunks have its key
instead (vec_id in place of vec) and meet it only after their texts are counted, so no text is shuffled.

No ranking is ever sorted as a whole: with k results, only chunks among the first 60 + 2(k - 1) + 1 of either ranking can
be in the result (BM25 alone gives the k-th a score of 1 / (60 + k - 1)). These candidates, a number that depends on k
alone, get their exact ranks by a counting pass: cosines and BM25 scores of an Arrow batch are compared with the candidates'
in numpy and only counts leave the task. A chunk without any term of the question ranks after those that have one, by id, which is
counted too. So no row for each question and chunk is made. Search and hybrid run when called, as they bring the candidates of a
block of questions to the driver between the passes.
"""

from __future__ import annotations

import fnmatch
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment import config as C
from parchment.functions import text as T

from . import index as ix

# The operators of the query language, in the order in which they are taken out.
REGEX = re.compile(r"/((?:[^/\\]|\\.)+)/")
FIELD = re.compile(r'(\w+):("(?:[^"]*)"|\S+)')
EXCLUDE = re.compile(r'(?:^|\s)(?:NOT\s+|-)([^\s"]+)')
PHRASE = re.compile(r'"([^"]+)"')
FIELDS = {"tag": "tags", "tags": "tags", "source": "sources", "src": "sources", "dok": "sources", "doc": "sources", "filename": "filenames", "file": "filenames", "datei": "filenames"}
# End of fixed values.


@dataclass
class Query:
    tags: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    filenames: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    free: str = ""

    @property
    def constrained(self) -> bool:
        return any((self.tags, self.sources, self.filenames, self.phrases, self.regexes, self.excludes))


def parse(text: str | None) -> Query:
    q, rest = Query(), text or ""

    def take(pattern, use):
        nonlocal rest
        rest = pattern.sub(lambda m: " " if use(m) is not False else m[0], rest)

    def field_of(m):
        name, value = FIELDS.get(m[1].lower()), m[2]
        if name is None:
            return False
        getattr(q, name).append((value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value).lower())

    take(REGEX, lambda m: q.regexes.append(m[1]))
    take(FIELD, field_of)
    take(EXCLUDE, lambda m: q.excludes.append(m[1].lower()))
    take(PHRASE, lambda m: q.phrases.append(m[1]))
    q.free = re.sub(r"\s+", " ", rest).strip()
    return q


def _java(regex: str) -> str | None:
    """The pattern for Spark, None where it isn't one. Shorthands count Unicode, as everywhere in the query language."""
    try:
        re.compile(regex)
    except re.error:
        return None
    return "(?iuU)" + regex


def _glob(pattern: str) -> str:
    return "(?s)^" + re.sub(r"\\[zZ]$", "", fnmatch.translate(pattern).removeprefix("(?s:")).removesuffix(")") + "$"


def passes(q: Query, source: Column, text: Column, tags: Column) -> Column:
    """The hard filter: all classes must hold; all tags, phrases and regexes, any source and file name, no exclusion."""
    low, src = F.lower(text), F.lower(F.coalesce(source, F.lit("")))
    every: list[Column] = [F.array_contains(tags, t) for t in q.tags]
    either = lambda tests: [reduce(lambda a, b: a | b, tests)] if tests else []
    every += either([src.contains(s) for s in q.sources])
    every += either([src.rlike(_glob(f)) for f in q.filenames])
    every += [low.contains(p.lower()) for p in q.phrases]
    every += [text.rlike(rx) for r in q.regexes if (rx := _java(r))]
    every += [~(F.array_contains(T.tokens(text), x) | src.contains(x)) for x in q.excludes]
    return reduce(lambda a, b: a & b, every, F.lit(True))


def visible(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector of the first chunk's size."""
    known = chunks.where(F.col("vec").isNotNull())
    size = known.agg(F.min_by(F.size("vec"), "id").alias("__dim"))
    return known.join(F.broadcast(size)).where(F.size("vec") == F.col("__dim")).drop("__dim")


def cosines(chunks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest (qid, id, cos) of each question (qid, vec), cos rounded to 6 places. The questions' vectors are
    broadcast, in blocks of bounded size; an Arrow batch of chunks is multiplied with all of a block at once."""
    out = []
    for block in _blocks(vectors):
        order = chunks.sparkSession.createDataFrame([*enumerate(block.ids)], "q int, qid long")
        near = _nearest(chunks, block, k).select("q", "id", (0.0 - F.col("key")).alias("cos"))
        out.append(near.join(F.broadcast(order), "q").select("qid", "id", "cos"))
    return reduce(DataFrame.unionByName, out) if out else chunks.sparkSession.createDataFrame([], "qid long, id long, cos double")


def _blocks(questions: DataFrame, numbers: int = 4_000_000):
    """Blocks of bounded size of the questions (qid, vec), with their terms where they have a text (question)."""
    texts = T.tokens(F.col("question")) if "question" in questions.columns else F.array().cast("array<string>")
    rows, size, terms = [], 0, 0
    for r in questions.select("qid", T.normalised(F.col("vec")), texts).orderBy("qid").toLocalIterator():
        rows.append((r[0], r[1], Counter(r[2] or ())))
        size, terms = size + len(r[1]), terms + len(rows[-1][2])
        if size >= numbers or terms >= ix.BROADCAST_TERMS:
            yield _Block(*map(list, zip(*rows)))
            rows, size, terms = [], 0, 0
    if rows:
        yield _Block(*map(list, zip(*rows)))


@dataclass
class _Block:
    """Some questions at once: ids, normalised vectors (None where a question has none), how often each asks its terms, and each
    one's filter and factor."""

    ids: list[int]
    vectors: list
    terms: list[Counter]
    tests: list[tuple[Column, Column]] | None = None  # None: every chunk passes, with factor 1

    def matrix(self):
        import numpy as np

        have = [i for i, v in enumerate(self.vectors) if v is not None]
        return have, np.array([self.vectors[i] for i in have], float) if have else None


def _nearest(seen: DataFrame, block: _Block, most: int) -> DataFrame:
    """(q, id, key): each question's `most` nearest chunks, key being the negative cosine. A task keeps so many of its own; the
    scores of a batch are made, looked at and dropped, so no row for each question and chunk is made."""
    import numpy as np
    import pyarrow as pa

    shared = seen.sparkSession.sparkContext.broadcast(block.matrix())

    def run(batches):
        have, m = shared.value
        near = [(np.empty(0), np.empty(0, np.int64)) for _ in have]
        for batch in batches:
            ids = _ids(batch)
            if m is not None and len(ids):
                scores = -np.round(_matrix_of(batch.column("vec"), m.shape[1]) @ m.T, 6)
                for j in range(len(have)):
                    keys, own = np.concatenate([near[j][0], scores[:, j]]), np.concatenate([near[j][1], ids])
                    at = ix.first(keys, own, most)
                    near[j] = keys[at], own[at]
        of = [have[j] for j in range(len(have)) for _ in near[j][1]]
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.concatenate([x for x, _ in near])), pa.array(np.concatenate([x for _, x in near]), pa.int64())], names=["q", "key", "id"])

    found = seen.select("id", "vec").mapInArrow(run, "q int, key double, id long")
    place = F.row_number().over(Window.partitionBy("q").orderBy("key", "id"))
    return found.withColumn("r", place).where(F.col("r") <= most).select("q", "id", "key")


def _ids(batch):
    return batch.column("id").to_numpy(zero_copy_only=False)


def _matrix_of(column, width: int):
    """A list column whose lists have this many values, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _before(keys, ids, of_keys, of_ids):
    """How many of (keys, ids) stand at each place among the sorted (of_keys, of_ids): before the first, ..., after the last.
    A row doesn't stand before itself."""
    import numpy as np

    place = np.searchsorted(of_keys, keys, "right")
    low = np.searchsorted(of_keys, keys, "left")
    tied = np.flatnonzero(low < place)
    for at in np.unique(low[tied]):
        own = tied[low[tied] == at]
        place[own] = at + np.searchsorted(of_ids[at : place[own[0]]], ids[own], "right")
    return np.bincount(place, minlength=len(of_keys) + 1)


def _counted(chunks: DataFrame, block: _Block, index: ix.Index | None, vectors: DataFrame | None = None):
    """(rows, scorer): the visible chunks with what they have of the block's terms and whether they pass its filters, stored once
    and without texts, and what scores them."""
    asked = ix.Asked.of([*zip(block.ids, block.terms)])
    known = chunks.where(F.col("vec" if vectors is None else "vec_id").isNotNull())
    keep = ["vec" if vectors is None else "vec_id"]
    if block.tests is not None:
        known = known.withColumns({"ok": F.array(*[F.coalesce(ok, F.lit(False)) for ok, _ in block.tests]), "factor": F.array(*[x.cast("double") for _, x in block.tests])})
        keep += ["ok", "factor"]
    if index is None:
        rows = ix.counted(known, asked.terms, tuple(keep))
    else:
        terms = chunks.sparkSession.createDataFrame([*enumerate(asked.terms)], "at int, term string")
        found = index.postings.join(F.broadcast(terms), "term").groupBy("id").agg(F.max("dl").alias("dl"), F.sort_array(F.collect_list(F.struct("at", F.col("tf").cast("int").alias("tf")))).alias("s"))
        found = found.select("id", "dl", F.col("s.at").alias("at"), F.col("s.tf").alias("tf"))
        none = F.array().cast("array<int>")
        rows = known.select("id", *keep).join(found, "id", "left").select("id", *keep, F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("at", none).alias("at"), F.coalesce("tf", none).alias("tf"))
    if vectors is not None:
        rows = rows.join(vectors.where(F.col("vec").isNotNull()), "vec_id").drop("vec_id")
    rows = ix.stored(rows, "seen")
    size = rows.agg(F.min_by(F.size("vec"), "id")).first()[0]
    rows = rows.where(F.size("vec") == F.lit(size))
    _, idf, avgdl = ix.idf_of(rows, asked.terms)
    if index is not None:
        number = {t: i for i, t in enumerate(asked.terms)}
        for r in index.terms.join(F.broadcast(terms), "term").select("term", "idf").toLocalIterator():
            idf[number[r[0]]] = r[1]
        avgdl = index.stats.select("avgdl").first()[0]
    return rows, ix.Scorer(asked, idf, avgdl)


def _scored(batch, have, m, scorer, filtered: bool):
    """(ids, cos, bm, ok, factor) of the slices of a batch; a column for each question, cos only for those that have a vector."""
    import numpy as np

    for part, bm in scorer.parts(batch):
        cos = None if m is None else np.round(_matrix_of(part.column("vec"), m.shape[1]) @ m.T, 6)
        ok, factor = (_matrix_of(part.column(c), scorer.questions) for c in ("ok", "factor")) if filtered else (None, None)
        yield _ids(part), cos, bm, ok, factor


def _candidates(seen: DataFrame, block: _Block, scorer, most: int) -> DataFrame:
    """(q, id, cos, bm, factor, ok) of what can be in a result: each question's `most` nearest chunks, and of those that pass its
    `most` best by terms and its `most` of least id. A task keeps so many of its own; the scores of a slice are made, looked at
    and dropped."""
    import numpy as np
    import pyarrow as pa

    shared = seen.sparkSession.sparkContext.broadcast((*block.matrix(), scorer))
    filtered = block.tests is not None

    def run(batches):
        have, m, scorer = shared.value
        held: dict = {}

        def offer(kind, q, keys, ids, at, *more):
            """Of the rows at these places, and those held so far, the first ones are held."""
            new = [keys[at], ids[at], *(x[at] for x in more)]
            old = held.get((kind, q))
            both = [np.concatenate(x) for x in zip(old, new)] if old else new
            few = ix.first(both[0], both[1], most)
            held[kind, q] = [x[few] for x in both]

        for batch in batches:
            for ids, cos, bm, ok, factor in _scored(batch, have, m, scorer, filtered):
                nothing, every = np.full(len(ids), np.nan), np.ones(len(ids), bool)
                column = {q: cos[:, j] for j, q in enumerate(have)} if cos is not None else {}
                for q in range(scorer.questions):
                    c, passing = column.get(q, nothing), ok[:, q].astype(bool) if filtered else every
                    rest = c, bm[:, q], factor[:, q] if filtered else np.ones(len(ids)), passing
                    if q in column:
                        offer(0, q, -c, ids, ix.first(-c, ids, most), *rest)
                    hit = np.flatnonzero(passing & (bm[:, q] > 0))
                    if len(hit):
                        offer(1, q, -bm[:, q], ids, hit[ix.first(-bm[hit, q], ids[hit], most)], *rest)
                    own = np.flatnonzero(passing)
                    if len(own):
                        few = own[np.argpartition(ids[own], most - 1)[:most]] if len(own) > most else own
                        offer(2, q, np.zeros(len(ids)), ids, few, *rest)
        if held:
            of = [[k for (k, _), x in held.items() for _ in x[1]], [q for (_, q), x in held.items() for _ in x[1]]]
            key, i, c, b, f, p = (np.concatenate(x) for x in zip(*held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(of[0], pa.int32()), pa.array(of[1], pa.int32()), pa.array(key), pa.array(i, pa.int64()), pa.array(c), pa.array(b), pa.array(f), pa.array(p)], names=["kind", "q", "key", "id", "cos", "bm", "factor", "ok"])

    columns = ["id", "vec", "dl", "at", "tf"] + (["ok", "factor"] if filtered else [])
    found = seen.select(*columns).mapInArrow(run, "kind int, q int, key double, id long, cos double, bm double, factor double, ok boolean")
    place = F.row_number().over(Window.partitionBy("q", "kind").orderBy("key", "id"))
    return found.withColumn("r", place).where(F.col("r") <= most).where("ok").select("q", "id", "cos", "bm", "factor")


def _ranks(seen: DataFrame, block: _Block, scorer, thresholds: dict) -> DataFrame:
    """(kind, q, place, n): how many chunks stand at each place among a question's candidates: by cosine (kind 0); of those that
    pass, by id (1); and of these, those that have a term of it, by score (2) and by id (3)."""
    import numpy as np
    import pyarrow as pa

    shared = seen.sparkSession.sparkContext.broadcast((*block.matrix(), scorer, thresholds))
    filtered = block.tests is not None

    def run(batches):
        have, m, scorer, known = shared.value
        column, sums = {q: j for j, q in enumerate(have)}, {}

        def add(kind, q, numbers):
            sums[kind, q] = sums.get((kind, q), 0) + numbers

        for batch in batches:
            for ids, cos, bm, ok, _ in _scored(batch, have, m, scorer, filtered):
                for q, t in known.items():
                    among = lambda x, t=t: np.bincount(np.searchsorted(t["ids"], x, "right"), minlength=len(t["ids"]) + 1)
                    if q in column:
                        add(0, q, _before(-cos[:, column[q]], ids, t["cos"], t["cos_ids"]))
                    passing = ok[:, q].astype(bool) if filtered else np.ones(len(ids), bool)
                    add(1, q, among(ids[passing]))
                    hit = passing & (bm[:, q] > 0)
                    add(2, q, _before(-bm[hit, q], ids[hit], t["bm"], t["bm_ids"]))
                    add(3, q, among(ids[hit]))
        rows = [(kind, q, int(j), int(numbers[j])) for (kind, q), numbers in sums.items() for j in np.flatnonzero(numbers)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["kind", "q", "place", "n"])

    columns = ["id", "vec", "dl", "at", "tf"] + (["ok", "factor"] if filtered else [])
    return seen.select(*columns).mapInArrow(run, "kind int, q int, place long, n long")


def _best(chunks: DataFrame, block: _Block, k: int, constant: int, most_boost: float, index: ix.Index | None, vectors: DataFrame | None = None) -> list[tuple[int, int, float, int]]:
    """The k best (qid, id, score, rank) of each question of a block. Chunks are cut into terms and stored once, then read for
    the statistics, the candidates and their ranks."""
    import math

    import numpy as np

    kth = constant + k - 1
    most = math.ceil(2 * most_boost * kth) - constant + 1  # a chunk at this rank in both lists is below the k-th of BM25 alone
    seen, scorer = _counted(chunks, block, index, vectors)
    found = _candidates(seen, block, scorer, most).toPandas().drop_duplicates(["q", "id"])  # for each question a number that depends on k alone
    thresholds, of_question = {}, {}
    for q, rows_of in found.groupby("q"):
        ids, c, b = rows_of["id"].to_numpy(), rows_of["cos"].to_numpy(float), rows_of["bm"].to_numpy(float)
        # of the least ids, only those that follow the ones with a term can be in the result
        keep = np.zeros(len(ids), bool)
        if not np.isnan(c).all():
            keep[ix.first(-c, ids, most)] = True
        keep[ix.first(-b, ids, most)] = True
        ids, c, b, factor = ids[keep], c[keep], b[keep], rows_of["factor"].to_numpy(float)[keep]
        by_cos, by_bm = np.lexsort((ids, -c)), np.lexsort((ids, -b))
        by_bm = by_bm[b[by_bm] > 0]
        thresholds[q] = {"cos": -c[by_cos], "cos_ids": ids[by_cos], "bm": -b[by_bm], "bm_ids": ids[by_bm], "ids": np.sort(ids)}
        of_question[q] = ids, c, b, factor, by_cos, by_bm
    if not thresholds:
        return []
    sums: dict = {}
    for kind, q, place, n in _ranks(seen, block, scorer, thresholds).groupBy("kind", "q", "place").agg(F.sum("n")).collect():
        sums.setdefault((kind, q), {})[place] = n
    out = []
    for q, (ids, c, b, factor, by_cos, by_bm) in of_question.items():

        def ahead(kind: int, size: int, q=q):
            found = sums.get((kind, q), {})
            return np.cumsum([found.get(j, 0) for j in range(size + 1)])

        sorted_ids = np.argsort(ids, kind="stable")
        cos_rank, bm_rank, all_before, hits_before = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        cos_rank[by_cos] = ahead(0, len(ids))[:-1]
        bm_rank[by_bm] = ahead(2, len(by_bm))[:-1]
        all_before[sorted_ids], hits_before[sorted_ids] = ahead(1, len(ids))[:-1], ahead(3, len(ids))[:-1]
        without = b <= 0  # those without a term come after all that have one, in order of id
        bm_rank[without] = ahead(2, len(by_bm))[-1] + all_before[without] - hits_before[without]
        has_vector = block.vectors[q] is not None
        score = np.array([round(float(x), 9) for x in ((1.0 / (constant + cos_rank) if has_vector else 0.0) + 1.0 / (constant + bm_rank)) * factor])
        tie = cos_rank if has_vector else bm_rank
        for rank, i in enumerate(np.lexsort((tie, -score))[:k], 1):
            out.append((block.ids[q], int(ids[i]), float(score[i]), rank))
    return out


RESULT = "qid long, id long, score double, rank int"


def hybrid(chunks: DataFrame, questions: DataFrame, index: ix.Index | None = None, k: int = C.TOP_K, constant: int = C.RRF_K, vectors: DataFrame | None = None) -> DataFrame:
    """The k best (qid, id, score, rank) for each plain question (qid, question, vec), without query language; for evaluation.
    vectors: (vec_id, vec) of chunks that have a vec_id. Questions go in blocks of bounded size; what a block brings to the driver depends on k and its questions."""
    out = []
    for block in _blocks(questions.where("vec is not null")):
        out += _best(chunks, block, k, constant, 1.0, index, vectors)
    return chunks.sparkSession.createDataFrame(out, RESULT)


def search(chunks: DataFrame, queries: list[tuple[int, str, list[float] | None]], k: int = C.TOP_K, index: ix.Index | None = None, tag_boost: float = 1.0, constant: int = C.RRF_K, vectors: DataFrame | None = None) -> DataFrame:
    """The k best (qid, id, score, rank) of each (qid, text, vector) in the query language. A vector counts only beside free text.
    vectors: (vec_id, vec) of chunks that have a vec_id."""
    spark: SparkSession = chunks.sparkSession
    block = _Block([], [], [], [])
    asked = []
    for qid, text, vec in queries:
        p = parse(text)
        plain = p.free or text or ""
        if not plain:
            continue
        asked.append((qid, plain))
        own = _query_tags(plain)
        factor = F.when(F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, own))), tag_boost).otherwise(1.0) if own and tag_boost != 1 else F.lit(1.0)
        block.ids.append(qid)
        norm = sum(float(x) ** 2 for x in vec) ** 0.5 if vec else 0.0
        block.vectors.append([float(x) / (norm or 1.0) for x in vec] if vec and p.free else None)
        block.tests.append((passes(p, F.col("source"), F.col("text"), F.col("tags")), factor))
    if not asked:
        return spark.createDataFrame([], RESULT)
    questions = spark.createDataFrame([(i, plain) for i, (_, plain) in enumerate(asked)], "i int, question string")
    block.terms = [Counter(toks) for _, toks in sorted(questions.select("i", T.tokens(F.col("question"))).collect())]
    return spark.createDataFrame(_best(chunks, block, k, constant, max(1.0, tag_boost), index, vectors), RESULT)


def _query_tags(text: str) -> list[str]:
    """The tags that a query's own words would get."""
    w = r"\w"
    plain = {tag: rx.replace(rf"[{T.WORD}]", w).replace(rf"[^{T.WORD}]", r"\W").replace(rf"[{T.SPACE}]", r"\s").replace(r"\p{Nd}", r"\d") for tag, rx in T.TAGS.items()}
    return [tag for tag, rx in plain.items() if re.search(rx, text, re.I)]
