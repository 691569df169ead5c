"""Order MinHash: fingerprints whose likeness follows edit distance.

A text's k-mers of words (a text of one word: that word) are numbered by occurrence. Each of `hashes` functions picks
the `picks` numbered k-mers of least value, puts them in the order of the text and hashes the tuple; a fingerprint is the
list of these hashes, and the likeness of two is the share of equal places. Moving a passage changes tuples that span it,
which plain MinHash would not see.

Documents are laid out by range of (id, digest of the text, place), so that a document's successor is the next row of its
partition; the first row of each range is also sent to the range before it. Bounds come from a sample of keys of fixed size a
range and are broadcast, as are the ranges' first rows: nothing of them is in the plan. Rows of one id, or without id, are split like
any others. Each text is shuffled once.

Defined results: a null text counts as empty; a text without words has the fingerprint of no k-mers and is like other such
texts only; equal texts have equal fingerprints, as have texts that differ in white space or the case of A-Z alone; repeated
rows and equal ids are ordered by the MD5 of their texts and each is the next of the one before it; a null id comes
before all; a table of one row is its own successor; other columns are left out; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .neardup import _P1, mix, word_hashes

HASHES, PICKS, WORDS = 64, 2, 2
#: Keys that are sampled for each range.
SAMPLED = 20
#: Values held at once while choosing; bounds memory for very long texts.
AT_ONCE = 2_000_000
_SEEDS = np.frombuffer(hashlib.blake2b(b"order minhash", digest_size=64).digest() * HASHES, np.uint64)[:HASHES] + np.arange(HASHES, dtype=np.uint64) * _P1
_FACTORS = (mix(_SEEDS).astype(np.uint32)) | np.uint32(1)
_SHIFTS = mix(_SEEDS + np.uint64(1)).astype(np.uint32)


def numbered(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of h, each with the number of its occurrence."""
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = mix(x * _P1 + h[j : j + n])
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - first
    return mix(x + occurrence * _P1)


def fingerprint(words: np.ndarray) -> np.ndarray:
    """The tuple hashes of a text, given the hashes of its words."""
    if not len(words):
        return np.zeros(HASHES, np.uint32)
    x = numbered(mix(words), min(WORDS, len(words)))
    low = (x >> np.uint64(32)).astype(np.uint32)
    picked = np.empty((HASHES, min(PICKS, len(x))), np.int64)
    step = max(1, AT_ONCE // len(x))
    for a in range(0, HASHES, step):
        v = (low * _FACTORS[a : a + step, None]) ^ _SHIFTS[a : a + step, None]
        rows = np.arange(len(v))
        for j in range(picked.shape[1]):
            at = v.argmin(axis=1)
            picked[a : a + len(v), j] = at
            v[rows, at] = np.iinfo(np.uint32).max
    picked.sort(axis=1)  # text order
    out = _SEEDS.copy()
    for j in range(picked.shape[1]):
        out = mix(out * _P1 + x[picked[:, j]])
    return out.astype(np.uint32) | np.uint32(1)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    return [*map(fingerprint, word_hashes(texts))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / HASHES


def shown(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: The order of documents: those without id first, then by id, digest of the text, and place.
KEY = ["__has", "__id", "__md5", "__place"]


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"__has": F.col("__id").isNotNull(), "__md5": F.md5(F.encode("__text", "UTF-8")), "__place": F.monotonically_increasing_id()})


def _as_tuple(row) -> tuple:
    return bool(row[0]), 0 if row[1] is None else row[1], row[2], row[3]


def ranges(rows: DataFrame, parts: int) -> DataFrame:
    """rows, keyed, with __range, the range of keys that each is in. The bounds are quantiles of a sample; what they are bears on the
    balance alone."""
    n = rows.count()
    share = min(1.0, SAMPLED * parts / max(1, n))
    sample = sorted(map(_as_tuple, rows.sample(fraction=share, seed=7).select(*KEY).collect())) if parts > 1 else []
    bounds = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(has: pd.Series, ids: pd.Series, md5: pd.Series, place: pd.Series) -> pd.Series:
        from bisect import bisect_right

        keys = zip(has.tolist(), ids.tolist(), md5.tolist(), place.tolist())
        return pd.Series([bisect_right(shared.value, k) for k in keys], dtype="int32")

    return rows.withColumn("__range", range_of("__has", F.coalesce("__id", F.lit(0).cast("long")), "__md5", "__place"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and how like they and the next document's are."""
    spark = docs.sparkSession
    rows = keyed(id_and_text(docs, id_col, text_col))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = ranges(rows, parts)
    heads = rows.groupBy("__range").agg(F.min(F.struct(*KEY)).alias("k")).collect()  # a row for each range
    fields = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not heads:
        return spark.createDataFrame([], fields).withColumnRenamed("id", id_col)
    first_of = {r["__range"]: r["k"] for r in heads}
    order = sorted(first_of)
    # the first range's head follows the last range; a head is known by its id and digest, which rows of equal texts share
    targets = [(order[i - 1], bool(first_of[r][0]), first_of[r][1], first_of[r][2]) for i, r in enumerate(order)]
    targets = F.broadcast(spark.createDataFrame(targets, "__target int, __t_has boolean, __t_id long, __t_md5 string"))
    same = (F.col("__md5") == F.col("__t_md5")) & (F.col("__has") == F.col("__t_has")) & F.col("__id").eqNullSafe(F.col("__t_id"))
    first = rows.join(targets, same).select("__target", "__text").dropDuplicates(["__target"])
    first = first.select(F.lit(None).cast("long").alias("__id"), "__text", F.lit(True).alias("__has"), F.lit("").alias("__md5"), F.lit(0).cast("long").alias("__place"), F.col("__target").alias("__range"), F.lit(1).alias("__tail"))
    laid = rows.withColumn("__tail", F.lit(0)).unionByName(first).repartitionById(max(order) + 1, F.col("__range")).sortWithinPartitions("__range", "__tail", *[F.col(c).asc_nulls_first() for c in KEY])
    laid = laid.select("__range", "__tail", "__id", "__text")
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compared(group: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
        """Rows for all but the last of a run of documents."""
        changed = [edited(a[1], b[1]) for a, b in zip(group, group[1:])]
        prints = fingerprints(changed)
        out = [
            (a[0], len(a[1]), hashlib.sha256(t.encode()).hexdigest(), shown(a[2]), shown(p), likeness(a[2], p), likeness(a[2], b[2]))
            for a, b, t, p in zip(group, group[1:], changed, prints)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        last, of_range = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rng, tail, ids, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                group = [] if last is None else [last]
                for r, t, i, text, print_ in zip(rng, tail, ids, texts, fingerprints(texts)):
                    if of_range is not None and r != of_range:  # the last row of a range is its tail, which is no document of it
                        if len(group) > 1:
                            yield compared(group)
                        group = []
                    of_range = r
                    group.append((i, text, print_))
                if len(group) > 1:
                    yield compared(group)
                last = group[-1] if group else None

    return laid.mapInArrow(run, fields).withColumnRenamed("id", id_col)
