"""The chunk store: segments of (id, source, ord, text, vec, tags, doc_hash) as Parquet, and what is asked of it.

Files do not change: each change writes what is new and then replaces the manifest, so readers see one state or the other.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment import config as C
from parchment.functions.text import normalised

FIELDS = "id long, source string, ord int, text string, vec array<float>, tags array<string>, doc_hash string"
COLUMNS = [f.split(" ")[0] for f in FIELDS.split(", ")]


def content_hash(text: Column) -> Column:
    return F.sha1(F.encode(text, "UTF-8"))


def statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count("vec").alias("embedded"), F.countDistinct("source").alias("documents"))


def overview(chunks: DataFrame) -> DataFrame:
    """(source, chunks, embedded), in the order of the name, where A-Z count as a-z. A row for each document name is sorted, no chunk."""
    rows = chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.count("vec").alias("embedded"))
    low = F.translate("source", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.orderBy(low, "source")


def first_of_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_hash, first_id, duplicate): the first document of each content stays. Aggregated before it is joined back, so
    a content with many copies is no task of its own."""
    hashed = docs.select(docs[id_col].alias("doc_id"), content_hash(docs[text_col]).alias("doc_hash"))
    first = hashed.groupBy("doc_hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "doc_hash").select("doc_id", "doc_hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


def unseen(new: DataFrame, chunks: DataFrame, on: str = "doc_hash") -> DataFrame:
    return new.join(chunks.select(on).distinct(), on, "left_anti")


def ingest_status(new: DataFrame, chunks: DataFrame, skip_known: bool = False, reject: bool = False) -> DataFrame:
    """(source, status) of new files: what ingestion does with each; the first case that holds.

    new: (source, text, error, n_chunks), and bad, the number of chunks that look broken, if it was counted. skip_known:
    names that are there already are passed over before they are read. reject: files with too large a share of broken
    chunks are not taken, and the broken chunks of others are left out.
    """
    known = chunks.groupBy("doc_hash").agg(F.min("source").alias("__same"))
    old = chunks.groupBy("source").agg(F.count("*").alias("__old"))
    rows = new if "bad" in new.columns else new.withColumn("bad", F.lit(0))
    rows = rows.withColumn("doc_hash", content_hash(F.col("text"))).join(known, "doc_hash", "left").join(old, "source", "left")
    n, bad = F.col("n_chunks").cast("long"), F.coalesce(F.col("bad"), F.lit(0)).cast("long")
    dropped = F.when(F.lit(reject), bad).otherwise(F.lit(0))
    replaced = F.when(F.col("__old").isNotNull(), F.format_string(" (version replaced, %d old removed)", F.col("__old"))).otherwise("")
    left_out = F.when(dropped > 0, F.format_string(" (%d left out as broken)", dropped)).otherwise("")
    note = F.when((n > 0) & (bad > 0), F.concat(F.format_string(" · check: %d/%d broken (", bad, n), percent(bad, n), F.lit("%)"))).otherwise("")
    ok = F.concat(F.format_string("OK, %d chunks", n - dropped), replaced, left_out, note)
    status = (
        F.when(F.lit(skip_known) & F.col("__old").isNotNull(), "already indexed")
        .when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error")))
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty")
        .when(F.col("__same") == F.col("source"), "unchanged")
        .when(F.col("__same").isNotNull(), F.concat(F.lit("duplicate of "), F.col("__same")))
        .when(F.lit(reject) & (bad / n > C.GARBAGE_DOC_MAX), F.concat(F.lit("rejected: "), percent(bad, n), F.lit("% broken")))
        .otherwise(ok)
    )
    return rows.select("source", status.alias("status"))


def percent(part: Column, whole: Column) -> Column:
    """A share as a whole number of percent; halves go to the even one."""
    return F.bround(part * 100 / whole, 0).cast("long").cast("string")


def float_bytes(vec: Column) -> Column:
    """A vector as 32-bit floats, the lowest byte first; null stays null."""
    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return packed(vec.cast("array<float>"))


def float_array(raw: Column) -> Column:
    """The vector of float_bytes()."""
    @F.pandas_udf("array<float>")
    def unpacked(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpacked(raw)


def migrated(rows: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Rows of older stores, whose vectors are JSON text, with arrays of floats; what is no list of numbers becomes null."""
    return rows.withColumn(vec_col, F.from_json(vec_col, "array<float>"))


def upsert_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the vectors of (id, vector), normalised; rows without id or vector count for nothing, the rest keeps what it has."""
    new = vectors.where(F.col("id").isNotNull() & (F.size("vector") > 0)).select("id", normalised(F.col("vector")).cast("array<float>").alias("__new")).dropDuplicates(["id"])
    return chunks.join(new, "id", "left").withColumn("vec", F.coalesce("__new", "vec")).drop("__new").select(*chunks.columns)


def without(chunks: DataFrame, sources: list[str]) -> DataFrame:
    return chunks.where(~F.col("source").isin(*sources)) if sources else chunks


def numbered(new: DataFrame, after: int, staging: str) -> DataFrame:
    """new with dense ids in order of source and ord, from after + 1 on.

    The rows are stored below staging, so that what makes them runs once; then sorted by range and stored with their place
    in their partition. How many each stored partition has, a row for each, is broadcast as offsets. All reads are of what
    is stored, so a plan that changes between them, or a lost executor, can't move a row to another number.
    """
    spark = new.sparkSession
    new.write.parquet(f"{staging}/rows")
    new = spark.read.schema(new.schema).parquet(f"{staging}/rows")
    places = new.repartitionByRange("source", "ord").sortWithinPartitions("source", "ord").withColumn("__place", F.monotonically_increasing_id())
    places.write.parquet(f"{staging}/places")
    rows = spark.read.schema(places.schema).parquet(f"{staging}/places").withColumn("__part", F.shiftright("__place", 33))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("__part").count().collect())
    offsets, total = [], after
    for part, n in counts:
        offsets.append((part, total))
        total += n
    offsets = spark.createDataFrame(offsets, "__part long, __offset long")
    within = F.col("__place").bitwiseAND((1 << 33) - 1)
    out = rows.join(F.broadcast(offsets), "__part").withColumn("id", F.col("__offset") + within + 1)
    return out.drop("__part", "__place", "__offset")


class Store:
    """Segments of Parquet and a manifest that says which of them count, as one JSON file that is replaced in one step.

    Adding writes the new rows as a segment of their own; what it replaces is named by tombstones (a source, and the segments
    before which it is gone), stored as Parquet too. Nothing else is rewritten until `most` segments are there, which are then
    made one. Segments that neither this manifest nor the one before it names are deleted, so a reader that began before a
    change can end. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 64):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    # ---- the manifest
    def _file(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        at, fs = self._file("current.json")
        if not fs.exists(at):
            return {"segments": [], "gone": [], "last": 0, "before": []}
        return json.loads(self.spark.read.text(at.toString(), wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        old, jvm = self._manifest(), self.spark.sparkContext._jvm
        named = lambda m: [x["name"] for x in m["segments"]] + m["gone"]
        manifest = manifest | {"before": named(old)}
        at, fs = self._file("current.json")
        new, _ = self._file(f"next-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(new), fs.makeQualified(at), how)  # in one step: there is a manifest at any time
        for name in {*old["before"]} - {*named(old), *named(manifest)}:
            self._drop(name)

    def _drop(self, name: str) -> None:
        at, fs = self._file(name)
        fs.delete(at, True)

    # ---- reading
    def _rows(self, segments: list[dict], gone: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], FIELDS)
        parts = [self.spark.read.schema(FIELDS).parquet(f"{self.path}/{x['name']}").withColumn("__at", F.lit(x["at"])) for x in segments]
        rows = reduce(DataFrame.unionByName, parts)
        if gone:
            dead = self.spark.read.schema("source string, until long").parquet(*[f"{self.path}/{name}" for name in gone])
            rows = rows.join(dead.groupBy("source").agg(F.max("until").alias("__until")), "source", "left").where("__until is null or __at >= __until")
        return rows.select(*COLUMNS)

    def read(self) -> DataFrame:
        m = self._manifest()
        return self._rows(m["segments"], m["gone"])

    def pending(self) -> DataFrame:
        """(id, text) of the chunks that have no vector yet."""
        return self.read().where(F.col("vec").isNull()).select("id", "text")

    # ---- changes
    def _at(self, m: dict) -> int:
        return max((x["at"] for x in m["segments"]), default=-1) + 1

    def _bury(self, m: dict, sources: DataFrame, until: int) -> str:
        name = f"gone-{uuid.uuid4().hex}"
        sources.select("source", F.lit(until).cast("long").alias("until")).distinct().write.parquet(f"{self.path}/{name}")
        return name

    def replace(self, chunks: DataFrame) -> None:
        """These chunks, with their ids, are the store."""
        name, m = f"segment-{uuid.uuid4().hex}", self._manifest()
        chunks.select(*COLUMNS).write.parquet(f"{self.path}/{name}")
        self._publish({"segments": [{"name": name, "at": self._at(m)}], "gone": [], "last": m["last"]})

    def add(self, chunks: DataFrame) -> None:
        """Append (source, ord, text, tags, doc_hash) without vectors; sources that are there already are replaced. Reads chunks once."""
        m = self._manifest()
        staging, name, at = f"staging-{uuid.uuid4().hex}", f"segment-{uuid.uuid4().hex}", self._at(m)
        new = numbered(chunks.select("source", "ord", "text", "tags", "doc_hash"), m["last"], f"{self.path}/{staging}")
        new = new.withColumn("vec", F.lit(None).cast("array<float>"))
        new.select(*COLUMNS).write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(FIELDS).parquet(f"{self.path}/{name}")
        n = written.count()
        self._drop(staging)
        if not n:
            self._drop(name)
            return
        gone = m["gone"]
        if m["segments"]:
            again = written.select("source").distinct().join(self.read().select("source"), "source", "left_semi")
            gone = [*gone, self._bury(m, again, at)]
        self._publish({"segments": [*m["segments"], {"name": name, "at": at}], "gone": gone, "last": m["last"] + n})
        if len(m["segments"]) + 1 >= self.most:
            self.replace(self.read())

    def delete(self, *sources: str) -> None:
        m = self._manifest()
        if m["segments"] and sources:
            dead = self.spark.createDataFrame([(s,) for s in sources], "source string")
            self._publish(m | {"gone": [*m["gone"], self._bury(m, dead, self._at(m))]})

    def reset(self) -> None:
        self._publish({"segments": [], "gone": [], "last": 0})

    def put_vectors(self, vectors: DataFrame) -> None:
        """Rewrites the segments that hold one of these ids; the others stay as they are."""
        m, segments = self._manifest(), []
        ids = vectors.where("id is not null").select("id").distinct()
        for x in m["segments"]:
            rows = self.spark.read.schema(FIELDS).parquet(f"{self.path}/{x['name']}")
            if rows.join(ids, "id", "left_semi").isEmpty():
                segments.append(x)
                continue
            name = f"segment-{uuid.uuid4().hex}"
            upsert_vectors(rows, vectors).write.parquet(f"{self.path}/{name}")
            segments.append({"name": name, "at": x["at"]})
        self._publish(m | {"segments": segments})
