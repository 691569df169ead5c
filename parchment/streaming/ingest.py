"""Files as they arrive: each micro-batch of a folder goes through extraction, duplicate check and chunking into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchment.operators.store import Store
from parchment.sources import folder

#: What the binaryFile source returns.
FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, path: str, store: Store, checkpoint: str, glossary_below: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A running query. Batches that come again after a failure add nothing, as their contents are known by then."""
    arriving = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    arriving = arriving.select("path", F.substring_index("path", "/", -1).alias("name"), "content")
    arriving = arriving.where(~F.col("name").rlike(r"^(~\$|\.)") & F.regexp_extract(F.lower("name"), r"(\.[^.]*)$", 1).isin(*sorted(folder.KNOWN)))

    def add(batch: DataFrame, _: int) -> None:
        store.add(folder.new_chunks(folder.extract(batch, glossary_below), store.read()))

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def answers(tokens: DataFrame, key: str = "request_id", order: str = "seq", token: str = "token", thinking: bool = True) -> DataFrame:
    """(key, answer) of streamed tokens: joined in order; what comes before the end of the reasoning is withheld."""
    from parchment.operators.prompting import clean_answer

    rows = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, token))).alias("t"))
    return rows.select(key, clean_answer(F.array_join(F.transform("t", lambda x: x[token]), ""), thinking).alias("answer"))
