"""What the operators share: the folder that all executors see, text columns, and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.storage import fresh_path, shared_dir

#: Rows that a Python worker turns into Python objects at once; bounds memory whatever the Arrow batch holds.
ROWS_AT_ONCE = 512


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, most: int = 1000) -> DataFrame:
    """left joined (inner) with right, which has a row for each key and in `weight` how many rows of left have it.

    Keys with more than total / most rows, so at most `most` of them for each time a row of left counts in total, are
    broadcast; the others are joined by a shuffle, in which no key is large.
    """
    hot = F.broadcast(right.where(F.col(weight) > total / most))
    cold = right.where(F.col(weight) <= total / most)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these, once nothing reads it any more."""
    for df in frames:
        _forget(df)


def _forget(df: DataFrame) -> None:
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = shared_dir(spark)
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.toString().replace("file:///", "file:/").startswith(base.replace("file:///", "file:/")):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, __id and __text; a null text counts as empty. Other columns, whatever their names, are left out."""
    return df.select(df[id_col].cast("long").alias("__id"), F.coalesce(df[text_col], F.lit("")).alias("__text"))


def by_rows(batches: Iterator[pa.RecordBatch], f: Callable[[list[list]], list], schema: pa.Schema, step: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """f gets the columns of some rows as lists and returns the output columns as lists or arrays."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            out = f([c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)


_holder: list = ["", None]


def worker_takes(owner: str, drop: Callable[[], object]) -> None:
    """Called where an operator's task begins. A Python worker serves one operator after another; what the one before kept
    for its own later tasks is dropped here, so a pipeline's stages don't add up in memory. drop() frees this owner's; it must be
    a function of a module, as variables that a task's own functions name are copies."""
    if _holder[0] == owner:
        return
    if _holder[1] is not None:
        import ctypes
        import gc

        _holder[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library; its memory is only given back later
            pass
    _holder[:] = owner, drop


class Memo(dict):
    """Results by key, for a worker's lifetime; emptied when full, so that its memory is bounded."""

    def __init__(self, f: Callable, entries: int = 100_000, key_chars: int = 100):
        super().__init__()
        self.f, self.entries, self.key_chars = f, entries, key_chars

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= self.key_chars:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class Table:
    """Results by distinct word. What is missing for a batch is made in one go by bulk(list of words) -> iterable of results.

    Two generations bound the memory: when the young one is full it becomes the old one, from which words that occur
    again are taken over, so frequent words stay.
    """

    def __init__(self, bulk: Callable[[list[str]], list], entries: int = 250_000, key_chars: int = 100):
        self.bulk, self.entries, self.key_chars, self.young, self.old = bulk, entries, key_chars, {}, {}

    def of(self, words: set[str]) -> dict:
        """A mapping that has each of these words."""
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for w in words - young.keys():
            if w in old:
                young[w] = old[w]
            else:
                missing.append(w)
        if not missing:
            return young
        made = dict(zip(missing, self.bulk(missing), strict=True))
        if any(len(w) > self.key_chars for w in missing):
            young.update((w, v) for w, v in made.items() if len(w) <= self.key_chars)
            return young | made
        young.update(made)
        return young
