"""Token ids in training order, as binary shards.

Every sequence of at most `length` tokens gets a running number and from it, by a keyed Feistel permutation with cycle
walking, a global slot: a bijection of 0..N-1 that needs no table, can be inverted, and is the same on every machine.
Shard k holds the slots from k * records on, in order, as records of one size, so a reader finds slot s at byte
(s % records) * stride of file s // records, reads on from there, and resumes from a slot alone.

A record is, little-endian: int64 document id, int32 number of the sequence in its document, int32 tokens used, `length`
token ids of 2 bytes (4 for vocabularies beyond 65,536; unused ones are 0), and a newline byte.

Running numbers: pass 1 counts each partition's sequences, pass 2 adds up from there. Both read the same partitions of
one plan; pass 2 compares each partition's ids and texts with a checksum over all their bytes from pass 1 and raises where
they differ, so a table whose rows come in another order can't give a wrong result (store such a table first). Ids take more
room than compressed text, so encoding twice is cheaper than storing them. The payload is shuffled once, straight to the
task that writes its shard; a task writes several shards, each a file in a folder of its number. Only a number for each
partition goes to the driver.

Defined results: a null text counts as empty and has no sequence, a null id is kept as -2**63; repeated rows have
their own sequences; other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Memo, by_rows, fresh_path, id_and_text, tokenizer_path, worker_takes
from .token_count import _TWO_SPACES, VOCABULARY, merger

#: Shards that one task writes, and so many tasks write at most: beyond that each writes more.
SHARDS_A_TASK, WRITERS = 16, 20_000
HEAD = "<qii"
HEAD_SIZE = struct.calcsize(HEAD)
NO_ID = -(2**63)
_loaded: dict[str, object] = {}


@dataclass(frozen=True)
class Feistel:
    """A keyed bijection of 0..n-1, over numpy arrays: a balanced Feistel network over the next even power of two."""

    n: int
    key: str = "parchment"
    rounds: int = 6

    def _keys(self) -> np.ndarray:
        digest = hashlib.blake2b(f"{self.key}/{self.n}".encode(), digest_size=8 * self.rounds if self.rounds <= 8 else 64).digest()
        return np.frombuffer(digest, np.uint64)[: self.rounds]

    def _half(self) -> int:
        return max(1, math.ceil(max(1, (self.n - 1).bit_length()) / 2))

    @staticmethod
    def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(32))

    def _walk(self, x, keys, inverse: bool) -> np.ndarray:
        h = np.uint64(self._half())
        mask = np.uint64((1 << int(h)) - 1)

        def once(v):
            left, right = v >> h, v & mask
            for k in keys:
                if inverse:
                    left, right = right ^ (self._mix(left, k) & mask), left
                else:
                    left, right = right, left ^ (self._mix(right, k) & mask)
            return left << h | right

        out = once(np.asarray(x, np.uint64))
        while (beyond := out >= np.uint64(self.n)).any():  # each walk ends, as the permutation's cycles come back below n
            out[beyond] = once(out[beyond])
        return out.astype(np.int64)

    def __call__(self, index) -> np.ndarray:
        return self._walk(index, self._keys(), False)

    def inverse(self, slot) -> np.ndarray:
        return self._walk(slot, self._keys()[::-1], True)


class Encoder:
    """Ids of many texts at once.

    The words of a batch, each with the space before it, are looked up in a table that numpy reads for all of them
    together. The table holds the words themselves, up to 16 bytes as two numbers beside their length, so a hit is the
    same word and not only the same hash; longer words are looked up one by one. Only words that aren't there are encoded,
    as one text. Texts whose white space isn't single take the plain way. Table and pool have a fixed size.
    """

    BITS, POOL, LONG_WORDS, LONGEST = 21, 6_000_000, 50_000, 100
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.enc, ranks = merger(tok)
        self.dtype = np.uint16 if max(ranks.values()) < 65_536 else np.uint32
        self.space = np.zeros(max(ranks.values()) + 1, bool)
        self.space[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.one = lambda s: np.array(self.enc.encode_ordinary(s), self.dtype)
        self.first = Memo(self.one, 20_000)
        self.clear()

    def clear(self) -> None:
        n = 1 << self.BITS
        self.low, self.high, self.lengths = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int8)
        self.starts, self.sizes = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used = np.empty(self.POOL, self.dtype), 0

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin with a space, one after another, and how many each has. Encoded as one text, whose tokens that
        begin with a space are where words begin."""
        ids = self.one(b"".join(words).decode())
        at = np.flatnonzero(self.space[ids])
        if len(at) == len(words):
            return ids, np.diff(at, append=len(ids)).astype(np.int32)
        apart = [self.one(w.decode()) for w in words]
        return np.concatenate(apart), np.array([len(i) for i in apart], np.int32)

    def look_up(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the buffer: where its ids begin in a pool, how many they are, and that pool."""
        raw = np.frombuffer(buffer + bytes(24), np.uint8)
        at = np.flatnonzero(raw[: len(buffer)] == 32)
        ends = np.append(at[1:], len(buffer))
        lengths = ends - at - 1
        eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the 8 bytes from each place on
        low = eights[at + 1] & self.MASKS[np.minimum(lengths, 8)]
        high = eights[np.minimum(at + 9, len(buffer))] & self.MASKS[np.clip(lengths - 8, 0, 8)]
        slots = (Feistel._mix(low ^ Feistel._mix(high, np.uint64(0x13198A2E03707344)), lengths.astype(np.uint64)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        starts, sizes = self.starts[slots], self.sizes[slots]
        short = lengths <= 16
        hit = short & (self.low[slots] == low) & (self.high[slots] == high) & (self.lengths[slots] == lengths)
        unknown: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(~short).tolist():
            word = buffer[at[i] : ends[i]]
            if (known := self.long.get(word)) is not None:
                starts[i], sizes[i] = known
                hit[i] = True
            else:
                unknown.setdefault(word, []).append(i)
        pool = self.pool
        misses = np.flatnonzero(short & ~hit)
        if not len(misses) and not unknown:
            return starts, sizes, pool
        order = misses[np.lexsort((high[misses], low[misses], lengths[misses]))]  # equal words together
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]) | (lengths[order][1:] != lengths[order][:-1])
        kinds = order[new]
        flat, counts = self.encode_words([*(buffer[a:b] for a, b in zip(at[kinds].tolist(), ends[kinds].tolist())), *unknown])
        if self.used + len(flat) > self.POOL:
            held = np.flatnonzero(hit)
            kept = self.gather(pool, starts[held], sizes[held])
            starts[held] = np.cumsum(sizes[held]) - sizes[held]
            self.clear()
            places = len(kept) + np.cumsum(counts) - counts
            pool = np.concatenate([kept, flat])
        else:
            places = (self.used + np.cumsum(counts) - counts).astype(np.int32)
            pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            where = slots[kinds]
            where, last = np.unique(where[::-1], return_index=True)  # one word of each place, so that its parts belong together
            put = kinds[::-1][last]
            self.low[where], self.high[where], self.lengths[where] = low[put], high[put], lengths[put]
            self.starts[where], self.sizes[where] = places[: len(kinds)][::-1][last], counts[: len(kinds)][::-1][last]
            if len(self.long) > self.LONG_WORDS:
                self.long = {}
            self.long.update((w, (p, n)) for w, p, n in zip(unknown, places[len(kinds) :].tolist(), counts[len(kinds) :].tolist()) if len(w) <= self.LONGEST)
        which = np.cumsum(new) - 1
        starts[order], sizes[order] = places[which], counts[which]
        for j, rows in enumerate(unknown.values(), len(kinds)):
            starts[rows], sizes[rows] = places[j], counts[j]
        return starts, sizes, pool

    @staticmethod
    def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return pool[:0]
        before = np.cumsum(sizes) - sizes
        return pool[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]

    def _batch(self, texts: list[str], ids_too: bool) -> list:
        out: list = [None] * len(texts)
        even, firsts, rests = [], [], []
        for i, t in enumerate(texts):
            if not t or t[0] == " " or t[-1] == " " or _TWO_SPACES.search(t):
                out[i] = self.one(t) if ids_too else len(self.enc.encode_ordinary(t))
                continue
            first, space, rest = t.partition(" ")
            even.append(i)
            firsts.append(self.first[first])
            rests.append((space + rest).encode())
        if not even:
            return out
        starts, sizes, pool = self.look_up(b"".join(rests)) if any(rests) else (np.empty(0, np.int32), np.empty(0, np.int32), self.pool)
        words = np.cumsum([0, *(r.count(b" ") for r in rests)])
        tokens = np.concatenate([[0], np.cumsum(sizes)])[words]
        if not ids_too:
            for i, f, n in zip(even, firsts, np.diff(tokens).tolist()):
                out[i] = len(f) + n
            return out
        flat = self.gather(pool, starts, sizes)
        for i, f, a, b in zip(even, firsts, tokens.tolist(), tokens[1:].tolist()):
            out[i] = np.concatenate([f, flat[a:b]])
        return out

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return self._batch(texts, True)

    def counts(self, texts: list[str]) -> list[int]:
        return self._batch(texts, False)


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _forget() -> None:
    _loaded.clear()


@dataclass(frozen=True)
class Shards:
    """Where the shards are, and what a reader has to know."""

    path: str
    n: int
    length: int
    records: int
    stride: int
    key: str

    def files(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(self.path)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = 512, records: int = 8192, key: str = "parchment") -> Shards:
    """Writes shards of `records` sequences under path, through Spark's own committer, and returns their description."""
    spark = docs.sparkSession
    vocabulary = tokenizer or tokenizer_path(VOCABULARY)
    rows = id_and_text(docs, id_col, text_col)
    count_schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])

    def counted(batches):
        worker_takes("training_order", _forget)
        encoder, n, crc, seen = _encoder(vocabulary), 0, 0, False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                ids, texts = (c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)
                seen = True
                crc = _checksum(ids, texts, crc)
                n += sum(-(-tokens // length) for tokens in encoder.counts(texts))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([crc])], schema=count_schema)

    found = sorted(rows.mapInArrow(counted, "part long, n long, crc long").collect())  # a row for each partition
    starts, n = {}, 0
    for part, some, crc in found:
        starts[part], n = (n, crc), n + some
    width = 2 if _vocabulary_size(vocabulary) <= 65_536 else 4
    stride = HEAD_SIZE + length * width + 1
    if not n:
        return Shards(path, 0, length, records, stride, key)
    starts, order = spark.sparkContext.broadcast(starts), Feistel(n, key)
    schema = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("record", pa.binary())])

    def laid_out(batches):
        worker_takes("training_order", _forget)
        encoder, part, crc = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        at_number, expected = starts.value.get(part, (0, 0))
        size = length * width

        def rows_of(columns):
            nonlocal at_number, crc
            heads, bodies = [], []
            crc = _checksum(*columns, crc)
            for i, tokens in zip(columns[0], encoder.batch(columns[1])):
                b = tokens.tobytes()
                for k, a in enumerate(range(0, len(b), size)):
                    body = b[a : a + size]
                    heads.append(struct.pack(HEAD, NO_ID if i is None else i, k, len(body) // width))
                    bodies.append(body)
            slots = order(np.arange(at_number, at_number + len(heads)))
            at_number += len(heads)
            return pa.array((slots // records).astype(np.int32)), pa.array(slots), [h + b + bytes(size - len(b)) for h, b in zip(heads, bodies)]

        yield from by_rows(batches, rows_of, schema)
        if crc != expected:
            raise ValueError("the rows of a partition differ between two reads of it; store the table first")

    out = rows.mapInArrow(laid_out, "shard int, slot long, record binary")
    shards = -(-n // records)
    together = max(SHARDS_A_TASK, -(-shards // WRITERS))
    (
        out.repartitionById(-(-shards // together), F.expr(f"shard div {together}").cast("int"))
        .sortWithinPartitions("shard", "slot")
        .select("shard", F.col("record").cast("string"))
        .write.partitionBy("shard")
        .option("lineSep", "\n")
        .text(path)
    )
    return Shards(path, n, length, records, stride, key)


def _checksum(ids: list, texts: list[str], crc: int) -> int:
    for i, t in zip(ids, texts):
        crc = zlib.crc32(t.encode(), zlib.crc32(str(i).encode(), crc))
    return crc


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def read_index(spark: SparkSession, shards: Shards, with_ids: bool = True) -> DataFrame:
    """A row for each record, read back from the shards: (slot, shard, byte_offset, doc_id, seq_no, n_tokens, ids_sha256, ids array<int>).
    The digest is that of the used ids' bytes as they are in the record; without with_ids the ids themselves are left out."""
    fields = "slot long, shard int, byte_offset long, doc_id long, seq_no int, n_tokens int, ids_sha256 string" + (", ids array<int>" if with_ids else "")
    if not shards.n:
        return spark.createDataFrame([], fields)
    stride, records, length = shards.stride, shards.records, shards.length
    width = (stride - HEAD_SIZE - 1) // length
    kind = np.dtype([("doc", "<i8"), ("seq", "<i4"), ("n", "<i4"), ("ids", "<u2" if width == 2 else "<u4", (length,)), ("end", "u1")])

    def columns(a: np.ndarray, k: int, at: int) -> Iterator[pa.Array]:
        slots = np.arange(at, at + len(a)) + k * records
        yield pa.array(slots)
        yield pa.array(np.full(len(a), k, np.int32))
        yield pa.array((slots - k * records) * stride)
        yield pa.array(np.ascontiguousarray(a["doc"]), mask=np.ascontiguousarray(a["doc"] == NO_ID))
        yield pa.array(a["seq"].copy())
        yield pa.array(a["n"].copy())
        yield pa.array([hashlib.sha256(ids[:n].tobytes()).hexdigest() for ids, n in zip(a["ids"], a["n"].tolist())])
        if with_ids:
            used = a["ids"][np.arange(length) < a["n"][:, None]].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(a["n"])]).astype(np.int32)), pa.array(used))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                k, all_of = batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer(), kind)
                for at in range(0, len(all_of), 1024):
                    made = [*columns(all_of[at : at + 1024], k, at)]
                    yield pa.RecordBatch.from_arrays(made, names=[f.split()[0] for f in fields.split(", ")])

    files = shards.files(spark).select(F.regexp_extract("path", r"/shard=([0-9]+)/", 1).cast("int").alias("k"), "content")
    return files.mapInArrow(run, fields)


def training_order(docs: DataFrame, path: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Writes the shards (to a fresh folder in the shared one unless told) and returns their records."""
    spark = docs.sparkSession
    return read_index(spark, write_shards(docs, path or fresh_path(spark, "shards"), **options), with_ids)
