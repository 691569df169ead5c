"""SentencePiece encoding and decoding over a table of distinct chunks.

check_vocabulary() proves from the model file that no piece has the white-space marker after another character. Then no
merge crosses the place before a run of markers, so the ids of a text are the ids of its marked words, one after
another. A worker segments each distinct word once, keeps its ids, and joins them back by position.

Defined results: a null text counts as empty and gives no ids and an empty text; repeated rows are encoded each; other
columns are ignored; texts that hold the marker character itself go through the library whole; empty tables give empty
results.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, by_rows, id_and_text, tokenizer_path, worker_takes

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_CHUNK = re.compile(" *[^ ]+| +")
_loaded: dict[str, object] = {}


def check_vocabulary(processor) -> bool:
    """Whether every piece has its markers in front only, a leading marker is added, and white space is left as it is."""
    inside = re.compile(f"[^{MARK}]{MARK}")
    pieces = map(processor.id_to_piece, range(processor.get_piece_size()))
    return not any(inside.search(p) for p in pieces) and processor.decode(processor.encode("  a  b\t ")) == "  a  b\t "


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.divisible = check_vocabulary(self.sp)
        self.table = Table(self.segmented)

    def segmented(self, words: list[str]) -> list[tuple[bytes, str]]:
        """The ids of each word, as the bytes of their array, and the text that they decode to."""
        ids = self.sp.encode(words, num_threads=1)
        if "" in words:  # the last space of a text is a marker alone; the library adds none to an empty text
            ids[words.index("")] = [self.sp.piece_to_id(MARK)]
        return [(np.array(i, np.int32).tobytes(), w if t == w else t) for w, i, t in zip(words, ids, self.sp.decode(ids, num_threads=1))]

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        cuts = [self.words(t) if t else [] for t in texts]
        table = self.table.of({w for words in cuts for w in words or ()})
        out = []
        for t, words in zip(texts, cuts):
            if words is None:
                out.append((np.array(ids := self.sp.encode(t), np.int32), self.sp.decode(ids)))
            else:
                found = [table[w] for w in words]
                out.append((np.frombuffer(b"".join([i for i, _ in found]), np.int32), " ".join([d for _, d in found])))
        return out

    def words(self, text: str) -> list[str] | None:
        """The marked words, without their own marker; None if the text can't be cut."""
        if not self.divisible or MARK in text:
            return None
        if text[0] != " " != text[-1] and "  " not in text:
            return text.split(" ")
        first, *rest = _CHUNK.findall(text)  # a chunk is a run of spaces and a word; its first space is the marker that the library adds
        return [first, *(c[1:] for c in rest)]


def _codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _forget() -> None:
    _loaded.clear()


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string) for every row; one pass, no shuffle."""
    path = model or tokenizer_path(MODEL)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        worker_takes("piece_codec", _forget)
        codec = _codec(path).batch

        def rows(columns):
            done = codec(columns[1])
            ends = np.cumsum([0, *(len(i) for i, _ in done)], dtype=np.int32)
            return columns[0], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([i for i, _ in done]))), [t for _, t in done]

        return by_rows(batches, rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def with_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what encode_pieces() returned."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
