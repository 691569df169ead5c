"""Token counts with a whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary strings that their own merges rebuild as one token. prove() finds these
strings once, on the driver, by encoding each vocabulary string alone; counting then adds one for such a pre-token
without merging, and only the rest goes through the merges (of a faster encoder with the same ranks, checked first). Texts are cut at spaces between two characters that are not
white space: no pre-token of this pattern reaches across such a cut, so a chunk's count doesn't depend on its
neighbours, and a worker remembers it.

Defined results: null text counts as empty (0 tokens); special strings inside a text become the special token, as the
library does by default; repeated rows are counted each; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, Table, by_rows, id_and_text, tokenizer_path, worker_takes

VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary's pre-tokenizer. Used on plain characters only; for others the library splits the chunk itself.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile(r"[\n\x20-\x7eÀ-ɏ]*")
_TWO_SPACES = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, object] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merger(tok):
    """A fast encoder with the same vocabulary, whose ids are the merges' ranks; special strings are plain text to it."""
    import tiktoken

    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in s): i for s, i in tok.get_vocab(with_added_tokens=False).items()}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def prove(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as their one id. Also holds the merger against the library."""
    import regex
    from tokenizers import Tokenizer

    tok, one = Tokenizer.from_file(path), regex.compile(PATTERN)
    enc, ranks = merger(tok)
    strings = {}
    for b, i in ranks.items():
        try:
            strings[b.decode()] = i
        except UnicodeDecodeError:
            continue
    names = [s for s in strings if _PLAIN.fullmatch(s) and (m := one.match(s)) and m.end() == len(s)]
    ids = [e.ids for e in tok.encode_batch(names, add_special_tokens=False)]
    if any(enc.encode_ordinary(s) != i for s, i in zip(names, ids)):
        raise ValueError(f"the ranks of {path} are not its merges")
    return frozenset(s for s, i in zip(names, ids) if i == [strings[s]])


def cut(text: str) -> list[str]:
    """Chunks of a text, all but the first without the space before them; no pre-token reaches from one into another."""
    even = text[0] != " " != text[-1] and not _TWO_SPACES.search(text)
    return text.split(" ") if even else _SAFE_CUT.split(text)


class Counter:
    """Counts the tokens of texts. whole: the strings that prove() gave."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        self.tok, self.whole, self.pre = Tokenizer.from_file(path), whole, regex.compile(PATTERN)
        self.enc, _ = merger(self.tok)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special_rx = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merged = Memo(lambda s: len(self.enc.encode_ordinary(s)))
        self.first = Memo(self.chunk, 20_000)
        self.spaced = Table(lambda words: [self.chunk(" " + w) for w in words])

    def chunk(self, s: str) -> int:
        if s in self.whole:
            return 1
        if not _PLAIN.fullmatch(s):
            return len(self.tok.encode(s, add_special_tokens=False).ids)
        whole, merged = self.whole, self.merged
        return sum(1 if p in whole else merged[p] for p in self.pre.findall(s))

    def batch(self, texts: list[str]) -> list[int]:
        parts, special = [], []
        for t in texts:
            found = self.special_rx.split(t) if self.special_rx and any(s in t for s in self.special) else [t]
            special.append(len(found) // 2)
            parts.append([cut(p) for p in found[::2] if p])
        table = self.spaced.of({w for cuts in parts for first, *rest in cuts for w in rest}).__getitem__
        return [n + sum(self.first[words[0]] + sum(map(table, words[1:])) for words in cuts) for n, cuts in zip(special, parts)]


def _counter(path: str, whole: frozenset[str]) -> Counter:
    """One for a worker's lifetime; functions of a module, unlike its variables, are not copied into tasks."""
    if path not in _loaded:
        _loaded[path] = Counter(path, whole)
    return _loaded[path]


def _forget() -> None:
    _loaded.clear()


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; one pass, no shuffle. Only the vocabulary's proven strings are broadcast."""
    path = tokenizer or tokenizer_path(VOCABULARY)
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        worker_takes("token_count", _forget)
        count = _counter(path, whole.value).batch

        def rows(columns):
            n = count(columns[1])
            return columns[0], [len(t.encode()) for t in columns[1]], n, [x > limit for x in n]

        return by_rows(batches, rows, schema)

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
