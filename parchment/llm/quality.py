"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counts of character classes, words, lines and repetitions of the text alone. Training takes at most
`sample` labelled rows, those of least hash, so that the driver's memory is bounded; scoring flattens the trees into
arrays and walks all rows of a batch down all trees at once.

Defined results: null and empty texts have zero statistics and get a score like any other; unlabelled rows are scored
too; repeated rows are scored each; labels that are null are not learned from; with no labels, or only one kind, the
score is the share of label 1 (0.5 without any); other columns are left out; empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, by_rows, id_and_text, worker_takes

#: Labelled rows to learn from, at most: memory of the driver is about 0.5 kB a row.
SAMPLE = 20_000
KEEP = 0.7

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (32,),
    "line": (10,),
    "stop": (46,),
    "comma": (44,),
    "bang": (33, 63),
    "bar": (124,),
    "hash": (35,),
    "star": (42,),
    "percent": (37,),
    "dollar": (36,),
    "amp": (38,),
    "angle": (60, 62, 91, 93, 123, 125),
    "slash": (47, 92, 95, 61),
    "quote": (34, 39),
    "colon": (58, 59),
    "at": (64,),
    "control": [*range(0, 9), *range(11, 32), 127],
    "high": range(128, 256),
}
_MAP = np.zeros((256, len(_CLASSES)))
for _j, _bytes in enumerate(_CLASSES.values()):
    _MAP[list(_bytes), _j] = 1
NAMES = [*_CLASSES, "bytes", "words", "word_length", "long_words", "one_letter", "distinct", "top_word", "capital_words", "all_capitals", "odd_end", "sentence_words", "lines", "line_length", "distinct_lines", "short_lines", "bar_lines", "entropy"]
_LOUD = re.compile(r"\b[^\W\d_a-zß-ÿ]{3,}\b")


def statistics(texts: list[str]) -> np.ndarray:
    """A row of statistics for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    k = len(_CLASSES)
    for row, text in zip(out, texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        hist = np.bincount(raw, minlength=256)
        n = len(raw)
        row[:k] = hist @ _MAP / n
        words = text.split()
        lines = [x for x in text.split("\n") if x]
        w = max(1, len(words))
        counts: dict[str, int] = {}
        for x in words:
            counts[x] = counts.get(x, 0) + 1
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = [x[-1] for x in words]
        share = hist[hist > 0] / n
        row[k:] = [
            np.log1p(n),
            np.log1p(len(words)),
            sizes.sum() / w,
            np.count_nonzero(sizes > 14) / w,
            np.count_nonzero(sizes == 1) / w,
            len(counts) / w,
            max(counts.values(), default=0) / w,
            sum(map(str.istitle, words)) / w,
            sum(map(str.isupper, words)) / w,
            sum(not (c.isalnum() or c in ".,;:!?") for c in ends) / w,
            len(words) / (1 + sum(c in ".!?" for c in ends)),
            np.log1p(len(lines)),
            np.log1p(n / max(1, len(lines))),
            len(set(lines)) / max(1, len(lines)),
            sum(len(x) < 30 for x in lines) / max(1, len(lines)),
            sum("|" in x for x in lines) / max(1, len(lines)),
            float(-(share * np.log2(share)).sum()),
        ]
    return out


@dataclass
class Trees:
    """All trees of a model in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting on histograms of binned statistics."""
    n, m = x.shape
    share = min(max(y.mean() if n else 0.5, 1e-4), 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(value)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(m) * bins
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            roots.append(node(0.0))
            level = [(roots[-1], np.arange(n))]
            for d in range(depth + 1):
                following = []
                for at, rows in level:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    value[at] = rate * gs / (hs + ridge)
                    best = None
                    if d < depth and len(rows) >= 2 * least:
                        where = flat[rows].ravel()
                        hist_g = np.bincount(where, np.repeat(g[rows], m), m * bins).reshape(m, bins).cumsum(axis=1)
                        hist_h = np.bincount(where, np.repeat(h[rows], m), m * bins).reshape(m, bins).cumsum(axis=1)
                        hist_n = np.bincount(where, minlength=m * bins).reshape(m, bins).cumsum(axis=1)
                        gain = hist_g**2 / (hist_h + ridge) + (gs - hist_g) ** 2 / (hs - hist_h + ridge) - gs**2 / (hs + ridge)
                        gain[(hist_n < least) | (len(rows) - hist_n < least)] = -np.inf
                        j, b = np.unravel_index(np.argmax(gain), gain.shape)
                        best = (j, b) if gain[j, b] > 1e-6 and b < len(edges[j]) else None
                    if best is None:
                        raw[rows] += value[at]
                        continue
                    j, b = best
                    goes = binned[rows, j] <= b
                    feature[at], threshold[at] = int(j), float(edges[j][b])
                    left[at], right[at] = node(0.0), node(0.0)
                    following += [(left[at], rows[goes]), (right[at], rows[~goes])]
                level = following
    flat_arrays = [np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), np.array(roots, np.int64)]
    return Trees(*flat_arrays, depth, base)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 7) -> Trees:
    """A model from at most `sample` labelled documents, those of least hash of id and seed. Only their statistics come to the driver.
    The limit holds for labels, before the join, and for documents after it, as an id may have many rows."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).select(labels[id_col].cast("long").alias("__id"), labels[label_col].cast("double").alias("__y"))
    known = known.orderBy(F.xxhash64("__id", F.lit(seed)), "__id", "__y").limit(sample)
    texts = id_and_text(docs, id_col, text_col)
    rows = texts.join(F.broadcast(known), "__id").select("__id", "__text", "__y")
    schema = pa.schema([("id", pa.int64()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        def of_rows(columns):
            return columns[0], columns[2], pa.array(list(statistics(columns[1])), pa.list_(pa.float64()))

        return by_rows(batches, of_rows, schema)

    known = rows.mapInArrow(run, "id long, y double, x array<double>").orderBy(F.xxhash64("id", F.lit(seed)), "id", "y", F.xxhash64("x")).limit(sample)
    got = known.toPandas().sort_values(["id", "y"], kind="stable")
    if not len(got):
        return fit(np.empty((0, len(NAMES))), np.empty(0))
    return fit(np.stack(got["x"].to_list()), got["y"].to_numpy())


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(id, score, predicted) of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        worker_takes("quality", int)

        def of_rows(columns):
            s = shared.value.score(statistics(columns[1]))
            return columns[0], s, (s >= keep).astype(np.int32)

        return by_rows(batches, of_rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def good(docs: DataFrame, model: Trees, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs, with all columns, whose score is at least `keep`; one pass, no shuffle."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        worker_takes("quality", int)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(shared.value.score(statistics(texts)) >= keep))

    return docs.mapInArrow(run, docs.schema)
