"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles, as 64-bit hashes. Fast similarity sketching fills `coordinates` bins in
rounds: round i hashes every shingle to one bin with value i plus a fraction; each bin keeps its least value; rounds from
`coordinates` on send all shingles to one bin each, so after twice as many rounds every bin is filled, and the share of
equal bins of two sketches is concentrated around their similarity as if bins were independent. Bands of `rows` bins
propose: two documents are candidates if a band agrees. With 252 bins in 42 bands of 6, a pair of similarity 0.8 is missed
with probability 3e-6, before the links it has through others.

Only what is linked counts, so no group is expanded into all pairs:
1. documents with equal sets are one class, found by a digest of the whole set; only one row of it goes on, under a number
   that follows the order of the least ids, so rows of one id with different texts stay apart;
2. each class is compared with one centre of each band it shares, and linked if the full sets are similar enough;
3. components so far; in a bucket whose members are still in several components, those outside its largest component are
   compared exactly with all of it, block by block, skipping what is linked by then. The largest component is not compared
   with itself, so rows grow with the bucket times the blocks of the few others. Tasks hold two blocks, bounded by shingles
   and by members, however large the bucket.
Steps 2 and 3 return verified links only; they compare the words themselves, not their hashes. Components come from
alternating large-star and small-star steps over stored tables. Joins on bands, centres, digests and hubs broadcast the few keys that
hold more than a thousandth of the rows and shuffle the rest. Tables that the result doesn't read are deleted before it is returned.

Defined results: null texts and texts without words have an empty set, size 0, and are linked with nothing; texts with
fewer words than a shingle are one shingle; repeated rows (same id) give a row each; rows of one id are linked by their
texts like any others, and component_id is the least id of the component; other columns are left out; a null id is kept,
never linked, and its component_id is null; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows, forget, hot_join, id_and_text, stored, worker_takes

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Members of a block of step 2, which are compared with one centre.
BLOCK = 128
#: Shingles of a block of either step; a task of step 3 holds two blocks: 4 MB each with their texts.
BLOCK_SHINGLES = 150_000
#: So many candidates, about 100 bytes each, are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 250_000
#: Bytes of a word that are hashed as numbers; of longer ones a digest is.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's words: A-Z in lower case, cut at ASCII white space.

    A word is read as numbers of 8 bytes, each mixed into the hash of those before it, for all words of a buffer at once.
    """
    out: list[np.ndarray] = []
    part, size = [], 0
    for t in texts:
        raw = t.encode().lower()  # of bytes: lower() knows ASCII only
        part.append(raw)
        size += len(raw) + 1
        if size > 1_000_000:
            out += _hashes_of(part)
            part, size = [], 0
    return out + _hashes_of(part)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes_of(raws: list[bytes]) -> list[np.ndarray]:
    from hashlib import blake2b

    if not raws:
        return []
    whole = b" " + b" ".join(raws) + b" " + bytes(8)
    buffer = np.frombuffer(whole, np.uint8)
    blank = (buffer[:-8] == 32) | ((buffer[:-8] >= 9) & (buffer[:-8] <= 13))
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    at, ends = turns[::2], turns[1::2]
    eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))  # the 8 bytes from each place on
    left = ends - at
    h = mix(left.astype(np.uint64) * _P1 + _P2)
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        h[i] ^= np.uint64(int.from_bytes(blake2b(whole[at[i] : ends[i]], digest_size=8).digest(), "little"))
    left = np.where(left > LONG_WORD, 0, left)
    h = mix((h ^ (eights[at] & _MASKS[np.minimum(left, 8)])) * _P1)
    open_ = np.flatnonzero(left > 8)
    for k in range(8, LONG_WORD, 8):
        if not len(open_):
            break
        h[open_] = mix((h[open_] ^ (eights[at[open_] + k] & _MASKS[np.minimum(left[open_] - k, 8)])) * _P1)
        open_ = open_[left[open_] > k + 8]
    starts = np.cumsum([1, *(len(r) + 1 for r in raws)])
    return np.split(h, np.searchsorted(at, starts[1:-1]))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for h in word_hashes(texts):
        n = len(h)
        if not n:
            out.append(h)
            continue
        k = min(words, n)
        s = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            s = mix(s * _P1 + h[j : n - k + 1 + j])
        out.append(np.unique(s))
    return out


def exact_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Distinct shingles of each text as numbers that are equal where the words are, within these texts. Words are numbered, then
    pairs of a number and the next word, and so on, so nothing rests on a hash."""
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in t.encode().lower().split()], np.int64) for t in texts]
    whole: dict[tuple, int] = {}  # texts of fewer words than a shingle
    out: list = [None] * len(rows)
    for i, r in enumerate(rows):
        if len(r) < words:
            out[i] = np.array([-1 - whole.setdefault(tuple(r.tolist()), len(whole))] if len(r) else [], np.int64)
    full = [i for i, r in enumerate(rows) if len(r) >= words]
    if not full:
        return out
    sizes = np.array([len(rows[i]) for i in full])
    x = flat = np.concatenate([rows[i] for i in full])
    ends = np.cumsum(sizes)
    for k in range(1, words):
        after = np.append(flat[k:], np.zeros(k, np.int64))
        x = np.unique(x * np.int64(len(number)) + after, return_inverse=True)[1]
    for i, a, e in zip(full, ends - sizes, ends):
        out[i] = np.unique(x[a : e - words + 1])
    return out


def sketches(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, a row each: 32 bits of the value that each bin keeps."""
    t = coordinates
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    best = np.full(len(sets) * t, np.iinfo(np.uint64).max)
    open_ = np.ones(len(sets), bool)
    for i in range(2 * t):
        v = mix(x + np.uint64((i + 1) * int(_P1) % 2**64))
        if i < t:
            at = owner * t + ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            at = owner * t + (i - t)
        low = np.uint64(i) << np.uint64(32) | v & np.uint64(0xFFFFFFFF)  # value: the round, then the fraction
        np.minimum.at(best, at, low)
        full = (best.reshape(-1, t) != np.iinfo(np.uint64).max).all(axis=1)
        if full.all():
            break
        if (full & open_).any():
            keep = ~full[owner]
            x, owner, open_ = x[keep], owner[keep], ~full
    return mix(best).astype(np.uint32).reshape(-1, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    n = sketch.shape[1] // rows
    cut = sketch[:, : n * rows].reshape(len(sketch), n, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64) + np.uint64(1), (len(sketch), n)).copy()
    for j in range(rows):
        key = mix(key * _P1 + cut[:, :, j])
    return key.view(np.int64)


def digest_of(s: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(s.tobytes(), digest_size=16).digest()


def sketch_table(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest, bands, text_md5) of each row; the last three are null where the set is empty."""
    from hashlib import md5

    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("text_md5", pa.string())])

    def run(batches):
        worker_takes("neardup", int)

        def of_rows(columns):
            sets = shingle_sets(columns[1], words)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            digests: list = [None] * len(sets)
            texts: list = [None] * len(sets)
            if some:
                for i, k in zip(some, bands(sketches([sets[i] for i in some], coordinates), rows)):
                    keys[i], digests[i], texts[i] = k, digest_of(sets[i]), md5(columns[1][i].encode()).hexdigest()
            return columns[0], [len(s) for s in sets], digests, pa.array(keys, pa.list_(pa.int64())), texts

        return by_rows(batches, of_rows, schema, 256)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_shingles long, digest binary, bands array<long>, text_md5 string")


def _verified(members: DataFrame, percent: int, words: int) -> DataFrame:
    """Verified links within bounded groups. members: (group, side, id, label, __text); side 0 against side 1 and, where
    the group is one block (no side 1), side 0 against itself. Equal labels are already linked and are skipped."""

    def compare(key, frame):
        import pandas as pd

        worker_takes("neardup", int)
        frame = frame.sort_values(["side", "id"])
        sets = exact_sets(frame["__text"].tolist(), words)
        ids, sides, label = frame["id"].to_numpy(), frame["side"].to_numpy(), frame["label"].to_numpy().copy()
        n, cut = len(sets), int(np.count_nonzero(sides == 0))
        # shingles as small numbers, so that a table of marks gives the size of an intersection
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sizes = np.array([*map(len, sets)])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        mark = np.zeros(int(numbers.max()) + 1, bool)
        links = []
        for i in range(cut):
            low = cut if cut < n else i + 1
            open_ = (label[low:] != label[i]) & (100 * np.minimum(sizes[low:], sizes[i]) >= percent * np.maximum(sizes[low:], sizes[i]))
            others = np.flatnonzero(open_) + low
            if not len(others):
                continue
            own = numbers[begins[i] : ends[i]]
            mark[own] = True
            if len(others) < 32:
                both = np.array([np.count_nonzero(mark[numbers[begins[j] : ends[j]]]) for j in others])
            else:
                both = np.add.reduceat(mark[numbers[begins[low] :]].astype(np.int64), begins[low:] - begins[low])[others - low]
            mark[own] = False
            for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return members.groupBy("group").applyInPandas(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each node's component, by alternating large-star and small-star. Each step is stored; of
    a node with very many neighbours the least one is broadcast."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n = now, max(1, now[0])
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, "a", "n", n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "a", "n", n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        following = stored(small, "links")
        forget(edges, large)
        edges = following
    heads = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(heads)


def _labels(links: DataFrame) -> DataFrame:
    """components(), stored."""
    found = components(links)
    out = stored(found, "labels")
    forget(found)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, coordinates: int = 252, rows: int = 6) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    table, _ = _linked(docs, id_col, text_col, percent, words, coordinates, rows)
    return table.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int, coordinates: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, digest, text_md5, component_id, first_md5) of every row, first_md5 being the text whose row stays for the
    component, and the table of classes."""
    table = stored(sketch_table(docs, id_col, text_col, words, coordinates, rows), "sketches")
    known = table.where("id is not null and digest is not null")
    n_rows = max(1, known.count())
    classes = known.groupBy("digest").agg(F.min(F.struct("id", "text_md5")).alias("first"), F.count("*").alias("n"))
    classes = classes.select("digest", F.col("first.id").alias("rep"), F.col("first.text_md5").alias("rep_md5"), "n")
    # a class's number follows the order of its least id; it is stored, so it stays what it is
    classes = stored(classes.repartitionByRange("rep", "digest").sortWithinPartitions("rep", "digest").withColumn("node", F.monotonically_increasing_id()), "classes")

    # one row of each class, found by id and text, which no class shares with another
    reps = known.select("id", "text_md5", "n_shingles", "bands").dropDuplicates(["id", "text_md5"])
    reps = reps.join(classes.select(F.col("rep").alias("id"), F.col("rep_md5").alias("text_md5"), "node"), ["id", "text_md5"])
    reps = stored(reps.select("node", "id", "text_md5", "n_shingles", "bands"), "reps")

    # buckets of at least two classes; the centre is the member of least hash, which is the same one in most of its bands
    exploded = reps.select(F.col("node").alias("id"), "n_shingles", F.explode("bands").alias("band"))
    rank = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
    buckets = exploded.groupBy("band").agg(F.min(rank).alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", F.col("centre.id").alias("centre"), "n")
    buckets = stored(buckets, "buckets")
    members = stored(hot_join(exploded, buckets, "band", "n", n_rows), "members")

    wanted = stored(reps.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "id", F.col("text_md5").alias("md5")), "wanted")
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = id_and_text(docs, id_col, text_col).join(some.withColumnRenamed("id", "__id"), "__id").where(F.md5(F.encode("__text", "UTF-8")) == F.col("md5"))
    texts = stored(texts.select(F.col("node").alias("id"), "__text").dropDuplicates(["id"]), "texts")

    # each class against its centres, in groups of one centre and a block of others
    pairs = stored(members.where("id <> centre").groupBy("centre", "id").agg(F.first("n_shingles").alias("w")), "pairs")
    blocks = pairs.groupBy("centre").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("w") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    blocks = stored(blocks, "blocks")
    dealt = hot_join(pairs, blocks, "centre", "n", n_rows).select("centre", "id", F.pmod(F.xxhash64("id", "centre"), "blocks").alias("block"))
    others = dealt.select(F.struct("centre", "block", F.lit(0).alias("with")).alias("group"), F.lit(1).alias("side"), "id", F.col("id").alias("label"))
    centres = blocks.select(F.col("centre").alias("id"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    centres = centres.select(F.struct(F.col("id").alias("centre"), "block", F.lit(0).alias("with")).alias("group"), F.lit(0).alias("side"), "id", F.col("id").alias("label"))
    links = stored(_verified(others.unionByName(centres).join(texts, "id"), percent, words), "links")
    labels = _labels(links)

    # buckets that are still in several components, each distinct set of members once
    labelled = members.drop("centre", "n").join(labels, "id", "left").select("band", "id", "n_shingles", F.coalesce("label", "id").alias("label"))
    several = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.count("*").alias("n"))
    several = several.where("low <> high and n > 2").groupBy("who", "n").agg(F.min("band").alias("band")).select("band", "n")
    several = stored(several, "several")
    rest = stored(hot_join(labelled, several, "band", "n", n_rows).drop("n"), "rest")
    weights = rest.groupBy("band", "label").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("n"))
    blocks_of = lambda w, n: F.greatest(F.ceil(w / BLOCK_SHINGLES), F.ceil(n / (8 * BLOCK))).cast("int")
    weights = weights.groupBy("band").agg(F.max(F.struct("w", "label", "n")).alias("top"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    weights = weights.select("band", "n", F.col("top.label").alias("top"), blocks_of(F.col("w") - F.col("top.w"), F.col("n") - F.col("top.n")).alias("few"), blocks_of(F.col("top.w"), F.col("top.n")).alias("many"))
    weights = stored(weights, "weights")
    placed = hot_join(rest, weights, "band", "n", n_rows)
    is_top = F.col("label") == F.col("top")
    block = F.when(is_top, F.col("few") + F.pmod(F.xxhash64("id"), "many")).otherwise(F.pmod(F.xxhash64("id"), "few")).cast("int")
    paired = placed.select("band", "id", "label", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("few") + F.when(is_top, 0).otherwise(F.col("many")) - 1)).alias("with"))
    paired = paired.select(F.struct("band", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")).alias("group"), F.when(F.col("block") <= F.col("with"), 0).otherwise(1).alias("side"), "id", "label")
    more = stored(_verified(paired.join(texts, "id"), percent, words), "links")
    if not more.isEmpty():
        old, labels = labels, _labels(links.unionByName(more))
        forget(old)

    # the least id of each component: that of its least class number; then back to all rows of each class
    placed = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("digest", "rep", "rep_md5", "n", F.coalesce("label", "node").alias("head"))
    heads = placed.groupBy("head").agg(F.min(F.struct("rep", "rep_md5")).alias("first"), F.count("*").alias("in"))
    found = stored(hot_join(placed.select("digest", "n", "head"), heads, "head", "in", n_rows).select("digest", "n", F.col("first.rep").alias("component_id"), F.col("first.rep_md5").alias("first_md5")), "found")
    all_rows = table.select("id", "n_shingles", "digest", "text_md5")
    linked = hot_join(all_rows.where("id is not null and digest is not null"), found, "digest", "n", n_rows).drop("n")
    alone = all_rows.where("id is null or digest is null").withColumns({"component_id": F.col("id"), "first_md5": F.col("text_md5")})
    forget(classes, reps, buckets, members, wanted, texts, pairs, blocks, links, labels, several, rest, weights, more)
    return linked.unionByName(alone), found


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, coordinates: int = 252, rows: int = 6) -> DataFrame:
    """The rows of docs, with all columns, that stay: of each component the row of least id and, of that id's texts, of least
    digest; of rows of that id and text, one. Rows of null ids and rows without words are in no group and stay, each of them."""
    table, _ = _linked(docs, id_col, text_col, percent, words, coordinates, rows)
    kept = table.where("id = component_id and text_md5 = first_md5").select(F.col("id").alias("__kept"), F.col("text_md5").alias("__kept_md5")).distinct()
    own = "__md5"
    while own in docs.columns:
        own += "_"
    md5 = F.md5(F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8"))
    has_words = F.coalesce(docs[text_col], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    in_groups = docs[id_col].isNotNull() & has_words
    rows_of = docs.where(in_groups).withColumn(own, md5)
    known = rows_of.join(kept, (rows_of[id_col].cast("long") == kept["__kept"]) & (rows_of[own] == kept["__kept_md5"]), "left_semi").dropDuplicates([id_col, own]).drop(own)
    return known.unionByName(docs.where(~in_groups))
