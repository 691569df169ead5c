"""Each operator against brute force, a round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import common, decontam, html_wrapper, neardup, order_minhash, pii, piece_codec, quality, secret_scan, token_count, training_order
from parchment.llm import queries as Q
from parchment.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (4, "one"), (None, "no id"), (5, "zwei Wörter\n\nmit 😀 Zeichen"), (6, "a b c d e f g h i j " * 3000), (7, "\x00\x07   x"), (8, "▁mark ▁"), (9, "<|endoftext|> x")]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
joined = lambda spans: ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(spans))


def odd(spark):
    """Nulls, empty, repeated and very long texts, and columns whose names clash with those made inside."""
    rows = spark.createDataFrame(ODD, FIELDS)
    return rows.select("doc_id", "text", F.lit("x").alias("id"), F.lit("y").alias("spans"), F.lit(1).alias("label"), F.lit("z").alias("__text"))


def empty(spark):
    return spark.createDataFrame([], FIELDS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# ---- 2 and 8 -------------------------------------------------------------------------------------------------------
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
SECRETS = ["API_KEY = 'abcdef1'", "token:abc", "Secret=\"x.y-z+9/\"", "AKIA" + "Q7" * 8, "AKIA" + "Q" * 15, "xAKIAAKIA" + "Z" * 16, "deadbeef" * 3, "deadbee" * 3, "apikey==abcdefg", "password  :  hunter22", "passwd=passwd=abcdef"]
PERSONAL = ["a@b.c@d.e", "x._%+-@y-z.co.uk_q@r.s", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4 1 1 1", "+49 (30) 1234-5678.", "+1 2", "+12345678901234567", "é@é.é", "9" * 400, "DE89 3704 0044 0532 0130 00"]


def base_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("module,base,samples", [(secret_scan, base_secrets, SECRETS), (pii, base_personal, PERSONAL)], ids=["secrets", "pii"])
def test_spans_are_those_of_python(spark, module, base, samples):
    r = random.Random(5)
    mixed = [(1000 + i, " ".join(r.choices([*samples, "wort", "ñ", "=", "😀"], k=12)) if i % 2 else "".join(r.choices([*samples, " ", ":", "x"], k=6))) for i in range(300)]
    docs = odd(spark).select("doc_id", "text").unionByName(spark.createDataFrame(mixed, FIELDS)).unionByName(documents(spark).select("doc_id", "text"))
    find = secret_scan.find_secrets if module is secret_scan else pii.find_pii
    got = find(docs)
    want = Counter((i, sha(joined(base(t or "")))) for i, t in docs.collect())
    rows = module.digest(got).collect()
    assert Counter((x.doc_id, x.base_sha256) for x in rows) == want
    kinds = list(module.PATTERNS)[:3] if module is secret_scan else list(pii.BASE)
    for x in rows:  # the method adds spans and takes none away
        own = [s for s in x.spans.split(",") if s.split(":")[0] in kinds]
        assert sha(",".join(own)) == x.base_sha256
    assert find(empty(spark)).count() == 0


def test_spans_of_long_texts_with_very_many(spark):
    rows = [(1, "".join(f"😀 write to user{i}@mail{i % 7}.example.org from 10.0.{i % 256}.{i % 250} or token={i:08d}\n" for i in range(20_000))), (2, "x" * 4094 + " a@b.cc " + "y" * 100), (3, "é" * 4095 + " 123-45-6789 ssn")]
    docs = spark.createDataFrame(rows, FIELDS)
    for module, base, find in ((pii, base_personal, pii.find_pii), (secret_scan, base_secrets, secret_scan.find_secrets)):
        assert {x.doc_id: x.base_sha256 for x in module.digest(find(docs)).collect()} == {i: sha(joined(base(t))) for i, t in rows}
    scores = {(x.doc_id, s.kind): round(s.score, 6) for x in pii.find_pii(docs.where("doc_id > 1")).collect() for s in x.spans}
    assert scores == {(2, "email"): 0.9, (3, "ssn"): 0.6}


def test_random_strings_are_found_and_words_are_not(spark):
    r = random.Random(1)
    alphabet = secret_scan.ALPHABETS["alnum"]
    key = "".join(r.choices(alphabet, k=48))
    docs = spark.createDataFrame([(1, f"key {key} here"), (2, "Donaudampfschifffahrtsgesellschaftskapitaen and " + "xy" * 30), (3, "internationalization_of_everything_possible")], FIELDS)
    got = {x.doc_id: [s.match for s in x.spans] for x in secret_scan.find_secrets(docs).collect()}
    assert got == {1: [key], 2: [], 3: []}


def test_random_keys_of_every_encoding_are_found(spark):
    rng = random.Random(5)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexa = "0123456789abcdef"
    cased = lambda s: "".join(rng.choice((c, c.upper())) for c in s)
    dashed = lambda s, cuts: "-".join(s[a:b] for a, b in zip((0, *cuts), (*cuts, len(s))))
    makers = {f"{name} {n}": (lambda f=f, n=n: f(n)) for n in (20, 32, 40, 64, 128) for name, f in {
        "upper hex": lambda n: key(hexa.upper(), n),
        "mixed hex": lambda n: cased(key(hexa, n)),
        "base36": lambda n: key("abcdefghijklmnopqrstuvwxyz0123456789", n),
    }.items()}
    makers |= {"uuid": lambda: dashed(key(hexa, 32), (8, 12, 16, 20)), "UUID": lambda: dashed(key(hexa, 32).upper(), (8, 12, 16, 20)), "dashed 64": lambda: dashed(key(hexa, 64), range(8, 64, 8))}
    kinds = list(makers)
    rows = [(i, f"see {makers[kinds[i % len(kinds)]]()} here") for i in range(100 * len(kinds))]
    found = Counter()
    for x in secret_scan.find_secrets(spark.createDataFrame(rows, FIELDS)).collect():
        found[kinds[x.doc_id % len(kinds)]] += [s.match for s in x.spans] == [rows[x.doc_id][1][4:-5]]
    assert min(found[k] for k in kinds) >= 88, found
    plain = ["donaudampfschifffahrtsgesellschaft", "pneumonoultramicroscopicsilicovolcanoconiosis2", "2024-11-25-23-59-59-dec-12", "1234-5678-9012-3456-7890", "face-bead-cafe-dead-beef", "one-of-the-long-page-names-2", "-" * 40 + "a1b2", "ab-" * 40_000 + "1"]
    assert not any(x.spans for x in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(plain)), FIELDS)).collect())


def scored_run(run):
    """(encoding, n, misfit, bits) of a run from the definitions: math.erfc for the normal, counts of every character."""
    import math

    bare = run.rstrip("=")
    name = next((n for n, rx in secret_scan.FITS if re.search(rx.replace("++", "+").replace("*+", "*"), bare)), "base64")
    body, alphabet = (bare.replace("-", "").lower() if name in ("hex_mixed", "hex_dashed") else bare), secret_scan.ALPHABETS[name]
    n, k, x = len(body), len(alphabet), [alphabet.index(c) for c in body]
    log_p = lambda z: -math.log2(p) if (p := math.erfc(abs(z) / math.sqrt(2))) > 1e-300 else z * z / 2 * math.log2(math.e) + math.log2(abs(z) * math.sqrt(math.pi / 2))
    chi = sum((body.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    worst = [log_p(z) + 1 if z > 0 else 0]
    sides = [2 * v >= k for v in x]
    n1, n0, runs = sum(sides), n - sum(sides), 1 + sum(a != b for a, b in zip(sides, sides[1:]))
    mean = 2 * n1 * n0 / n + 1
    worst.append(log_p((runs - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1))) if n1 and n0 else math.sqrt(n)))
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    worst.append(log_p((sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n) if var > 1e-9 else math.sqrt(n)))
    return name, n, max(0, max(worst) - math.log2(3)), sum(secret_scan._surprise()[c] for c in body) - n * math.log2(k)


def test_battery_and_false_discovery_control_are_those_of_the_definitions(spark):
    import math

    r = random.Random(11)
    letters = "".join(c * n for c, n in secret_scan.LETTERS.items())
    runs = ["".join(r.choices(a, k=n)) for a in secret_scan.ALPHABETS.values() for n in (20, 33, 90)] + ["".join(r.choices(letters, k=n)) for n in (20, 40, 80)] + ["xy" * 30, "a1" * 12, "Q" * 25, "0123456789abcdef" * 3, "zyxwvutsrqponmlkjihgf1"]
    got = [x.b for x in spark.createDataFrame(list(enumerate(runs)), FIELDS).select("doc_id", secret_scan.battery(F.col("text")).alias("b")).orderBy("doc_id").collect()]
    for run, b in zip(runs, got):
        name, n, misfit, bits = scored_run(run)
        assert (b.encoding, b.n) == (name, n) and abs(b.bits - bits) < 1e-6 and abs(b.misfit - misfit) < 0.1 + 0.01 * misfit, run
    docs = [(i, " . ".join(r.choices(runs, k=r.randint(1, 8)))) for i in range(80)]
    want = {}
    for i, text in docs:
        spans = [m for m in re.finditer(secret_scan.RUN, text) if not any(a < m.end() and m.start() < e for a, _, e, _ in base_secrets(text))]
        order = sorted((x[3] - x[2], m.start()) for m in spans if (x := scored_run(m[0]))[2] <= math.log2(1000))[::-1]
        last = max([j for j, (e, _) in enumerate(order) if e >= math.log2(len(spans) / (0.001 * (j + 1)))], default=-1)
        want[i] = {at for _, at in order[: last + 1]}
    found = {x.doc_id: {s.start for s in x.spans if s.kind == "random"} for x in secret_scan.find_secrets(spark.createDataFrame(docs, FIELDS)).collect()}
    assert found == want and any(want.values()) and any(len(w) < 3 for w in want.values())


def test_redaction_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x password: hunter22 y", 22, "s"), (2, None, None, "s")], "doc_id long, text string, n_chars long, __row string")
    out = secret_scan.redact_secrets(docs)
    assert out.schema.names == docs.schema.names and [tuple(x) for x in out.orderBy("doc_id").collect()] == [(1, "x [SECRET] y", 12, "s"), (2, None, None, "s")]


def test_checksums_and_context(spark):
    found = {x.doc_id: [s.kind for s in x.spans] for x in pii.find_pii(spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00"), (2, "DE88 3704 0044 0532 0130 00"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")], FIELDS)).collect()}
    assert "iban" in found[1] and "iban" not in found[2] and "ssn" in found[3] and "ssn" not in found[4]


# ---- 3, 7 and 1 ----------------------------------------------------------------------------------------------------
def test_counts_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    docs = documents(spark).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    tok = Tokenizer.from_file(tokenizer_path(token_count.VOCABULARY))
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in docs.collect())
    rows = token_count.count_tokens(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want and all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_count.count_tokens(empty(spark)).count() == 0


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    docs = documents(spark).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_codec.MODEL))
    want = Counter((i, tuple(ids := sp.encode(t or "")), sp.decode(ids)) for i, t in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in piece_codec.encode_pieces(docs).collect()) == want
    assert piece_codec.encode_pieces(empty(spark)).count() == 0


def thue_morse():
    """Pairs of texts whose words of 1,024 letters have the same polynomial hash by 2**64, whatever its base."""
    s = "a"
    while len(s) < 1024:
        s += s.translate(str.maketrans("ab", "ba"))
    return [f"{before}{x}{after}" for before, after in (("w ", ""), ("", " w"), ("", " a b c d e f g h i j k l")) for x in (s, s.translate(str.maketrans("ab", "ba")))]


def test_words_are_looked_up_by_their_bytes():
    encoder = training_order.Encoder(tokenizer_path(token_count.VOCABULARY))
    r = random.Random(7)
    words = ["".join(r.choices("aé\x00\n😀Z9.", k=r.randint(1, 24))) for _ in range(3000)] + ["a", "a\0", "a\0\0", "x" * 16, "x" * 17, "y" * 5000, *thue_morse()[0].split()]
    encoder.POOL = 9_000  # so that it is emptied often
    encoder.clear()
    for _ in range(60):
        texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(20)]
        got = encoder.batch(texts)
        assert [x.tolist() for x in got] == [encoder.enc.encode_ordinary(t) for t in texts] and encoder.counts(texts) == [*map(len, got)]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = training_order.Feistel(n, "key")
    slots = f(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.inverse(slots) == np.arange(n)).all()


def test_shards_hold_every_sequence_once(spark, tmp_path):
    from tokenizers import Tokenizer

    alike = spark.createDataFrame([(100 + i, t) for i, t in enumerate(thue_morse())], FIELDS)
    docs = odd(spark).where("text not like '%endoftext%' or text is null").unionByName(documents(spark).unionByName(alike, True), True)
    tok = Tokenizer.from_file(tokenizer_path(token_count.VOCABULARY))
    want = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.update((i, k, tuple(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64)))
    shards = training_order.write_shards(docs, f"file://{tmp_path}/shards", length=64, records=100)
    rows = training_order.read_index(spark, shards).collect()
    assert Counter((r.doc_id, r.seq_no, tuple(r.ids)) for r in rows) == want
    assert {r.ids_sha256 for r in rows} == {hashlib.sha256(np.array(ids, "<u2").tobytes()).hexdigest() for _, _, ids in want}
    assert sorted(r.slot for r in rows) == list(range(shards.n)) and all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * shards.stride for r in rows)
    assert training_order.training_order(empty(spark)).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------------------------
def components(rows, k):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    own = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and own[i] != own[j]:
                own = [own[i] if x == own[j] else x for x in own]
    least = {}
    for (i, _), x in zip(rows, own):
        least[x] = min(i, least.get(x, i))
    return {i: (len(s), least[x]) for (i, _), s, x in zip(rows, sets, own)}


def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)  # so that small groups already need several blocks
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(neardup, "hot_join", lambda *a: common.hot_join(*a, most=20))  # so that some keys are hot
    r = random.Random(2)
    made, words = [], [f"w{i}" for i in range(300)]
    for g in range(12):  # chains: neighbours are near, ends are not
        text = r.choices(words, k=60)
        for _ in range(15):
            for _ in range(r.randint(0, 2)):
                text[r.randrange(60)] = r.choice(words)
            made.append((5000 - len(made), " ".join(text)))
    rows = [*made, *[(i, t) for i, t in texts_of(documents(spark)).items()], (9001, None), (9002, ""), (9003, "A b"), (9004, "a B"), (9005, "a b c"), *enumerate(thue_morse(), 9100)]
    want = components(rows, 4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, FIELDS), words=4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_rows_of_one_id_and_without_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "z")
    rows = [(7, a), (7, b), (7, b), (9, near), (8, b), (None, a), (None, a), (3, c), (5, ""), (5, None), (5, "  ")]
    got = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(rows, FIELDS)).collect())
    assert got == Counter([(7, 36, 7, True)] * 3 + [(9, 36, 7, False), (8, 36, 7, False), (None, 36, None, True), (None, 36, None, True), (3, 36, 3, True)] + [(5, 0, 5, True)] * 3)
    kept = neardup.one_of_each_group(spark.createDataFrame(rows, FIELDS)).collect()
    assert Counter(map(tuple, kept)) == Counter([(7, a), (7, b), (None, a), (None, a), (3, c), (5, ""), (5, None), (5, "  ")])


def test_hashes_of_words_tell_words_apart():
    words = ["a", "a\0", "ab", "b" * 8, "b" * 9, "b" * 256, "b" * 257, "b" * 5000, "b" * 5001, "é", *thue_morse()]
    texts = sorted({w for t in words for w in t.split()})
    apart = [int(h[0]) for h in neardup.word_hashes(texts)]
    assert len({*apart}) == len(texts)
    assert np.concatenate(neardup.word_hashes([" ".join(texts).upper().replace("É", "é")])).tolist() == apart


def test_near_duplicates_on_odd_tables(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) and [x.component_id for x in got if x.doc_id == 4] == [4, 4]
    kept = neardup.one_of_each_group(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 1
    assert neardup.near_duplicates(empty(spark)).count() == 0


# ---- 5 -------------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    got = Q.op5_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([(x.score >= 0.7) == (x.quality == 1) for x in got]) > 0.95 and all(x.predicted == (x.score >= 0.7) for x in got)


def test_quality_on_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(odd(spark), none)
    assert [round(x.score, 6) for x in quality.score(odd(spark), model).collect()] == [0.5] * len(ODD)
    one = quality.train(odd(spark), spark.createDataFrame([(1, 1), (5, None), (None, 1)], "doc_id long, quality int"))
    assert all(x.score > 0.7 for x in quality.score(odd(spark), one).collect())
    assert quality.good(odd(spark), one).columns == odd(spark).columns and quality.good(odd(spark), one).count() == len(ODD)
    assert quality.score(empty(spark), one).count() == 0


def test_sample_bounds_what_the_driver_gets(spark, monkeypatch):
    got = []
    monkeypatch.setattr(quality, "fit", lambda x, y: got.append((len(x), len(y))))
    rows = spark.range(300).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    quality.train(rows, spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int"), sample=20)
    assert got == [(20, 20)]


def test_flat_trees_are_those_of_plain_search():
    """Walks each row alone, and holds the first tree's root against a search over all features and thresholds."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(400, 5)), 1)
    y = ((x[:, 1] + x[:, 3] > 0.3) ^ (r.random(400) < 0.1)).astype(float)
    model = quality.fit(x, y, trees=6, depth=3, bins=400, least=10)
    for row in x[:60]:
        total = model.base
        for node in model.roots.tolist():
            while model.left[node] != node:
                node = int((model.left if row[model.feature[node]] <= model.threshold[node] else model.right)[node])
            total += model.value[node]
        assert abs(total - model.raw(row[None])[0]) < 1e-12
    g, h = y - y.mean(), y.mean() * (1 - y.mean())
    gain = lambda m: (g[m].sum() ** 2 / (h * m.sum() + 1) + g[~m].sum() ** 2 / (h * (~m).sum() + 1)) if 10 <= m.sum() <= 390 else -1
    best = max(gain(x[:, j] <= t) for j in range(5) for t in np.unique(x[:, j]))
    root = model.roots[0]
    assert abs(gain(x[:, model.feature[root]] <= model.threshold[root]) - best) < 1e-9


def test_flat_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((quality.fit(x, y).score(x) > 0.5) == y).mean() > 0.95


# ---- 6 -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 7, 100])
def test_edits_follow_the_next_document(spark, parts):
    docs = documents(spark).select("doc_id", "text")
    got = {x.doc_id: x for x in order_minhash.fingerprint_edits(docs.repartition(5), parts=parts).collect()}
    rows = sorted(texts_of(docs).items())
    for (i, t), (_, u) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(t[: len(t) - half] + u[:half]))
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got.values())
    assert np.mean([x.near_edited for x in got.values()]) > 0.05 + np.mean([x.near_next for x in got.values()])


def test_likeness_follows_edits_and_order():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = r.choices(words, k=300)
    likeness = []
    for n in (0, 6, 30, 120):
        other = list(text)
        for i in r.sample(range(300), n):
            other[i] = r.choice(words)
        a, b = order_minhash.fingerprints([" ".join(text), " ".join(other)])
        likeness.append(order_minhash.likeness(a, b))
    assert likeness[0] == 1 and likeness == sorted(likeness, reverse=True)
    a, b = order_minhash.fingerprints([" ".join(text), " ".join(text[150:] + text[:150])])
    assert order_minhash.likeness(a, b) < 0.75  # plain MinHash would give nearly 1


def test_fingerprints_on_odd_tables(spark):
    got = order_minhash.fingerprint_edits(odd(spark)).collect()
    assert len(got) == len(ODD) and len({x.fingerprint for x in got if x.doc_id in (1, 2)}) == 1
    assert [x.near_next for x in order_minhash.fingerprint_edits(spark.createDataFrame([(1, "allein")], FIELDS)).collect()] == [1.0]
    assert len({order_minhash.shown(f) for f in order_minhash.fingerprints(thue_morse())}) == 6
    same = [(5, f"text {i % 7} of the same id") for i in range(300)] + [(None, "x y")] * 50 + [(6, "last one")]
    got = order_minhash.fingerprint_edits(spark.createDataFrame(same, FIELDS).repartition(6), parts=9).collect()
    text_of = lambda i, t: (i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t)
    rows = sorted(text_of(*x) for x in same)
    want = Counter((i if has else None, sha(order_minhash.edited(t, u[3]))) for (has, i, _, t), u in zip(rows, [*rows[1:], rows[0]]))
    assert Counter((x.doc_id, x.edited_sha256) for x in got) == want
    assert order_minhash.fingerprint_edits(empty(spark)).count() == 0


# ---- 9 -------------------------------------------------------------------------------------------------------------
def distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before), before.index(min(before))


def test_edit_matches_are_those_of_dynamic_programming(spark):
    r = random.Random(1)
    docs, items, want = [], [], set()
    for i in range(400):
        alphabet = "abc " if i % 2 else "ab"
        item = decontam.normal("".join(r.choices(alphabet, k=r.randint(24, 60))))
        text = list(item)
        for _ in range(r.randint(0, len(item) // 10 + 2)):
            at = r.randrange(len(text))
            text[at : at + 1] = [[], [r.choice(alphabet)], [text[at], r.choice(alphabet)]][r.randrange(3)]
        docs.append((i, "".join(r.choices(alphabet, k=r.randint(0, 40))) + "".join(text).upper() + "".join(r.choices(alphabet, k=20))))
        items.append((i, item))
    for i, text in docs[:60]:
        for j, item in items[:60]:
            best, end = distance(item, decontam.normal(text))
            if len(item) >= 20 and best <= int(len(item) * 0.1):
                want.add((i, j, best, end))
    got = decontam.contaminated(spark.createDataFrame(docs[:60], FIELDS), spark.createDataFrame(items[:60], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.distance, x.end) for x in got} == want and len(want) > 20
    for (_, text), (j, item) in zip(docs, items):
        best, end = distance(item, decontam.normal(text))
        assert decontam.Matcher([(j, item)], 0.1, 20).find(text) == ([(j, best, end, int(len(item) * 0.1))] if best <= int(len(item) * 0.1) and len(item) >= 20 else [])


def test_decontamination_on_odd_tables(spark):
    items = spark.createDataFrame([(1, None), (2, "kurz"), (3, "a b c d e f g h i j a b c"), (None, "a b c d e f g h i j a b c")], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontam.contaminated(odd(spark), items).collect()] == [(6, 3)]
    clean = decontam.without_contaminated(odd(spark), items)
    assert clean.columns == odd(spark).columns and clean.count() == len(ODD) - 1
    assert decontam.contaminated(empty(spark), items).count() == 0 and decontam.without_contaminated(odd(spark), items.limit(0)).count() == len(ODD)


def test_short_items_and_items_without_id(spark):
    docs = spark.createDataFrame([(1, "Who  wrote Faust? he"), (2, "xwho wrote faust?"), (3, "the long item without any id is here"), (4, "clean"), (5, "他说你好吗")], FIELDS)
    items = spark.createDataFrame([(1, "who wrote Faust?"), (2, "he"), (None, "long item without any id"), (3, " "), (4, "你好")], "item_id long, text string")
    assert {(x.doc_id, x.item_id, x.distance) for x in decontam.contaminated(docs, items).collect()} == {(1, 1, 0), (1, 2, 0), (5, 4, 0)}
    assert {x.doc_id for x in decontam.without_contaminated(docs, items).collect()} == {2, 4}


# ---- 10 ------------------------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>
  text.</p><p>Second&nbsp;one<div class="ad">Buy</div><aside>Side</aside><form>Mail</form><section class="comments"><p>Nice!</p></section></article><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_wrapper.main_text(PAGE) == "Head & more\n\nFirst bold text.\n\nSecond one"
    assert html_wrapper.main_text("") == "" and html_wrapper.main_text("<p>open <b>end") == "open end"


def test_wrappers_take_out_what_a_host_repeats(spark):
    page = lambda i: f"<html><body><div>Always the same line</div><div id=c><p>Text number {i} of this host.</p>" + f"<p>More {i}.</p>" * (1 + i % 3) + "</div></body></html>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(12)] + [(50, None, None), (51, "no url", "<p>x</p>"), (52, "http://h.example/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {x.page_id: x.text for x in html_wrapper.extract(pages).collect()}
    assert got[5].split("\n\n") == ["Text number 5 of this host.", "More 5.", "More 5.", "More 5."] and (got[50], got[51], got[52]) == ("", "x", "")
    assert html_wrapper.extract(pages.limit(0)).count() == 0


def texts_of_pages(spark, pages):
    rows = [(i, f"http://{h}.example/{i}", page) for i, (h, page) in enumerate(pages)]
    return [x.text for x in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).orderBy("page_id").collect()]


def test_only_what_differing_pages_share_is_fixed(spark):
    copies = [("a", "<div><h1>T</h1><p>one paragraph</p></div>")] * 4
    opening = [("b", f"<div class=m>Menu line</div><div><h1>H{i}</h1><div>{'same opening ' * 30}{i}</div></div>") for i in range(4)]
    once = [("c", f"<div class=m>Menu line</div><div><h1>H{i}</h1><p>Text {i}</p>{'<pre>only here</pre>' if i == 2 else ''}</div>") for i in range(4)]
    got = texts_of_pages(spark, copies + opening + once)
    assert got[:4] == ["T\n\none paragraph"] * 4
    assert got[4:8] == [f"H{i}\n\n{'same opening ' * 30}{i}" for i in range(4)]
    assert got[8:] == [f"H{i}\n\nText {i}" + ("\n\nonly here" if i == 2 else "") for i in range(4)]


def test_unmarked_articles_keep_all_parts():
    body = "word " * 40
    assert html_wrapper.main_text(f"<div id=content><h1>Title</h1><div class=text><p>{body}</p></div></div>") == f"Title\n\n{body.strip()}"
    assert html_wrapper.main_text(f"<div><div><p>{body}</p></div><section><blockquote>{body[:100]}</blockquote></section></div>") == f"{body.strip()}\n\n{body[:100].strip()}"


@pytest.mark.parametrize("page", ['<body class="single-post has-sidebar"><article>{}</article></body>', '<body class="sidebar"><main id="toc">{}</main></body>', '<article class="post comments-open comments">{}</article>', '<div class="layout with-sidebar no-sidebar nav-fixed toc-enabled">{}</div>', '<div class="sidebar"><main>{}</main></div>', '<div class="widget"><article>{}</article></div>'])
def test_names_of_layouts_do_not_empty_pages(page):
    assert html_wrapper.main_text(page.format("<h1>T</h1><p>text</p><div class='site-footer'>x</div><div class='cookie-notice'>y</div>")) == "T\n\ntext"


def test_articles_in_comments_and_teasers_stay_out():
    assert html_wrapper.main_text("<article><p>text</p><article class=comment>no</article></article><div class='related-posts'><article>teaser</article></div>") == "text"


def test_what_a_host_repeats_goes_also_inside_articles(spark):
    page = lambda i: f"<body><div>Text 1</div><article><h1>H{i}</h1><div class=x1>Join our club</div><div class=x2><p>Text {i}</p></div></article></body>"
    assert texts_of_pages(spark, [("a", page(i)) for i in range(5)]) == [f"H{i}\n\nText {i}" for i in range(5)]


def test_fixed_texts_of_long_pages_and_long_keys():
    page = lambda i: "".join(f"<div class=k{i}-{j}>{i} {j}</div>" for j in range(4000)) + "<div class=end>The end</div>"
    wrapper = html_wrapper.align(html_wrapper.align(html_wrapper.shape(page(1)), html_wrapper.shape(page(2))), html_wrapper.shape(page(3)))
    assert html_wrapper.fixed_texts(wrapper) == {("div", "The end")} and len(wrapper) < 10
    long = html_wrapper.shape(f"<div class={'c' * 120}1>a</div><div class={'c' * 120}2>b</div>")
    assert html_wrapper.fixed_texts(long) == {("div", "a"), ("div", "b")}


def test_attributes_and_deep_pages(spark):
    assert html_wrapper.main_text("<p title=it's>Hello</p>") == "Hello"
    assert html_wrapper.main_text('<p title="never closed>Hello</p><p>more</p>') == "Hello\n\nmore"
    assert html_wrapper.main_text('<p title="a > b" data-x=\'<p>\'>Hello</p>') == "Hello"
    deep = lambda i: "<div>" * 900 + f"text {i}" + "</div>" * 900 + "<p>Same line</p>"
    assert texts_of_pages(spark, [("a", deep(i)) for i in range(4)]) == [f"text {i}" for i in range(4)]
    assert texts_of_pages(spark, [("a", "<div>" * 900 + f"<b>{i}</b>") for i in range(2)]) == ["0", "1"]
    long = "<ul>" + "".join(f"<li>item {i}</li><hr>" for i in range(5_000)) + "</ul>"
    assert texts_of_pages(spark, [("a", f"<h1>{i}</h1>{long}") for i in range(3)])[1].count("\n\n") in (0, 5_000)


def test_doubtful_names_inside_articles():
    page = "<article><h1>T</h1><section id=discussion><h2>Discussion</h2><p>a</p></section><div class='share of market'>b</div><div class=notice>no</div><div class='comments clearfix'>no</div><div id=responses>c</div><div class=share>no</div></article>"
    assert html_wrapper.main_text(page) == "T\n\nDiscussion\n\na\n\nb\n\nc"


def test_second_layout_of_a_host_and_repeated_rows(spark):
    one = lambda i: f"<body><div class=top>Our site</div><div class=story><h1>H{i}</h1><p>Text {i}.</p>{'<p>More.</p>' * (i % 3)}</div><div class=end>Write to us</div></body>"
    two = lambda i: f"<body><div class=top>Our site</div><table><tr><td>Cell {i}</td><td>Other {i}</td></tr></table><div class=end>Write to us</div></body>"
    pages = [("a", one(i)) for i in range(6)] + [("a", two(i)) for i in range(4)]
    want = ["\n\n".join([f"H{i}", f"Text {i}.", *["More."] * (i % 3)]) for i in range(6)] + [f"Cell {i}\n\nOther {i}" for i in range(4)]
    assert texts_of_pages(spark, pages) == want and texts_of_pages(spark, pages * 2) == want * 2


def places(page, above=()):
    """(path of tags with marks, text, number) of each text."""
    for node in page:
        if node[0] == "x":
            yield above, node[1], node[2]
        else:
            yield from places(node[3], (*above, node[1]))


def test_texts_of_the_site_are_those_of_all_pages():
    """On pages made from one template without repeated places: a text is the site's if it stands at its path on every page."""
    r = random.Random(3)
    for _ in range(60):
        tags, maker = ["div", "p", "section", "h2"], iter(range(10_000))

        def template(depth):
            return [(f"{r.choice(tags)} class=k{next(maker)}", r.choice(["fixed", "slot", "optional"]), f"t{next(maker)}", template(depth - 1) if depth else []) for _ in range(r.randint(1, 4))]

        def page(nodes, i):
            out = ""
            for tag, kind, text, inner in nodes:
                if kind == "optional" and (i + len(text)) % 2:
                    continue
                out += f"<{tag}>{text if kind != 'slot' else f'{text} {i}'}{page(inner, i)}</{tag.split()[0]}>"
            return out

        made = template(2)
        pages = [page(made, i) for i in range(5)]
        wrapper = None
        for x in pages:
            wrapper = html_wrapper.shape(x) if wrapper is None else html_wrapper.align(wrapper, html_wrapper.shape(x))
        everywhere = set.intersection(*({(a, t) for a, t, _ in places(html_wrapper.tree(x))} for x in pages))
        for x in pages:
            nodes = html_wrapper.tree(x)
            assert html_wrapper.texts_of_site(wrapper, nodes) == {n for a, t, n in places(nodes) if (a, t) in everywhere}


def test_articles_of_the_tables(spark):
    for x in Q.op10_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        import html as h

        body = re.search(r"<article>(.*?)(?:</article>|$)", x.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub("<[^>]+>", "", re.sub("<br>", " ", b)))).strip() for b in re.split(r"</?(?:h1|p)>", body)]
        assert x.text == "\n\n".join(filter(None, blocks)) and x.n_chars == len(x.text)


# ---- columns whose names clash -------------------------------------------------------------------------------------
def test_clashing_columns_change_nothing(spark):
    wide, bare = odd(spark), odd(spark).select("doc_id", "text")
    wide = wide.withColumns({"__row": F.lit("r"), "__spans": F.lit(1), "match": F.lit("m"), "n_bytes": F.lit(2), "ids": F.lit("i"), "html": F.lit("h")})
    digests = lambda df: [secret_scan.digest(secret_scan.find_secrets(df)), pii.digest(pii.find_pii(df)), token_count.count_tokens(df), piece_codec.with_digests(piece_codec.encode_pieces(df))]
    for a, b in zip(digests(wide), digests(bare)):
        assert a.columns == b.columns and Counter(map(str, a.collect())) == Counter(map(str, b.collect()))
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"<h1>t{i}</h1><p>same</p>", "x", "y") for i in (1, 1, 2, 3)], "page_id long, url string, html string, host string, __wrapper string")
    assert sorted((x.page_id, x.text) for x in html_wrapper.extract(pages).collect()) == [(1, "t1"), (1, "t1"), (2, "t2"), (3, "t3")]
