"""Queries against their SQL on tables of odd rows, and rewritten steps against plain ones."""

import duckdb
from pyspark.sql import functions as F

from parchment.catalog import ORACLES, QUERIES
from parchment.functions import spans as S
from parchment.functions import text as T
from parchment.functions.checks import CHECKS
from parchment.operators import anonymise, chunking, search
from parchment.operators import index as ix
from parchment.sources import pdf

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_blank_texts_have_the_length_of_the_bare_prefix(spark, tmp_path):
    texts = [None, "", " ", "\n\n", " ", " a ", "é" * 399 + "     z"]
    spark.createDataFrame([(i, t, "de", "src0", 0) for i, t in enumerate(texts)], DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["embedding_text"](spark, str(tmp_path)).select("doc_id", "query_text", "passage_length").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["embedding_text"]).fetchall())


SF = "/root/testdata/sf0.001"


def test_best_is_the_whole_ranking_without_a_row_for_each_text_and_term(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 3 + i % 9))) for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w0"), (3, "nowhere")], "qid long, question string")
    whole = ix.top(ix.bm25(ix.build(rows), asked), 7)
    got = ix.best(rows.repartition(5), asked, 7)
    key = lambda r: (r["qid"], r["rank"], r["id"], r["score"])
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))
    for name in ("bm25_topk", "golden_recall", "top_sources"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan, name


def test_search_with_an_index_is_search_without(spark):
    rows = spark.createDataFrame([(i, "s", f"w{i % 7} w{i % 5} w{i % 3}", [float(i % 11), 1.0], []) for i in range(80)], "id long, source string, text string, vec array<float>, tags array<string>")
    asked = [(1, "w1 w4", [1.0, 0.5]), (2, "source:s w2", None)]
    assert sorted(search.search(rows, asked, index=ix.build(rows)).collect()) == sorted(search.search(rows, asked).collect())


def test_search_with_a_table_of_vectors_is_search_of_chunks_that_have_them(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "s", f"w{i % 7} w{i % 5} w{i % 3}", i % 13 if i % 9 else None, []) for i in range(80)], "id long, source string, text string, vec_id long, tags array<string>")
    vectors = spark.createDataFrame([(i, [float(i % 11), 1.0] if i % 5 else None) for i in range(12)], "vec_id long, vec array<float>")
    asked = [(1, "w1 w4", [1.0, 0.5]), (2, "source:s w2 -w3", None), (3, "w0", [0.0, 1.0])]
    want = search.search(rows.join(vectors, "vec_id"), asked).collect()
    assert len(want) == 18 and sorted(search.search(rows, asked, vectors=vectors).collect()) == sorted(want)
    assert sorted(search.search(rows, asked, index=ix.build(rows), vectors=vectors).collect()) == sorted(search.search(rows.join(vectors, "vec_id"), asked, index=ix.build(rows)).collect())
    kept, stored = [], ix.stored
    monkeypatch.setattr(ix, "stored", lambda df, what: kept.append(df.columns) or stored(df, what))
    start = set(spark._jvm.java.io.File(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).list())
    assert QUERIES["search_topk"](spark, SF).count() == 42
    new = set(spark._jvm.java.io.File(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).list()) - start
    assert len(kept) == len(new) == 1 and "text" not in kept[0]  # the chunks' texts are not written


def test_evaluation_makes_no_index_of_all_terms(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("an index of all terms")

    monkeypatch.setattr(ix, "build", refused)
    assert QUERIES["eval_diff"](spark, SF).count() == 3


def _shuffled(spark) -> int:
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_are_counted_before_they_meet_vectors_that_are_too_many_to_broadcast(spark, tmp_path):
    import random

    r = random.Random(5)
    words = [f"{r.getrandbits(32):08x}" for _ in range(200_000)]
    texts = [None, "", *(" ".join(r.sample(words, 1500)) for _ in range(300))]
    spark.createDataFrame([(i, t, "de", f"src{i % 3}", 0) for i, t in enumerate(texts)], DOCUMENTS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(70)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, " ".join((texts[2 + i] or "").split()[:20])) for i in range(5)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("hybrid_topk", "coverage", "eval_by_sheet"):
            start, frame = _shuffled(spark), QUERIES[name](spark, str(tmp_path))
            got = sorted(map(tuple, frame.collect()))
            assert got == sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall()), name
            assert _shuffled(spark) - start < sum(len(t or "") for t in texts) / 3, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chunks_are_cut_in_one_scan_of_a_string(spark):
    text = "wort " * 400_000
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id long, text string")
    bare = text.strip()
    want = [w for i in range(0, len(bare), 270) if i < len(bare) - 80 and len(w := bare[i : i + 350].strip()) >= 20]
    assert [r.text for r in chunking.flat_chunks(rows).orderBy("ord").collect()] == want
    for name in ("chunk_tags", "filter_tags", "garbage_metrics", "garbage_by_source", "filter_exclude", "flat_chunks"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "aggregate(" not in plan, name


def test_tags_of_folded_case():
    assert T.tags_of("BİNNEN") == ["frist"] and T.tags_of("zwölf ſtunden") == ["frist"] and T.tags_of("3’000") == ["schwellenwert"] and T.tags_of("befristet") == []


def test_a_pdf_line_is_looked_up_at_once(monkeypatch):
    def refused(*_):
        raise AssertionError("glyph by glyph")

    monkeypatch.setattr(pdf.Font, "glyphs", refused)
    head = "%PDF-1.7\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]>> endobj 3 0 obj <</Contents 4 0 R/Resources<</Font<</A 5 0 R>>>>>> endobj\n"
    head += "5 0 obj <</Subtype/Type1/FirstChar 97/Widths[1000 0]/Encoding<</Differences[99/nothing]>>>> endobj 4 0 obj <<>> stream\nBT /A 10 Tf 50 700 Td "
    raw = head + "(aab) Tj 20 0 Td (a c) Tj 30 0 Td (d) Tj 10 0 Td (e) Tj ET\nendstream endobj trailer <</Root 1 0 R>>"
    assert pdf.pdf(raw.encode()) == "aaba  d e"


def test_spans_of_ascii_texts_are_found_in_one_pass(spark):
    texts = ["AHV 756.9217.0769.85, CH9300762011623852957 a@b.ch", "a@b.ch\x1c0581234567", "é a@b.ch 2600000.0 1200000.0", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    each = [S.pattern_spans(F.col("t"), r.pattern, i, CHECKS[r.check] if r.check else None) for i, r in enumerate(anonymise.PATTERNS) if r.active]
    both = rows.select("i", anonymise.all_spans(F.col("t"), anonymise.PATTERNS).alias("a"), F.concat(*each).alias("b"))
    assert all(r.a == r.b for r in both.collect())
    assert not any(anonymise.SAME_SYNTAX.fullmatch(rx) for rx in (r"\w", "a++", "(?<!a)b", r"\p{L}", "^a", "a$", "(?iu)a", "[a&&b]"))
    for name in ("redact", "scan_report", "spans_resolved"):
        assert "ArrowEvalPython" in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name
