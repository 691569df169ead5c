from pyspark.sql import functions as F
import pytest

from parchment.functions import checks
from parchment.functions import spans as S
from parchment.functions import text as T
from parchment.operators import anonymise, chunking, evaluation, prompting


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("rule", anonymise.PATTERNS, ids=lambda r: r.name)
def test_patterns_find_their_examples(spark, rule):
    import dataclasses

    found = one(spark, anonymise.all_spans(F.lit(f"vor {rule.example} nach"), [dataclasses.replace(rule, active=True)]))
    assert [(s.start, s.text) for s in found] == [(4, rule.example)]


def test_checks(spark):
    assert one(spark, checks.ean13(F.lit("756.9217.0769.85"))) and not one(spark, checks.ean13(F.lit("756.9217.0769.84")))
    assert not one(spark, checks.ean13(F.lit("")))
    assert one(spark, checks.iban(F.lit("CH93 0076 2011 6238 5295 7"))) and not one(spark, checks.iban(F.lit("CH93")))
    assert one(spark, checks.lv95(F.lit("2'600'000.0, 1'200'000"))) and not one(spark, checks.lv95(F.lit("2100000 1200000")))
    assert one(spark, checks.lv03(F.lit("600'000 200'000"))) and not one(spark, checks.lv03(F.lit("600.000.1 200000")))


def test_sweep_keeps_the_earliest_then_the_longest(spark):
    made = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("rank"), F.lit("").alias("text")) for a, b, r in [(5, 9, 0), (0, 6, 1), (0, 3, 2), (6, 8, 3)]])
    assert [(s.start, s.end) for s in one(spark, S.sweep(made))] == [(0, 6), (6, 8)]


def test_clean_lines(spark):
    text = "Ge­halt\nSilben-\n  trennung\n\f\nInhalt ..... 3\nMS ID/Ver 1\n123\n1234\n8. Juni 2026\n© Amt Folie 3 x\nFolie 12\n© Die Firma AG\na   b\t\tc\n \f "
    assert one(spark, T.clean_lines(F.lit(text))) == ["Gehalt", "Silbentrennung", "\f", "1234", "a b c"]


def folded(spark, lines, **options):
    return one(spark, chunking.pack(F.array(*map(F.lit, lines)), **options))


def test_chunk_rules(spark):
    long = "x" * 760
    assert folded(spark, ["kurz"]) == []
    assert folded(spark, [long]) == [long]  # single lines are never cut
    assert folded(spark, ["a" * 400, "b" * 400]) == ["a" * 400, "b" * 400]
    assert folded(spark, ["a" * 499 + ".", "b" * 20]) == ["a" * 499 + ".", "b" * 20]
    assert folded(spark, ["2.1 Ein Titel", "der Text der Stelle"]) == ["2.1 Ein Titel: 2.1 Ein Titel der Text der Stelle"]
    assert folded(spark, ["## Ein Titel ##", "der Text der Stelle", "\f", "auf der Seite danach"]) == ["Ein Titel: Ein Titel der Text der Stelle", "auf der Seite danach"]
    assert folded(spark, ["2 R8 R2 AND 5", "und so weiter"]) == ["2 R8 R2 AND 5 und so weiter"]  # no lower-case letter: no heading


def test_tags_and_garbage(spark):
    assert one(spark, T.tags(F.lit("ZUSTÄNDIG binnen 5 Tagen, mindestens 3"), F.array(F.lit("Seed"), F.lit("FRIST")))) == ["frist", "schwellenwert", "zustaendigkeit", "seed"]
    assert one(spark, T.tags(F.lit("befristet"))) == []
    assert one(spark, T.is_garbage(*T.garbage_metrics(F.lit("/0 /1 /2 /3"))))
    assert not one(spark, T.is_garbage(*T.garbage_metrics(F.lit(""))))
    assert one(spark, T.is_garbage(*T.garbage_metrics(F.lit("Wort � Wort Wort Wort"))))


def test_gold_terms(spark):
    assert one(spark, T.gold_terms(F.lit("Die Frist (nicht mehr) beträgt 72 Stunden, d.h. '3' Tage. Frist!"))) == ["frist", "beträgt", "72", "stunden", "3", "tage"]


def test_titles_and_labels(spark):
    assert one(spark, T.title_of(F.lit("ar-D-3DD93401/1644"))) == ""
    assert one(spark, T.title_of(F.lit("Mein_Bericht-v20260101v01.pdf"))) == "Mein Bericht"
    assert one(spark, T.sender_label(F.lit("hans.muster@x.example"))) == "hans muster"
    assert one(spark, T.label(F.lit("a b/ü.-"))) == "a_b_ü.-"


def test_redaction_and_literals(spark):
    text = "Anna mailt an anna.b@x.example und Anna."
    spans = anonymise.absorb(F.lit(text), anonymise.spans(F.lit(text), anonymise.PATTERNS), F.array(F.lit("Anna"), F.lit("mailt an anna")))
    got = one(spark, spans)
    assert [(s.start, s.end) for s in got] == [(14, 30), (0, 4), (35, 39)]
    assert one(spark, anonymise.redact(F.lit(text), anonymise.PATTERNS)) == "Anna mailt an [MAIL] und Anna."


def test_term_rules(spark):
    rules = anonymise.rules_of_terms([("Rom", "wort", "[ORT]"), ("x.y", "teil", ""), (r"\d{3}", "regex", "[NR]"), ("(", "regex", "")])
    assert [r.replacement for r in rules] == ["[ORT]", "[BEGRIFF]", "[NR]"]
    assert one(spark, anonymise.redact(F.lit("rom Romy Rom, ax.yb 123"), rules)) == "[ORT] Romy [ORT], a[BEGRIFF]b [NR]"


def test_windows_cover_the_text(spark):
    text = "Ein Satz mit Wörtern. " * 300
    rows = anonymise.windows(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("idx").collect()
    assert {r.doc_id for r in rows} == {1} and all(text[r.start : r.start + len(r.text)] == r.text for r in rows)
    assert rows[0].start == 0 and rows[-1].start + len(rows[-1].text) == len(text)
    assert all(b.start <= a.start + len(a.text) for a, b in zip(rows, rows[1:]))


def test_messages_and_variants(spark):
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    got = one(spark, prompting.messages(F.lit("sys"), history, F.lit("wann?"), F.lit("[a]\nb")))
    assert [(m.role, m.content) for m in got] == [("system", "sys"), ("user", "hi"), ("user", "Dokumente:\n\n[a]\nb\n\n---\nFrage: wann?")]
    assert one(spark, prompting.clean_answer(F.lit("half a thought"), thinking=True)) == ""
    assert one(spark, prompting.embedding_text(F.lit("  "))) is None


def test_hits_of_rules_models_and_hands(spark, tmp_path):
    text = F.lit("Max Muster, max@x.ch, Bern und Bern")
    known = anonymise.hits(text, anonymise.PATTERNS)
    known = anonymise.add_terms(text, known, F.array(F.lit("Max"), F.lit("max"), F.lit("Bern")))
    known = anonymise.mark(text, known, F.lit(3), F.lit(10), F.lit("[X]"))
    known = anonymise.mark(text, known, F.lit(9), F.lit(14), F.lit("[Y]"))  # overlaps, so it is refused
    rows = spark.range(1).select(F.lit("a.b.docx").alias("name"), known.alias("hits"), anonymise.applied(text, known).alias("text"))
    row = rows.first()
    assert row.text == "[NAME] [X], [MAIL], [NAME] und [NAME]" and {(h.start, h.origin) for h in row.hits} == {(0, "llm"), (4, "manuell"), (12, "muster"), (22, "llm"), (31, "llm")}
    anonymise.write_redacted(rows, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/document=a.b_anon.txt").collect()] == [row.text]
    got = anonymise.report(spark.createDataFrame([(1, "x@y.ch\r\n" + "Satz eins. " * 300), (2, None)], "doc_id long, text string"), anonymise.PATTERNS, ["w"]).orderBy("doc_id").collect()
    assert (got[0].n_hits, got[0].rules_active, got[0].warnings, got[1].characters, got[1].n_hits) == (1, 10, ["w"], 0, 0)
    assert got[0].windows[0].start == 0 and all(w.text.endswith(".") for w in got[0].windows[:-1]) and len(got[0].windows) > 2


def test_window_bounds_are_those_of_plain_search():
    import random

    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices([". ", "\n", "ab", ".", " "], k=r.randint(0, 60)))
        size, overlap = r.randint(8, 30), r.randint(0, 5)
        want, at = [], 0
        while at < len(text):
            end = min(at + size, len(text))
            if end < len(text):
                cut = max(text.rfind(m, at + size // 2, end) for m in (". ", "\n"))
                end = cut + 1 if cut > at else end
            want.append((at, end))
            if end == len(text):
                break
            at = max(end - overlap, at + 1)
        assert anonymise.window_bounds(text, size, overlap) == want, (text, size, overlap)


def test_runs_are_exported_and_compared(spark, tmp_path):
    questions = spark.createDataFrame([(i, f"q{i}", f"s{i % 2}") for i in range(4)], "qid int, question string, sheet string")
    fields = "qid int, coverage double, hit boolean, first_rank long, terms long"
    run = lambda hits: spark.createDataFrame([(i, 0.5, i in hits, 1, 3) for i in range(4)], fields)
    for at, hits in (("1", {0, 1}), ("2", {0}), ("3", {0, 2, 1, 3})):
        evaluation.export(run(hits), questions, f"file://{tmp_path}", "my run/1", at)
    got = [tuple(r) for r in evaluation.compare_last(spark, f"file://{tmp_path}").collect()]
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [("s0", 0.5, 1.0, 0.5), ("s1", 0.0, 1.0, 1.0)] and (tmp_path / "eval_3_my_run_1" / "details").exists()
    assert [r.qid for r in evaluation.pick(questions, "s1", 1).collect()] == [1] and evaluation.pick(questions).count() == 4
    found = spark.createDataFrame([(1, r, f"d{r}") for r in (4, 2, 1, 3)], "qid int, rank int, source string")
    assert [tuple(r) for r in evaluation.top_sources(found).collect()] == [(1, "d1", ["d1", "d2", "d3"])]


def test_models_and_their_parts(spark):
    names = spark.createDataFrame([("Llama",), ("bge-m3",), ("multilingual-e5-large",), ("Gemma",)], "name string")
    assert [r.name for r in prompting.writers(names).collect()] == ["Gemma", "Llama"]
    big = 200 * 1024 * 1024
    rows = [("split", "decoder", "q4", big, 1), ("split", "embedder", "q4", 900 * big, 1), ("split", "embedder", "int8", 5, 1), ("broken", "decoder", "q4", big, 1), ("plain", "whole", "q4", 7, 1), ("plain", "whole", "int8", big, 1), ("none", "whole", "q4", 7, 1)]
    got = prompting.choose_split(spark.createDataFrame(rows, "m string, part string, dtype string, total long, largest long"), "m", "part", ["q4", "int8"], 2 * big, 10).collect()
    assert {r.m: (r.decoder, r.embedder, r.dtype, r.total, r.complete) for r in got} == {"split": ("q4", "int8", None, big + 5, True), "broken": ("q4", None, None, None, False), "plain": (None, None, "int8", big, True), "none": (None, None, None, None, False)}


def test_larger_chunks_with_their_source(spark):
    text = "1 Einleitung\n" + "Ein Satz der Einleitung steht hier.\n" * 40 + "MS ID/Ver 1\n12\n2.1 Zweiter Teil\nKurzer Text des zweiten Teils ist dies hier.\n"
    got = [r.text for r in chunking.sized_chunks(spark.createDataFrame([(1, text, "doc")], "doc_id long, text string, source string")).orderBy("ord").collect()]
    assert got[0].startswith("[doc | 1 Einleitung] 1 Einleitung Ein Satz") and len(got[0]) >= 1100 and got[-1] == "[doc | 2.1 Zweiter Teil] 2.1 Zweiter Teil Kurzer Text des zweiten Teils ist dies hier."


def test_spans_of_texts_that_hold_the_marks(spark):
    texts = ["ab 12 ﷐ 34 x", "12﷑", "", "no digits", "1😀22"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.pattern_spans(F.col("t"), r"\d+", 3).alias("s")).orderBy("i").collect()
    assert [[(s.start, s.end, s.text) for s in r.s] for r in rows] == [[(3, 5, "12"), (8, 10, "34")], [(0, 2, "12")], [], [], [(0, 1, "1"), (2, 4, "22")]]
