import io
import zipfile

from pyspark.sql import functions as F

from parchment.operators import store as store_ops
from parchment.operators.store import Store
from parchment.sources import folder, office, plain
from parchment.streaming.ingest import answers, ingest

W, S, A, R = office.WORD_NS[1:-1], office.SHEET_NS[1:-1], office.DRAWING_NS[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def workbook(sheets):
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>",
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>Frage</t></si></sst>',
    }
    for i, rows in enumerate(sheets.values()):
        cells = lambda n, row: "".join(f'<c r="{"ABCDEF"[j]}{n}" t="s"><v>0</v></c>' if v == "Frage" else f'<c r="{"ABCDEF"[j]}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v)
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{S}"><sheetData>' + "".join(f"<row>{cells(n, row)}</row>" for n, row in enumerate(rows, 1)) + "</sheetData></worksheet>"
    return zipped(parts)


BOOK = workbook({"A": [["Frage", "Antwort", "Thema", "Quelle"], ["Was ist X?", "Ein Ding.", "", "Buch"], ["", "leer"], ["Wozu?", "Darum.", "Zweck"]], "_mess": [["q", "a"]], "_anon": [["Begriff", "Typ", "Ersatz"], ["Rom", "", "[ORT]"]]})


def test_office_formats():
    doc = f'<document xmlns="{W}"><body><p><r><t>Erste </t></r><r><t>Zeile</t></r></p><p/><tbl><tr><tc><p><r><t>a</t></r></p></tc><tc><p/></tc><tc><p><r><t>b</t></r></p></tc></tr></tbl></body></document>'
    assert office.docx(zipped({"word/document.xml": doc})) == "Erste Zeile\na | b"
    slide = lambda t: f'<sld xmlns="x" xmlns:a="{A}"><a:t>{t}</a:t></sld>'
    assert office.pptx(zipped({"ppt/slides/slide10.xml": slide("zehn"), "ppt/slides/slide2.xml": slide("zwei"), "ppt/slides/slide3.xml": "<broken"})) == "zwei\n\f\nzehn"
    assert [r for r in office.xlsx_rows(BOOK)][1] == ("A", 1, ["Was ist X?", "Ein Ding.", "", "Buch"])
    assert office.xlsx(BOOK).split("\n")[0] == "Frage | Antwort | Thema | Quelle"
    assert folder.glossary_text(BOOK) == "## X\nWas ist X? Ein Ding. (Quelle: Buch; Blatt: A)\n\f\n## Zweck\nWozu? Darum."


def test_plain_formats():
    assert plain.decoded("﻿grüß".encode()) == "grüß" and plain.decoded("grüß".encode("cp1252")) == "grüß" and plain.decoded(b"\x81x") == "\x81x"
    assert plain.delimited(b"a; b;;c\nd;e;f;g\nh;i;j;k\n;;;\n") == "a | b | c\nd | e | f | g\nh | i | j | k"
    assert plain.decode_words("x =?utf-8?B?R3LDvMOf?= =?iso-8859-1?Q?a_=FC?= =?nope?B?xx?=") == "x Grüß a ü =?nope?B?xx?="
    mail = b"From: Max Muster <m@x.example>\r\nTo: a@b.example\r\nSubject: Hallo\r\nContent-Type: text/html\r\n\r\n<p>Guten <b>Tag</b></p>"
    assert plain.mail(mail).split("\n")[:3] == ["## Mail von Max Muster", "From: Max Muster <m@x.example>", "To: a@b.example"] and "Guten  Tag" in plain.mail(mail)


def test_glossaries_lie_below_their_folder(spark):
    files = spark.createDataFrame([(p, "g.xlsx", bytearray(BOOK)) for p in ("file:/x/eval/g.xlsx", "/x//eval/deep/g.xlsx", "/y/x/eval/g.xlsx", "/x/eval2/g.xlsx", "/x/eval/../g.xlsx")], "path string, name string, content binary")
    assert [r.seed_tags for r in folder.extract(files, "file:///x/eval/").collect()] == [["glossar"], ["glossar"], [], [], []]


def test_senders_and_bodies():
    assert [*map(plain.sender, ['"Muster, Max" <m@x>', "Muster, Max <m@x>", "<a.b@x>", "=?utf-8?Q?J=C3=BCrg?= <j@x>", "max.m@x", "niemand", "", None])] == ["Muster, Max", "Muster, Max", "a b", "Jürg", "max m", "niemand", "", ""]
    parts = b"Content-Type: multipart/alternative; boundary=q\r\n\r\n--q\r\nContent-Type: text/html\r\n\r\n<b>no</b>\r\n--q\r\nContent-Type: text/plain\r\n\r\nplain text\r\n--q--\r\n"
    assert plain.mail(parts).strip() == "plain text"
    assert plain.delimited(b"x y z\nonly text\n") == "x y z\nonly text" and plain.delimited(b'a\t"b\tc"\nd\te\n') == "a | b\tc\nd | e"


def test_status_of_new_files(spark):
    fields = "source string, text string, error string, n_chunks int, bad int"
    new = spark.createDataFrame([("a", "x", None, 10, 4), ("b", "y", None, 40, 5), ("c", "z", None, 3, 0), ("d", None, "no", 0, 0)], fields)
    old = spark.createDataFrame([("c", "h"), ("b", "k"), ("b", "l")], "source string, doc_hash string")
    status = lambda **how: {r.source: r.status for r in store_ops.ingest_status(new, old, **how).collect()}
    assert status() == {"a": "OK, 10 chunks · check: 4/10 broken (40%)", "b": "OK, 40 chunks (version replaced, 2 old removed) · check: 5/40 broken (12%)", "c": "OK, 3 chunks (version replaced, 1 old removed)", "d": "error: no"}
    strict = status(skip_known=True, reject=True)
    assert strict["a"] == "rejected: 40% broken" and strict["b"] == strict["c"] == "already indexed"
    assert status(reject=True)["b"].startswith("OK, 35 chunks (version replaced, 2 old removed) (5 left out as broken)")


def test_vectors_as_bytes(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [])], "id long, vec array<float>")
    raw = rows.select("id", store_ops.float_bytes(F.col("vec")).alias("b"))
    assert {r.id: r.b and bytes(r.b) for r in raw.collect()} == {1: b"\x00\x00\x80?\x00\x00 \xc0", 2: None, 3: b""}
    assert [tuple(r) for r in raw.select("id", store_ops.float_array(F.col("b"))).orderBy("id").collect()] == [(1, [1.0, -2.5]), (2, None), (3, [])]


def test_folder_to_store(spark, tmp_path):
    files = tmp_path / "in"
    (files / "eval").mkdir(parents=True)
    (files / "a.txt").write_text("Der erste Text der Sammlung ist lang genug.\n")
    (files / "copy.txt").write_text("Der erste Text der Sammlung ist lang genug.\n")
    (files / "~$a.txt").write_text("gesperrt und nicht zu lesen")
    (files / "b.md").write_text("---\ntitle: Titel\ntags: [Eins, zwei]\n---\nEin Text mit Titel und Tags.\n")
    (files / "c.docx").write_bytes(b"no archive")
    (files / "d.pdf").write_bytes(b"%PDF")
    (files / "eval" / "g.xlsx").write_bytes(BOOK)
    texts = folder.extract(folder.read_folder(spark, str(files)), f"{files}/eval")
    errors = {r.name: r.error for r in texts.collect()}
    assert set(errors) == {"a.txt", "copy.txt", "b.md", "c.docx", "d.pdf", "g.xlsx"} and {k for k, v in errors.items() if v} == {"c.docx", "d.pdf"}
    store = Store(spark, str(tmp_path / "store"))
    store.add(folder.new_chunks(texts, store.read()))
    rows = {(r.source, r.ord): r for r in store.read().collect()}
    assert set(rows) == {("a.txt", 0), ("b.md", 0), ("g.xlsx", 0), ("g.xlsx", 1)}
    assert rows["b.md", 0].text == "Titel: Titel Ein Text mit Titel und Tags." and rows["b.md", 0].tags == ["eins", "zwei"]
    assert rows["g.xlsx", 0].tags == ["glossar"] and sorted(r.id for r in rows.values()) == [1, 2, 3, 4]
    assert folder.read_folder(spark, str(files), store.read()).count() == 3  # the names that the store has not
    store.put_vectors(spark.createDataFrame([(1, [3.0, 4.0]), (None, [1.0]), (2, [])], "id long, vector array<double>"))
    assert [[round(x, 6) for x in r.vec] for r in store.read().where("vec is not null").collect()] == [[0.6, 0.8]]
    store.add(spark.createDataFrame([("a.txt", 0, "neu", [], "h")], "source string, ord int, text string, tags array<string>, doc_hash string"))
    assert {(r.source, r.text) for r in store.read().where("source = 'a.txt'").collect()} == {("a.txt", "neu")}
    store.delete("g.xlsx")
    assert {r.source for r in store.read().collect()} == {"a.txt", "b.md"}
    store.reset()
    assert store.read().count() == 0


def test_ids_are_dense_whatever_the_plan(spark, tmp_path):
    rows = spark.range(40_000).select(F.concat(F.lit("s"), F.col("id") % 700).alias("source"), F.col("id").cast("int").alias("ord"), F.repeat(F.lit("wide text "), 40).alias("text"), F.array(F.lit("t")).alias("tags"), F.sha1(F.col("id").cast("string")).alias("doc_hash"))
    store = Store(spark, str(tmp_path / "store"))
    store.add(rows)
    got = store.read().select("id", "source", "ord").orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 40_001)) and got == sorted(got, key=lambda r: (r.source, r.ord))
    store.put_vectors(spark.range(1, 40_001).select("id", F.array(F.lit(3.0), F.lit(4.0)).alias("vector")).where("id % 2 = 0"))
    assert store.read().where("vec is not null").count() == 20_000 == store.pending().count()


def test_store_keeps_segments_and_forgets_old_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), most=4)
    chunk = lambda s, text: spark.createDataFrame([(s, 0, text, ["x"], text)], "source string, ord int, text string, tags array<string>, doc_hash string")
    folders = lambda: {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()}
    store.add(chunk("a", "one"))
    first = folders()
    store.add(chunk("b", "two"))
    assert first <= folders() and len({n for n in folders() if n.startswith("segment")}) == 2  # the first segment is as it was
    store.add(chunk("a", "three"))
    store.put_vectors(spark.createDataFrame([(3, [2.0])], "id long, vector array<double>"))
    store.delete("b")
    assert [(r.id, r.source, r.text, r.vec) for r in store.read().collect()] == [(3, "a", "three", [1.0])]
    store.add(chunk("b", "four"))
    store.add(chunk("c", "five"))
    assert {(r.id, r.source) for r in store.read().collect()} == {(3, "a"), (4, "b"), (5, "c")}
    store.reset()
    store.add(chunk("d", "six"))
    assert [(r.id, r.source) for r in store.read().collect()] == [(1, "d")] and len(folders()) <= 4 and not any(n.startswith("staging") for n in folders())


def test_workbooks(spark):
    files = spark.createDataFrame([("k.xlsx", bytearray(BOOK))], "name string, content binary")
    got = [(r.qid, r.question, r.sheet) for r in folder.questions(files).orderBy("qid").collect()]
    assert got == [(0, "Was ist X?", "A"), (1, "Wozu?", "A"), (2, "q", "_mess"), (3, "Begriff", "_anon")]
    assert folder.term_rules(files) == [("Rom", "wort", "[ORT]")]


def test_stream(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    for n in range(2):
        (files / f"{n}.txt").write_text(f"Dies ist der Text mit der Nummer {n}.")
        q = ingest(spark, str(files), store, str(tmp_path / "check"))
        q.awaitTermination(120)
    assert {r.source for r in store.read().collect()} == {"0.txt", "1.txt"}
    tokens = spark.createDataFrame([("r", 2, "</think>"), ("r", 1, "hm"), ("r", 3, "Ja"), ("s", 1, "nie")], "request_id string, seq int, token string")
    assert {r.request_id: r.answer for r in answers(tokens).collect()} == {"r": "Ja", "s": ""}
