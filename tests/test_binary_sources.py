"""PDF and Outlook files, made here byte by byte."""

import struct
import zlib

import pytest

from parchment.operators import evaluation
from parchment.sources import folder, outlook, pdf


def document(objects, streams=(), trailer="<< /Root 1 0 R >>"):
    """objects: {number: source}; streams: {number: (entries of the dictionary, bytes)}"""
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o.encode("latin-1")) for n, o in objects.items())
    for n, (about, raw) in dict(streams).items():
        out += b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(raw), about.encode(), raw)
    return out + b"trailer\n" + trailer.encode() + b"\n%%EOF"


CMAP = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <004D> <0002> <00FC0066> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <D83DDE00>] endbfrange end"
OBJECTS = {
    1: "<< /Type /Catalog /Pages 2 0 R >>",
    2: "<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R 6 0 R] /Count 4 /Resources << /Font << /A 7 0 R /B 8 0 R >> /XObject << /F 14 0 R >> >> >>",
    3: "<< /Type /Page /Parent 2 0 R /Contents [10 0 R 11 0 R] >>",
    4: "<< /Type /Page /Parent 2 0 R >>",
    5: "<< /Type /Page /Parent 2 0 R /Contents 12 0 R >>",
    6: "<< /Type /Page /Parent 2 0 R /Contents 13 0 R >>",
    7: "<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /Adieresis /uni20AC] >> >>",
    8: "<< /Type /Font /Subtype /Type0 /DescendantFonts [9 0 R] /ToUnicode 15 0 R >>",
    9: "<< /Type /Font /DW 500 /W [1 [600 700] 16 18 400] >>",
}
STREAMS = {
    10: ("", b"BT /A 10 Tf 14 TL 50 700 Td (Erste \\(Zeile\\)) Tj T* (zwei\\344) Tj ET"),
    11: ("/Filter /FlateDecode", zlib.compress(b"BT /A 10 Tf 50 600 Td [(Wo) 20 (rt) -400 (Rest)] TJ 0 -20 Td (\\001\\002\\003) ' ET BI /W 1 ID \x00(\xff EI BT 50 500 Td /A 10 Tf <4e616368> Tj ET")),
    12: ("/Filter [/ASCIIHexDecode /FlateDecode]", zlib.compress(b"BT /B 12 Tf 1 0 0 1 10 10 Tm <00010002> Tj <001000110012> Tj <00200021> Tj <0099> Tj ET").hex().encode() + b">"),
    13: ("", b"q 1 0 0 1 5 5 cm /F Do Q"),
    14: ("/Subtype /Form", b"BT /A 8 Tf (im Formular) Tj ET /F Do"),
    15: ("", CMAP),
}


def test_pages_of_a_pdf():
    pages = pdf.pdf(document(OBJECTS, STREAMS)).split("\n\f\n")
    assert pages == ["Erste (Zeile)\nzweiä\nWort Rest\nfiÄ€\nNach", "Müfabcx\U0001f600", "im Formular"]


def test_objects_may_lie_in_an_object_stream_and_change_later():
    packed = {n: o for n, o in OBJECTS.items()}
    body = [f"{o} " for o in packed.values()]
    heads = " ".join(f"{n} {sum(map(len, body[:i]))}" for i, n in enumerate(packed)) + " "
    raw = zlib.compress((heads + "".join(body)).encode())
    stored = {**STREAMS, 20: (f"/Type /ObjStm /N {len(body)} /First {len(heads)} /Filter /FlateDecode", raw), 21: ("/Type /XRef /Root 1 0 R", b"?")}
    assert pdf.pdf(document({}, stored, "<< >>")) == pdf.pdf(document(OBJECTS, STREAMS))
    later = document(OBJECTS, STREAMS) + b"\n13 0 obj\n<< /Length 99 0 R >>\nstream\nBT /A 9 Tf (neu) Tj ET\nendstream\nendobj\n"
    assert pdf.pdf(later).endswith("\n\f\nneu")


def test_pdfs_that_cannot_be_read():
    with pytest.raises(ValueError, match="without pages"):
        pdf.pdf(b"%PDF")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.pdf(document(OBJECTS, STREAMS, "<< /Root 1 0 R /Encrypt 5 0 R >>"))
    unread = {n: ("/Filter /LZWDecode", b"x") for n in (10, 11, 12, 13)}
    assert pdf.pdf(document(OBJECTS, {**STREAMS, 12: unread[12]})).count("\f") == 1  # one page less
    with pytest.raises(ValueError, match="LZWDecode"):
        pdf.pdf(document({**OBJECTS, 4: OBJECTS[3]}, {**STREAMS, **unread}))
    circle = {**OBJECTS, 2: "<< /Type /Pages /Kids [2 0 R 5 0 R] /Resources << /Font << /B 8 0 R >> >> >>"}
    assert pdf.pdf(document(circle, STREAMS)) == "Müfabcx\U0001f600"
    for cut in range(0, 2000, 37):  # damaged files give an error or a text, and end
        try:
            assert isinstance(pdf.pdf(document(OBJECTS, STREAMS)[:cut]), str)
        except ValueError:
            pass


def compound(tree):
    """A compound file with these streams (bytes) and storages (dicts), each directory a chain of right siblings."""
    entries, mini, mini_next, big = [], b"", [], []

    def chain(children):
        numbers = [len(entries) + i for i in range(len(children))]
        entries.extend([None] * len(children))
        for n, (name, value), right in zip(numbers, children.items(), [*numbers[1:], 0xFFFFFFFF]):
            entries[n] = (name, 1, right, chain(value), 0, 0) if isinstance(value, dict) else (name, 2, right, 0xFFFFFFFF, *put(value))
        return numbers[0] if numbers else 0xFFFFFFFF

    def put(value):
        nonlocal mini
        if len(value) >= 4096:
            big.append(value)
            return -len(big), len(value)
        first, n = len(mini) // 64, -(-len(value) // 64)
        mini += value.ljust(n * 64, b"\0")
        mini_next.extend([*range(first + 1, first + n), 0xFFFFFFFE][:n])
        return first if n else 0xFFFFFFFE, len(value)

    entries.append(None)
    entries[0] = ("Root Entry", 5, 0xFFFFFFFF, chain(tree), "mini", len(mini))
    size = lambda b: -(-len(b) // 512)
    table = struct.pack(f"<{len(mini_next)}I", *mini_next)
    parts = [b"\0" * 128 * len(entries), table, mini, *big]
    starts, sectors, following = [], 1, [0xFFFFFFFD]
    for part in parts:
        starts.append(sectors if part else 0xFFFFFFFE)
        following += [*range(sectors + 1, sectors + size(part)), 0xFFFFFFFE][: size(part)]
        sectors += size(part)
    directory = b""
    for name, kind, right, child, first, length in entries:
        first = starts[2] if first == "mini" else starts[2 - first] if first < 0 else first
        coded = name.encode("utf-16-le") + b"\0\0"
        directory += coded.ljust(64, b"\0") + struct.pack("<HBBIII", len(coded), kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", first, length)
    parts[0] = directory
    head = outlook.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, 1, starts[0], 0, 4096, starts[1], size(table), 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    assert len(following) <= 128 and len(head) == 512
    return head + struct.pack("<128I", *following, *[0xFFFFFFFF] * (128 - len(following))) + b"".join(p.ljust(size(p) * 512, b"\0") for p in parts)


def wide(text):
    return text.encode("utf-16-le")


RECIPIENTS = {f"__recip_version1.0_#0000000{i}": {"__substg1.0_3001001F": wide(n)} for i, n in enumerate(["Eva Ö", "Bob", "Eva Ö", ""])}


def test_mails_of_outlook():
    long = "Guten Tag. " * 500
    made = compound({"__substg1.0_0037001F": wide("Grüße =?utf-8?B?w7w=?="), "__substg1.0_0C1A001E": "Max Müller".encode("cp1252"), "__substg1.0_1000001F": wide(long), **RECIPIENTS})
    assert outlook.message(made) == f"## Mail von Max Müller\nVon: Max Müller\nAn: Eva Ö, Bob\nBetreff: Grüße ü\n\n{long.strip()}"
    html = compound({"__substg1.0_0C1F001F": wide("max.m@x.example"), "__substg1.0_1013001E": b"<p>Hallo <b>du</b></p>"})
    assert outlook.message(html) == "## Mail von max m\nVon: max.m@x.example\n\nHallo  du"
    assert outlook.message(compound({})) == "\n"
    with pytest.raises(ValueError):
        outlook.message(b"no mail")


def test_both_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(document(OBJECTS, STREAMS))
    (tmp_path / "b.MSG").write_bytes(compound({"__substg1.0_1000001F": wide("Text")}))
    (tmp_path / "c.msg").write_bytes(b"broken")
    rows = {r.name: r for r in folder.extract(folder.read_folder(spark, str(tmp_path))).collect()}
    assert rows["a.pdf"].text.count("\f") == 2 and rows["b.MSG"].text == "\nText" and rows["c.msg"].text is None and "ValueError" in rows["c.msg"].error


def test_golden_set(spark):
    asked = evaluation.golden_set(spark)
    found = spark.createDataFrame([(0, 1, "alle 24 monate"), (3, 6, "low"), (6, 5, "mindestens RC 3")], "qid long, rank int, text string")
    assert evaluation.golden(asked, found).first()[:] == (8, 2, 0.25)
