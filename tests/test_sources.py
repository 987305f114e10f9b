"""Readers and sinks on small files made here."""

import io
import zipfile
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave.sources import files as S
from ledgerweave.sources import readers as R
from ledgerweave.sources import workbook as W


def given(spark, *contents):
    return spark.createDataFrame([(f"d{k}", bytearray(c)) for k, c in enumerate(contents)], "document_id string, content binary")


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def rows(df):
    return sorted(((r["document_id"], r["structural_path"], r["raw_text"], dict(r["properties"] or {})) for r in df.collect()), key=str)


def test_files_are_known_by_their_bytes(spark, tmp_path):
    for name, data in (("a.csv", b"x;y\n"), ("own.txt", b"..." + S.DERIVED_MARK.encode()), ("none.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r for r in S.read_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"]["refusals"] == [] and len(got["a.csv"]["document_id"]) == 64
    assert got["own.txt"]["refusals"] == ["E_DERIVED_INPUT"] and got["none.txt"]["refusals"] == ["E_EMPTY_FILE"]
    small = {r["name"]: r for r in S.read_files(spark, str(tmp_path), S.Limits(file_bytes=2)).collect()}
    assert small["a.csv"]["refusals"] == ["E_LIMIT_SIZE"] and small["a.csv"]["content"] is None


def test_names_limits_and_guards(spark):
    names = ["../../etc/passwd", "CON.txt", " .a<b>.pdf. ", "", None, "..\\x\n.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(S.safe_name(F.col("n")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["passwd", "_CON.txt", "a_b_.pdf", "unnamed", "unnamed", "x_.csv"]
    told = spark.createDataFrame([(2000, None)], "pages int, depth int").select(S.check_limits({"pages": (F.col("pages"), 1000), "depth": (F.col("depth"), 5)}).alias("c")).first()["c"]
    assert told["refusals"] == ["E_LIMIT_PAGES"] and told["unchecked"] == ["depth"]
    seen = spark.createDataFrame([("=1+1", "1234567890123456"), ("a", "0.00000000000000012")], "t string, d string").select(S.formula_like(F.col("t")), S.too_many_digits(F.col("d"))).collect()
    assert [tuple(r) for r in seen] == [(True, True), (False, False)]


def test_archives(spark):
    deep = zipped(a_dot_txt=b"x")
    for _ in range(6):
        deep = zipped(in_dot_zip=deep)
    cases = {"fine": zipped(a_dot_txt=b"x"), "up": zipped(**{"..__a": b"x"}), "bomb": zipped(a=b"0" * 5_000_000), "deep": deep, "macro": zipped(xl__vbaProject_dot_bin=b"x"), "broken": b"PK\x03\x04 nothing"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "document_id string, content binary")
    got = {r["document_id"]: r["codes"] for r in S.inspect_archives(df).collect()}
    assert got == {"fine": [], "up": ["E_ARCHIVE_TRAVERSAL"], "bomb": ["E_ARCHIVE_BOMB"], "deep": ["E_ARCHIVE_DEPTH"], "macro": ["E_MACRO"], "broken": ["E_ARCHIVE_DAMAGED"]}


def test_text_and_csv(spark):
    assert rows(R.read(given(spark, "a\r\n\n b\n".encode()), "text")) == [("d0", "line[1]", "a", {}), ("d0", "line[3]", " b", {})]
    got = rows(R.read(given(spark, 'k;v\n1;"a;\nb"\n2;c;d\n'.encode()), "csv"))
    assert [(p, t) for _, p, t, _ in got] == [("row[3]/cell[1]", "1"), ("row[3]/cell[2]", "a;\nb"), ("row[4]/cell[1]", "2"), ("row[4]/cell[2]", "c"), ("row[4]/cell[3]", "d")]
    assert got[1][3] == {"column": "2", "header": "v", "file_line": "3"} and got[4][3]["width"] == "3"
    assert rows(R.csv_cells(given(spark, b"\xff\xfe\n")))[0][3] == {"code": "E_ADAPTER_FAILED", "reason": "UnicodeDecodeError"}


def test_mt940(spark):
    text = "{1:F01}\n:20:REF1\n:61:2401010101D12,50NTRF\n:86:first\nsecond\n-}\n:20:REF2\n:25:ACC\n"
    got = rows(R.read(given(spark, text.encode()), "mt940"))
    assert [(p, t, x["tag"], x["continuations"]) for _, p, t, x in got] == [("message[1]/field[1]", "REF1", "20", "0"), ("message[1]/field[2]", "2401010101D12,50NTRF", "61", "0"), ("message[1]/field[3]", "first\nsecond", "86", "1"), ("message[2]/field[4]", "REF2", "20", "0"), ("message[2]/field[5]", "ACC", "25", "0")]


def test_ofx(spark):
    text = "OFXHEADER:100\n<OFX><BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<TRNAMT>-1.50\n<NAME>Shop & co</STMTTRN><STMTTRN>\n<TRNAMT>2</BANKTRANLIST>"
    got = rows(R.read(given(spark, text.encode()), "ofx"))
    assert [x for *_, x in got] == [{"TRNTYPE": "DEBIT", "TRNAMT": "-1.50", "NAME": "Shop & co"}, {"TRNAMT": "2"}]
    digits = "<STMTTRN><A> 010.20 <B>1001<C>2-2</STMTTRN>"  # a cell's number in the list plays no part
    assert rows(R.read(given(spark, digits.encode()), "ofx"))[0][3] == {"A": "010.20", "B": "1001", "C": "2-2"}


def test_camt053(spark):
    xml = b'<D xmlns="urn:x"><Stmt><Id>S1</Id><Acct><Id><IBAN>DE1</IBAN></Id></Acct><Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">10.10</Amt><CdtDbtInd>CRDT</CdtDbtInd><Dt><Dt>2024-01-01</Dt></Dt></Bal><Ntry><Amt Ccy="EUR">0.30</Amt><CdtDbtInd>DBIT</CdtDbtInd><Sts>BOOK</Sts><BookgDt><Dt>2024-01-02</Dt></BookgDt></Ntry></Stmt></D>'
    got = {p: (t, x) for _, p, t, x in rows(R.read(given(spark, xml), "camt053"))}
    assert got["statement[1]/header"][1] == {"kind": "header", "id": "S1", "iban": "DE1"}
    assert got["statement[1]/balance[1]"] == ("10.10", {"kind": "balance", "code": "OPBD", "date": "2024-01-01", "amount": "10.10", "currency": "EUR", "mark": "CRDT"})
    assert got["statement[1]/entry[1]"][0] == "0.30"
    assert rows(R.read(given(spark, b'<!DOCTYPE a [<!ENTITY b "c">]><a/>'), "camt053"))[0][3]["code"] == "E_ADAPTER_FAILED"


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "=cmd()", Decimal("-1.50")), ("2", None, Decimal("12345678901234567.10"))], "id string, t string, a decimal(20,2)")
    path = tmp_path / "out.xlsx"
    W.save_workbook({"DATA": df, "REVIEW": df.limit(0)}, str(path))
    got = {p: t for _, p, t, _ in rows(R.read(given(spark, path.read_bytes()), "xlsx"))}
    assert got == {"DATA!A1": "id", "DATA!B1": "t", "DATA!C1": "a", "DATA!A2": "1", "DATA!B2": "'=cmd()", "DATA!C2": "-1.50", "DATA!A3": "2", "DATA!C3": "12345678901234567.10", "REVIEW!A1": "id", "REVIEW!B1": "t", "REVIEW!C1": "a"}
    assert given(spark, path.read_bytes()).select(S.derived(F.col("content"))).first()[0]
    with pytest.raises(W.SinkError, match="E_FLOAT_FORBIDDEN"):
        W.save_workbook({"DATA": df.select(F.lit(0.1))}, str(path))
    with pytest.raises(W.SinkError, match="E_SHEET_NAME"):
        W.save_workbook({"OTHER": df}, str(path))


def test_docx(spark):
    w = 'xmlns:w="urn:w"'
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert [(p, t) for _, p, t, _ in rows(R.read(given(spark, zipped(word__document_dot_xml=xml)), "docx"))] == [("paragraph[1]", "Hello"), ("table[1]/row[1]/cell[1]", "a")]


def test_pdf(spark):
    body = zlib.compress(b"BT /F1 10 Tf 100 700 Td (Date \\(x\\)) Tj 0 -20 Td [(1) -5 (2,50)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Page /MediaBox [0 0 500 1000] /Contents 2 0 R>> endobj\n2 0 obj <</Filter /FlateDecode>> stream\n" + body + b"\nendstream endobj\n3 0 obj <</Type /Page /Rotate 90>> endobj\n"
    got = {p: (t, x) for _, p, t, x in rows(R.read(given(spark, pdf), "pdf"))}
    assert got["page[1]/text[1]"][0] == "Date (x)" and got["page[1]/text[2]"][0] == "12,50"
    assert (got["page[1]/text[1]"][1]["x"], got["page[1]/text[2]"][1]["y"], got["page[1]/text[1]"][1]["font_share"]) == ("0.200", "0.680", "0.010000")
    assert got["page[1]/layer"][1]["layer"] == "readable" and got["page[2]/layer"][1]["layer"] == "scan"


def pdf_of(*objects, tail=b""):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in objects) + tail


def stream(head, body, length=None):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(body) if length is None else length, body)


def test_pdf_fonts_with_a_map(spark):
    table = b"begincmap 1 beginbfchar <0001> <00480069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0416> <D83DDE00>] endbfrange endcmap"
    fonts = b"<< /Font << /F1 5 0 R /F2 6 0 R /F3 7 0 R >> >>"
    content = b"q 2 0 0 2 10 20 cm BT /F1 5 Tf 1 0 0 1 20 40 Tm <0001001000110012> Tj /F3 5 Tf 0 -10 Td (caf\\351 \\(x\\)) Tj ET Q BT /F1 8 Tf 1 0 0 3 100 500 Tm [<0020> -20 <0021>] TJ ET % endobj 9 0 obj"
    good = pdf_of(
        (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /MediaBox [0 0 200 1000] /Rotate 90 /Resources " + fonts + b" /Kids [3 0 R 8 0 R] /Count 2 >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>"),
        (4, stream(b"", content)), (5, b"<< /Subtype /Type0 /ToUnicode 10 0 R >>"), (6, b"<< /Subtype /Type0 >>"), (7, b"<< /Subtype /Type1 >>"), (8, b"<< /Type /Page /Contents 11 0 R /Rotate 0 >>"), (10, stream(b"/Filter /FlateDecode", zlib.compress(table))),
        (11, stream(b"", b"BT /F2 5 Tf 10 10 Td <00010002> Tj ET")),
    )
    got = {p: (t, x) for _, p, t, x in rows(R.read(given(spark, good), "pdf"))}
    first, second, third = (got[f"page[1]/text[{k}]"] for k in (1, 2, 3))
    assert (first[0], second[0], third[0]) == ("Hiabc", "café (x)", "Ж😀")
    assert (first[1]["x"], first[1]["y"], first[1]["font_share"]) == ("0.250", "0.100", "0.010000") and third[1]["font_size"] == "24" and first[1]["rotation"] == "90"
    assert got["page[1]/layer"][1] | {"layer": "readable", "rotation": "90"} == got["page[1]/layer"][1] and got["page[2]/layer"][1]["layer"] == "unreadable" and got["page[2]/layer"][1]["rotation"] == "0"


def test_pdf_structure(spark):
    from ledgerweave.sources import pdf

    heads = b"5 0 6 43 "
    packed = heads + b"<< /Type /Page /MediaBox [0 0 9 9] >>".ljust(43) + b"42"
    doc = pdf.read(pdf_of((1, b"<< /Old true >>"), (2, stream(b"", b"a endobj 7 0 obj (no) endobj b")), (1, b"<< /New [1 0 R (a(b)\\n\\051) <4a4> -.5 null true /A#20b] >>"), (3, stream(b"", b"wrong length", 3)), (4, stream(b"/Type /ObjStm /N 2 /First 9", packed))))
    assert doc.values[1] == {"New": [pdf.Ref(1), b"a(b)\n)", b"J@", -0.5, None, True, "A b"]} and 7 not in doc.values
    assert doc.streams[2].endswith(b"endobj b") and doc.streams[3].strip() == b"wrong length" and doc.values[6] == 42 and [p.get("MediaBox") for p in doc.pages()] == [[0, 0, 9, 9]]
    loop = pdf_of((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [2 0 R 2 0 R] >>"))
    assert pdf.read(loop).pages() == []
    for data in (b"%PDF-1.4 garbage << [ ( <", b"no pdf", b"%PDF-1.4 /Encrypt " + loop, b"%PDF-1.4\n1 0 obj " + b"[" * 5000):
        assert all(p in ("refusal",) for _, p, *_ in rows(R.read(given(spark, data), "pdf")))


def test_deadlines():
    from ledgerweave.sources.deadline import TICKS, Deadline, DeadlineError

    now = [0.0]
    whole = Deadline("document", 10, clock=lambda: now[0])
    page, short = whole.child("page", 100), whole.child("table", 3)
    assert whole.left() == page.left() == 10 and short.left() == 3 and page.tick()
    now[0] = 5
    with pytest.raises(DeadlineError, match="table"):
        short.tick()
    now[0] = 11
    assert all(page.tick() for _ in range(TICKS - 1))  # the clock isn't asked each time
    with pytest.raises(DeadlineError, match="document"):
        page.tick()


def test_policy(spark):
    locked = bytearray(zipped(a_dot_txt=b"x"))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    cases = [b"", b"%PDF-1.4 %%EOF", b"%PDF-1.4", b"%PDF-1.4 /Encrypt %%EOF", bytes(locked), zipped(xl__vbaProject_dot_bin=b"x"), b"PK\x03\x04 not", b"\xd0\xcf\x11\xe0" + S.OLE_ENCRYPTED, b"\xd0\xcf\x11\xe0" + S.OLE_MACROS[1], b"plain"]
    assert [S.policy_codes(c) for c in cases] == [["E_POLICY_BROKEN"], [], ["E_POLICY_BROKEN"], ["E_POLICY_ENCRYPTED"], ["E_POLICY_ENCRYPTED"], ["E_POLICY_MACROS"], ["E_POLICY_BROKEN"], ["E_POLICY_ENCRYPTED"], ["E_POLICY_MACROS"], []]
    assert [(r["kind"], r["codes"]) for r in S.apply_policy(given(spark, *cases[:2])).orderBy("document_id").collect()] == [("text", ["E_POLICY_BROKEN"]), ("pdf", [])]


def test_blob_store(spark, tmp_path):
    import json

    from ledgerweave.sources.store import BlobStore, JdbcBlobStore, StoreError, load_run, save_run

    blobs = lambda *rows: spark.createDataFrame([(a, n, bytearray(c)) for a, n, c in rows], "shelf string, name string, content binary")
    for box in (BlobStore(spark, str(tmp_path / "store")), JdbcBlobStore(spark, f"jdbc:derby:{tmp_path}/db;create=true", "blobs")):
        assert box.listed().count() == 0 and box.restore().count() == 0
        assert box.save(blobs(("s", "a", b"1"), ("s", "b", b"2"))) == 2 and box.save(blobs(("s", "a", b"1"))) == 0
        assert box.save(blobs(("s", "a", b"3"), ("t", "a", b"1"))) == 2
        assert sorted((r["shelf"], r["name"], bytes(r["content"])) for r in box.restore().collect()) == [("s", "a", b"3"), ("s", "b", b"2"), ("t", "a", b"1")]
    part = next((tmp_path / "store").glob("version=1/part*"))
    broken = spark.createDataFrame([("s", "b", "0" * 64, bytearray(b"9"))], "shelf string, name string, document_id string, content binary")
    broken.coalesce(1).write.parquet(str(tmp_path / "store" / "version=9"))
    with pytest.raises(Exception, match="E_STORE_CONTENT"):
        BlobStore(spark, str(tmp_path / "store")).restore().collect()
    assert part.exists()
    save_run({"a": spark.range(3)}, str(tmp_path / "run"))
    assert load_run(spark, str(tmp_path / "run"))["a"].count() == 3
    spark.range(2).write.mode("append").parquet(str(tmp_path / "run" / "a"))
    with pytest.raises(StoreError, match="E_RUN_ROWS"):
        load_run(spark, str(tmp_path / "run"))
    spark.range(2).write.parquet(str(tmp_path / "half" / "a"))
    with pytest.raises(StoreError, match="E_RUN_NOT_WHOLE"):
        load_run(spark, str(tmp_path / "half"))
    decisions = spark.createDataFrame([(1, "x", "DATA"), (1, "y", "REJECTED"), (2, "z", "DATA")], "batch int, id string, sheet string")
    gates = spark.createDataFrame([(1, "open"), (2, "closed")], "batch int, gate string")
    W.release_books(decisions, gates, ["batch"], ["id"], str(tmp_path / "books"))
    client = rows(R.read(given(spark, (tmp_path / "books" / "client.xlsx").read_bytes()), "xlsx"))
    assert [(p, t) for _, p, t, _ in client] == [("DATA!A1", "id"), ("DATA!A2", "x")]
    told = json.loads((tmp_path / "books" / "control.json").read_text())
    assert told["sheets"] == {"DATA": 2, "REVIEW": 0, "REJECTED": 1, "ERRORS": 0, "AUDIT": 2} and len(told["sha256"]) == 64


def test_annotation_form(spark):
    head = ";".join(R.FORM)
    text = f"{head}\nd;1;1;01;02;2024;;1,50;debit;;;\nd;1;1;01;02;2024;;1,50;both;;;\n;1;2;;;;;;;;;\n"
    got = R.annotation_form(given(spark, text.encode(), b"a;b\n")).orderBy("document_id", "file_line").collect()
    assert [r["errors"] for r in got] == [[], ["E_FORM_REPEATED", "E_FORM_SIDE"], ["E_FORM_MISSING_DOCUMENT"], ["E_FORM_HEADER"]]


def test_registry():
    with pytest.raises(ValueError, match="no reader"):
        R.read(None, "parchment")
    assert {"text", "csv", "mt940", "ofx", "camt053", "xlsx", "docx", "pdf"} <= set(R.READERS)


def test_intermediate_tables_can_be_cleared(spark):
    """Those of one session only: rounds of connected components leave one table, and clean() takes it."""
    import os

    from ledgerweave import work
    from ledgerweave.operators.graph import connected_components

    local = lambda p: p.removeprefix("file://")
    kept = work.MADE.pop(spark, [])
    other = spark.newSession()
    work.written(other.range(3), "t")
    assert connected_components(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a long, b long")).count() == 6
    (path,), (theirs,) = work.MADE[spark], work.MADE[other]
    assert os.path.isdir(local(path)) and os.path.isdir(local(theirs))
    work.clean(spark)
    assert not os.path.exists(local(path)) and os.path.isdir(local(theirs)) and work.MADE[spark] == []
    work.clean(other)
    work.MADE[spark] = kept


def test_several_machines_need_a_shared_folder(spark):
    from ledgerweave import work

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None if "checkpoint" in key else "file:/w")})
        sparkContext = type("Context", (), {"master": "yarn", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda key: None)}))})

    with pytest.raises(RuntimeError, match="share"):
        work.shared_dir(Far())
    Far.sparkContext.master = "local[2]"
    assert work.shared_dir(Far()) == "file:///w/_work"
