"""The training document and its known corruptions (V13, V14), and files of known content, as DataFrames."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Proportions of the training document; fixed values.
RECORDS, LINES_A_PAGE = 840, 16


def training_document(spark: SparkSession, records: int = RECORDS) -> DataFrame:
    """(record, page, line, date_raw, number, amount_raw, marker, x): record i has the amount 1000 + 137 i with 7 i mod 100 cents."""
    i = F.col("id")
    units, cents = (F.lit(1000) + i * 137).cast("string"), F.lpad(((i * 7) % 100).cast("string"), 2, "0")
    amount = F.concat(F.regexp_replace(units, r"(\d)(?=(\d{3})+$)", "$1 "), F.lit(","), cents)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 360).cast("int"))
    return spark.range(records).select(
        i.alias("record"), (F.floor(i / LINES_A_PAGE) + 1).cast("int").alias("page"), (i % LINES_A_PAGE + 1).cast("int").alias("line"), F.date_format(day, "dd.MM.yyyy").alias("date_raw"),
        (i + 1).cast("long").alias("number"), amount.alias("amount_raw"), F.when(i % 3 != 0, "debit").otherwise("credit").alias("marker"), F.lit(0.7).alias("x"), F.lit(0).alias("rotation"), F.lit("text").alias("layer"),
    )


#: Each corruption: what it does to the document; at names the record that it strikes.
CORRUPTIONS = {
    "rotated_page": lambda d, at: d.withColumn("rotation", F.when(F.col("page") == at // LINES_A_PAGE + 1, 90).otherwise(F.col("rotation"))),
    "broken_layer": lambda d, at: d.withColumn("layer", F.when(F.col("page") == at // LINES_A_PAGE + 1, "broken").otherwise(F.col("layer"))),
    "damaged_encoding": lambda d, at: d.withColumn("amount_raw", F.when(F.col("record") == at, F.translate("amount_raw", "0123456789", "ÐÑÒÓÔÕÖØÙÚ")).otherwise(F.col("amount_raw"))),
    "missing_row": lambda d, at: d.where(F.col("record") != at),
    "duplicated_row": lambda d, at: d.unionByName(d.where(F.col("record") == at)),
    "parentheses": lambda d, at: d.withColumn("amount_raw", F.when(F.col("record") == at, F.concat(F.lit("("), F.col("amount_raw"), F.lit(")"))).otherwise(F.col("amount_raw"))),
    "leading_zeros": lambda d, at: d.withColumn("amount_raw", F.when(F.col("record") == at, F.concat(F.lit("000"), F.col("amount_raw"))).otherwise(F.col("amount_raw"))),
    "changed_form": lambda d, at: d.withColumn("x", F.col("x") + 0.15),
    "page_break": lambda d, at: d.withColumn("page", F.when(F.col("record") >= at, F.col("page") + 1).otherwise(F.col("page"))),
}


def corrupted(document: DataFrame, kind: str, at: int = 100) -> DataFrame:
    return CORRUPTIONS[kind](document, at)


def text_files(rows: DataFrame, document: Column, order: list[str], line: Column, head: Column | None = None, tail: Column | None = None, between: str = "\n") -> DataFrame:
    """(document_id, content): a file for each document, its lines in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"])
    own = rows.groupBy(document.cast("string").alias("document_id")).agg(F.array_join(lines, between).alias("__text"))
    text = F.concat(*(c for c in (head, F.col("__text"), tail) if c is not None))
    return own.select("document_id", text.cast("binary").alias("content"))


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, data in parts.items():
            box.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def xlsx_bytes(rows: list[list[str]]) -> bytes:
    """A workbook with one sheet of text cells, shared strings among them."""
    shared = sorted({c for row in rows for c in row})
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + k)}{r}" t="s"><v>{shared.index(c)}</v></c>' for k, c in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    return zipped({
        "xl/workbook.xml": '<workbook xmlns="urn:m" xmlns:r="urn:r"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
    })


def docx_bytes(rows: list[list[str]]) -> bytes:
    """A text document: the first row as paragraphs, the others as a table."""
    said = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{said(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows[1:])
    return zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{"".join(map(said, rows[0]))}<w:tbl>{table}</w:tbl></w:body></w:document>'})


def pdf_bytes(rows: list[list[str]], lines_a_page: int = 40) -> bytes:
    """A PDF of lines of text: composite font with a map to Unicode, box and rotation on the page tree, two revisions of a page."""
    signs = sorted({c for row in rows for text in row for c in text})
    code = {c: k + 1 for k, c in enumerate(signs)}
    ranges = "".join(f"<{k:04X}> <{k:04X}> <{c.encode('utf-16-be').hex()}>\n" for c, k in code.items() if k % 2)
    single = "".join(f"<{k:04X}> <{c.encode('utf-16-be').hex()}>\n" for c, k in code.items() if k % 2 == 0)
    table = f"begincmap\n{len(signs)} beginbfrange\n{ranges}endbfrange\n{len(signs)} beginbfchar\n{single}endbfchar\nendcmap"
    pages = [rows[k : k + lines_a_page] for k in range(0, len(rows), lines_a_page)]
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>"]
    packed = lambda data: b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(z := zlib.compress(data)), z)
    objects.append(packed(table.encode()))
    kids = []
    for page in pages:
        shows = "".join(f"1 0 0 1 {100 + 200 * k} {960 - 20 * n} Tm <{''.join(f'{code[c]:04X}' for c in text)}> Tj\n" for n, row in enumerate(page) for k, text in enumerate(row))
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(packed(f"q BT /F1 10 Tf\n{shows}ET Q".encode()))
    objects[1] = b"<< /Type /Pages /MediaBox [0 0 1000 1000] /Rotate 0 /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in enumerate(objects, 1))
    return b"%PDF-1.5\n" + (b"%d 0 obj\n<< /Type /Page >>\nendobj\n" % kids[0] if kids else b"") + body + b"trailer << /Root 1 0 R >>\n%%EOF\n"


BUILDERS = {"xlsx": xlsx_bytes, "docx": docx_bytes, "pdf": pdf_bytes}


def table_files(rows: DataFrame, document: Column, order: list[str], cells: list[Column], kind: str) -> DataFrame:
    """(document_id, content): a file of a kind for each document, its rows of text cells in order."""
    build = BUILDERS[kind]

    @F.pandas_udf(T.BinaryType())
    def made(tables: pd.Series) -> pd.Series:
        return tables.map(lambda t: build([list(r) for r in t]))

    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.array(*(c.cast("string") for c in cells)).alias("__cells")))), lambda x: x["__cells"])
    return rows.groupBy(document.cast("string").alias("document_id")).agg(lines.alias("__rows")).select("document_id", made("__rows").alias("content"))


def faulty_archives(keys: DataFrame, key: str, kinds: int = 8) -> DataFrame:
    """(document_id, content): an archive for each key; its fault is key mod 8: none, a way out, a link, a lock, a macro, a bomb, nesting, damage."""

    def one(k: int) -> bytes:
        kind, plain = k % kinds, f"content of {k}"
        if kind == 5:
            return zipped({"zeros": b"\0" * 300_000})
        if kind == 6:
            data = zipped({"a.txt": plain})
            for _ in range(6):
                data = zipped({"in.zip": data})
            return data
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
            item = zipfile.ZipInfo({1: "../a.txt", 4: "xl/vbaProject.bin"}.get(kind, "a.txt"))
            if kind == 2:
                item.external_attr = 0o120777 << 16
            box.writestr(item, plain)
        data = bytearray(out.getvalue())
        if kind == 3:  # the bit that says a member is locked, in both of its headers
            data[6] |= 1
            data[data.index(b"PK\x01\x02") + 8] |= 1
        return bytes(data[: len(data) // 2] if kind == 7 else data)

    @F.pandas_udf(T.BinaryType())
    def made(k: pd.Series) -> pd.Series:
        return k.map(lambda x: one(int(x)))

    return keys.select(F.col(key).cast("string").alias("document_id"), made(F.col(key)).alias("content"))
