"""Readers of documents into source objects (S06-S15, S25). Amounts stay text: no number is guessed.

Every reader takes files (document_id, content) and gives OBJECT rows. Formats
are registered by name; a later reader of a format takes the place of one with
the same or a lower priority.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.sources.deadline import Deadline, DeadlineError
from ledgerweave.sources.pdf import texts

OBJECT = "document_id string, page int, structural_path string, raw_text string, properties map<string,string>, engine string"
Item = tuple[int, str, str | None, dict[str, str]]
READERS: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}


def register(name: str, priority: int = 0):
    def put(f: Callable[[DataFrame], DataFrame]):
        if READERS.get(name, (priority,))[0] <= priority:
            READERS[name] = (priority, f)
        return f

    return put


def read(files: DataFrame, kind: str) -> DataFrame:
    """Source objects of files by the reader of a format."""
    if kind not in READERS:
        raise ValueError(f"no reader of {kind}")
    return READERS[kind][1](files)


def read_all(files: DataFrame, kind: str = "kind") -> DataFrame:
    """Source objects of files of all registered formats, each by its own reader; files of other kinds give a refusal."""
    out = files.where(~F.coalesce(F.col(kind).isin(*READERS), F.lit(False))).select("document_id", F.lit(0).alias("page"), F.lit("refusal").alias("structural_path"), F.lit(None).cast("string").alias("raw_text"), F.create_map(F.lit("code"), F.lit("E_ADAPTER_NONE")).alias("properties"), F.lit("none").alias("engine"))
    for name in sorted(READERS):
        out = out.unionByName(read(files.where(F.col(kind) == name).select("document_id", "content"), name).select(out.columns))
    return out


def _by_document(files: DataFrame, parse: Callable[[bytes], Iterator[Item]], engine: str) -> DataFrame:
    """Rows of a Python parser, a document at a time; one that can't be read, or takes too long, gives a row with its code and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, data in zip(b["document_id"], b["content"], strict=True):
                deadline = Deadline(engine)
                try:
                    rows = [r for r in parse(bytes(data)) if deadline.tick()]
                except DeadlineError as e:
                    rows = [(0, "refusal", None, {"code": "E_DEADLINE", "reason": str(e)})]
                except Exception as e:  # noqa: BLE001  whatever a damaged file makes a parser do, the other documents are read
                    rows = [(0, "refusal", None, {"code": "E_ADAPTER_FAILED", "reason": type(e).__name__})]
                yield pd.DataFrame([(doc, *r, engine) for r in rows], columns=["document_id", "page", "structural_path", "raw_text", "properties", "engine"])

    return files.select("document_id", "content").mapInPandas(run, OBJECT)


def _lines(files: DataFrame) -> DataFrame:
    text = F.decode("content", "UTF-8")
    return files.select("document_id", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("n", "line"))


def _objects(rows: DataFrame, engine: str, path, text, properties) -> DataFrame:
    return rows.select("document_id", F.lit(1).alias("page"), path.alias("structural_path"), text.alias("raw_text"), properties.alias("properties"), F.lit(engine).alias("engine"))


@register("text")
def text_lines(files: DataFrame) -> DataFrame:
    """One object for each line that isn't blank."""
    none = F.create_map().cast("map<string,string>")
    return _objects(_lines(files).where(F.trim("line") != ""), "text/1", F.concat(F.lit("line["), (F.col("n") + 1).cast("string"), F.lit("]")), F.col("line"), none)


@register("mt940")
def mt940(files: DataFrame) -> DataFrame:
    """Fields `:tag:`; lines that begin none continue the one before; `:20:` begins a message, told as the page."""
    rows = _lines(files).where("line <> '' AND line <> '-' AND NOT line LIKE '{%' AND NOT line LIKE '-}%'")
    tag = F.regexp_extract("line", r"^:([0-9]{2}[A-Z]?):", 1)
    w = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tag", tag).withColumn("field", F.sum((F.col("tag") != "").cast("int")).over(w)).withColumn("message", F.sum((F.col("tag") == "20").cast("int")).over(w))
    told = rows.where("field > 0").groupBy("document_id", "field").agg(
        F.max("message").alias("message"), F.max("tag").alias("tag"), F.min("n").alias("at"), F.count("*").alias("lines"),
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", F.regexp_replace("line", r"^:[0-9]{2}[A-Z]?:", "").alias("t")))), lambda s: s["t"])).alias("text"),
    )
    properties = F.create_map(F.lit("tag"), F.col("tag"), F.lit("file_line"), (F.col("at") + 1).cast("string"), F.lit("continuations"), (F.col("lines") - 1).cast("string"))
    path = F.concat(F.lit("message["), F.col("message").cast("string"), F.lit("]/field["), F.col("field").cast("string"), F.lit("]"))
    return _objects(told, "mt940/1", path, F.col("text"), properties).withColumn("page", F.lit(1))


@register("ofx")
def ofx(files: DataFrame) -> DataFrame:
    """Transactions (STMTTRN) of unclosed tags, each with all its tags in order of name."""
    text = F.decode("content", "UTF-8")
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|$)"), F.lit(1))
    rows = files.select("document_id", F.posexplode(blocks).alias("n", "block"))
    names, values = (F.regexp_extract_all("block", F.lit(r"(?i)<([A-Z0-9.]+)>([^<\r\n]*)"), F.lit(k)) for k in (1, 2))
    cells = F.array_sort(F.filter(F.arrays_zip(F.transform(names, lambda x: F.upper(x)).alias("k"), F.transform(values, lambda x: F.trim(x)).alias("v")), lambda e: e["v"] != ""))
    rows = rows.withColumn("cells", cells)
    shown = F.concat_ws(";", F.transform("cells", lambda e: F.concat(e["k"], F.lit("="), e["v"])))
    return _objects(rows, "ofx/1", F.concat(F.lit("transaction["), (F.col("n") + 1).cast("string"), F.lit("]")), shown, F.map_from_entries(F.array_distinct(F.col("cells"))))


def csv_cells(files: DataFrame, delimiter: str = ";", quote: str = '"', encoding: str = "utf-8", header: bool = True) -> DataFrame:
    """One object for each cell of an agreed profile; nothing is sniffed. Rows of another width are told as such."""

    def parse(data: bytes) -> Iterator[Item]:
        rows = csv.reader(io.StringIO(data.decode(encoding), newline=""), delimiter=delimiter, quotechar=quote)
        names = next(rows, None) if header else None
        for cells in rows:
            if not cells:
                continue
            width = "" if names is None or len(names) == len(cells) else str(len(cells))
            for k, text in enumerate(cells):
                name = names[k] if names and k < len(names) else ""
                yield 1, f"row[{rows.line_num}]/cell[{k + 1}]", text, {"column": str(k + 1), "header": name, "file_line": str(rows.line_num)} | ({"width": width} if width else {})

    return _by_document(files, parse, "csv/1")


register("csv")(csv_cells)


def _xml(data: bytes) -> ElementTree.Element:
    if re.search(rb"(?i)<!\s*(DOCTYPE|ENTITY)", data):
        raise ValueError("document types and entities aren't read")
    return ElementTree.fromstring(data)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _text(e: ElementTree.Element, *path: str) -> str | None:
    for name in path:
        e = next((x for x in e if _local(x) == name), None)
        if e is None:
            return None
    return (e.text or "").strip()


@register("camt053")
def camt053(files: DataFrame) -> DataFrame:
    """ISO 20022 statements: a header, balances and entries; amounts as written."""

    def money(e: ElementTree.Element) -> dict[str, str | None]:
        amount = next((x for x in e if _local(x) == "Amt"), None)
        return {"amount": None if amount is None else (amount.text or "").strip(), "currency": None if amount is None else amount.get("Ccy"), "mark": _text(e, "CdtDbtInd")}

    def parse(data: bytes) -> Iterator[Item]:
        for s, statement in enumerate(_all(_xml(data), "Stmt"), 1):
            head = {"kind": "header", "id": _text(statement, "Id"), "sequence": _text(statement, "ElctrncSeqNb"), "created": _text(statement, "CreDtTm"), "iban": _text(statement, "Acct", "Id", "IBAN"), "other": _text(statement, "Acct", "Id", "Othr", "Id"), "currency": _text(statement, "Acct", "Ccy")}
            found = [("header", head)]
            for n, b in enumerate((x for x in statement if _local(x) == "Bal"), 1):
                found.append((f"balance[{n}]", {"kind": "balance", "code": _text(b, "Tp", "CdOrPrtry", "Cd"), "date": _text(b, "Dt", "Dt") or _text(b, "Dt", "DtTm")} | money(b)))
            for n, e in enumerate((x for x in statement if _local(x) == "Ntry"), 1):
                found.append((f"entry[{n}]", {"kind": "entry", "status": _text(e, "Sts", "Cd") or _text(e, "Sts"), "booked": _text(e, "BookgDt", "Dt"), "valued": _text(e, "ValDt", "Dt"), "reference": _text(e, "NtryRef"), "bank_reference": _text(e, "AcctSvcrRef")} | money(e)))
            for path, cells in found:
                known = {k: v for k, v in cells.items() if v is not None}
                yield s, f"statement[{s}]/{path}", known.get("amount"), known

    return _by_document(files, parse, "camt053/1")


@register("xlsx")
def xlsx(files: DataFrame) -> DataFrame:
    """Cells as stored: type, raw value, formula, merges, and what is hidden."""

    def parse(data: bytes) -> Iterator[Item]:
        box = zipfile.ZipFile(io.BytesIO(data))
        names = set(box.namelist())
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(_xml(box.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in _all(_xml(box.read("xl/_rels/workbook.xml.rels")), "Relationship")}
        for page, sheet in enumerate(_all(_xml(box.read("xl/workbook.xml")), "sheet"), 1):
            target = next(links[v] for k, v in sheet.attrib.items() if k.endswith("}id")).lstrip("/")
            root = _xml(box.read(target if target.startswith("xl/") else f"xl/{target}"))
            merged = [m.get("ref") for m in _all(root, "mergeCell")]
            starts = {m.split(":")[0]: m for m in merged}
            for row in _all(root, "row"):
                for c in (x for x in row if _local(x) == "c"):
                    kind, value = c.get("t", "n"), _text(c, "v")
                    text = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else value
                    told = {"sheet": sheet.get("name"), "sheet_state": sheet.get("state", "visible"), "address": c.get("r"), "type": kind, "row_hidden": row.get("hidden", "0"), "formula": _text(c, "f"), "merge": starts.get(c.get("r")), "style": c.get("s")}
                    yield page, f"{sheet.get('name')}!{c.get('r')}", text, {k: v for k, v in told.items() if v is not None}

    return _by_document(files, parse, "xlsx/1")


@register("docx")
def docx(files: DataFrame) -> DataFrame:
    """Paragraphs, and cells of tables in order."""

    def parse(data: bytes) -> Iterator[Item]:
        body = next(_all(_xml(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")), "body"))
        said = lambda e: "".join(t.text or "" for t in _all(e, "t"))
        paragraphs = tables = 0
        for e in body:
            if _local(e) == "p":
                paragraphs += 1
                if said(e):
                    yield 1, f"paragraph[{paragraphs}]", said(e), {"kind": "paragraph"}
            elif _local(e) == "tbl":
                tables += 1
                for r, row in enumerate((x for x in e if _local(x) == "tr"), 1):
                    for c, cell in enumerate((x for x in row if _local(x) == "tc"), 1):
                        yield 1, f"table[{tables}]/row[{r}]/cell[{c}]", said(cell), {"kind": "cell"}

    return _by_document(files, parse, "docx/1")


@register("pdf")
def pdf(files: DataFrame) -> DataFrame:
    """Texts of each page with their place as shares of the page, and each page's text layer.

    A page without text is told as `scan`; one where most characters can't be
    told, as those of a composite font without a map to Unicode, as `unreadable`.
    """
    return _by_document(files, texts, "pdf/1")


#: Columns of the annotation form, in order; fixed values.
FORM = ("document", "page", "operation", "day", "month", "year", "date_basis", "amount", "side", "doubt", "unreadable", "note")


def annotation_form(files: DataFrame) -> DataFrame:
    """(document_id, file_line, form columns..., errors): rows of a form with exactly these columns; nothing is dropped."""
    names = ", ".join(f"{c} string" for c in FORM)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, data in zip(b["document_id"], b["content"], strict=True):
                rows = csv.reader(io.StringIO(bytes(data).decode("utf-8-sig"), newline=""), delimiter=";")
                head = next(rows, [])
                if tuple(h.strip() for h in head) != FORM:
                    out.append((doc, 1, *[None] * len(FORM), ["E_FORM_HEADER"]))
                    continue
                seen = set()
                for cells in rows:
                    if not cells:
                        continue
                    c = dict(zip(FORM, [*map(str.strip, cells), *[""] * len(FORM)], strict=False))
                    key = (c["document"], c["page"], c["operation"])
                    errors = [f"E_FORM_MISSING_{k.upper()}" for k in FORM[:3] if not c[k]] + ["E_FORM_WIDTH"] * (len(cells) != len(FORM)) + ["E_FORM_REPEATED"] * (key in seen)
                    errors += ["E_FORM_SIDE"] * (c["side"] not in ("", "debit", "credit"))
                    seen.add(key)
                    out.append((doc, rows.line_num, *(c[k] or None for k in FORM), errors))
            yield pd.DataFrame(out, columns=["document_id", "file_line", *FORM, "errors"])

    return files.select("document_id", "content").mapInPandas(run, f"document_id string, file_line int, {names}, errors array<string>")
