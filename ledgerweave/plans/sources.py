"""Sources and sinks over files that are built from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave import fixtures as X
from ledgerweave.plans.registry import Tables, query
from ledgerweave.sources import files as S
from ledgerweave.sources import readers as R
from ledgerweave.sources import store, workbook
from ledgerweave.work import new_path

MONEY = "decimal(18,2)"


def digest(c, name):
    return F.sha2(c, 256).alias(name)


@query("""
    WITH f AS (SELECT page_id % 40 AS k, CASE WHEN page_id % 40 = 7 THEN '' ELSE string_agg(coalesce(url, ''), ' ' ORDER BY page_id) || CASE WHEN page_id % 40 = 11 THEN ' ledgerweave-derived-result' WHEN page_id % 40 = 13 THEN repeat('x', 30000) ELSE '' END || chr(10) END AS t FROM pages GROUP BY page_id % 40),
    d AS (SELECT DISTINCT t FROM f)
    SELECT CASE WHEN strlen(t) > 20000 THEN NULL ELSE sha256(t) END AS document_id, strlen(t) AS size, CASE WHEN strlen(t) > 20000 THEN 'E_LIMIT_SIZE' WHEN t = '' THEN 'E_EMPTY_FILE' WHEN contains(t, 'ledgerweave-derived-result') THEN 'E_DERIVED_INPUT' ELSE '' END AS refusals FROM d""")
def files_accepted(t: Tables):
    """Files written to the shared folder and taken in: one is empty, one too large, one a result of our own.

    A file that is too large has no id that tells it from others of its size, so equal texts are one before they are written.
    """
    k, path = (F.col("page_id") % 40).alias("k"), new_path(t.spark, "intake")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("page_id", F.coalesce("url", F.lit("")).alias("u")))), lambda x: x["u"])
    text = F.array_join(lines, " ")
    own = t.pages.groupBy(k).agg(F.when(k == 11, F.concat(text, F.lit(" " + S.DERIVED_MARK))).when(k == 13, F.concat(text, F.repeat(F.lit("x"), 30000))).otherwise(text).alias("value"))
    own.where("k IS NULL OR k <> 7").dropDuplicates(["value"]).write.partitionBy("k").text(path)
    if not t.pages.where(F.col("page_id") % 40 == 7).isEmpty():
        S.put_bytes(t.spark, f"{path}/k=7/part-0.txt", b"")
    got = S.read_files(t.spark, path, S.Limits(file_bytes=20000))
    return got.select("document_id", "size", F.concat_ws(",", "refusals").alias("refusals"))


@query("""
    SELECT doc_id, CASE WHEN pages > 20 THEN 'E_LIMIT_PAGES' ELSE '' END || CASE WHEN doc_id % 4 <> 0 AND n_chars > 5000 THEN CASE WHEN pages > 20 THEN ',' ELSE '' END || 'E_LIMIT_CHARS' ELSE '' END AS refusals, CASE WHEN doc_id % 4 = 0 THEN 'chars' ELSE '' END AS unchecked
    FROM (SELECT *, n_chars // 100 AS pages FROM documents)""")
def limits_checked(t: Tables):
    """Measured values against limits; what wasn't measured stays unchecked."""
    rows = t.documents.select("doc_id", F.expr("n_chars div 100").alias("pages"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("chars"))
    told = rows.select("doc_id", S.check_limits({"pages": (F.col("pages"), 20), "chars": (F.col("chars"), 5000)}).alias("c"))
    return told.select("doc_id", F.concat_ws(",", "c.refusals").alias("refusals"), F.concat_ws(",", "c.unchecked").alias("unchecked"))


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey || '.csv' WHEN 1 THEN '_CON.' || p_partkey WHEN 2 THEN 'unnamed' WHEN 3 THEN 'a_b_' || p_partkey || '.pdf' WHEN 4 THEN repeat('n', 120) ELSE 'x_' || p_partkey END AS name FROM part""")
def names_safe(t: Tables):
    """Names with a path, a device's name, nothing, signs that file systems keep, 300 characters, controls."""
    k, own = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("../../etc\\up/"), own, F.lit(".csv"))).when(k == 1, F.concat(F.lit("CON."), own)).when(k == 2, " .. ")
        .when(k == 3, F.concat(F.lit(" .a<b>"), own, F.lit(".pdf. "))).when(k == 4, F.repeat(F.lit("n"), 300)).otherwise(F.concat(F.lit("x\x07"), own))
    )
    return t.part.select("p_partkey", S.safe_name(raw).alias("name"))


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS document_id, CASE p_partkey % 8 WHEN 1 THEN 'E_ARCHIVE_TRAVERSAL' WHEN 2 THEN 'E_ARCHIVE_SYMLINK' WHEN 3 THEN 'E_ARCHIVE_ENCRYPTED' WHEN 4 THEN 'E_MACRO' WHEN 5 THEN 'E_ARCHIVE_BOMB' WHEN 6 THEN 'E_ARCHIVE_DEPTH' WHEN 7 THEN 'E_ARCHIVE_DAMAGED' ELSE '' END AS codes FROM part""")
def archives_inspected(t: Tables):
    """An archive for each part, with each kind of fault."""
    return S.inspect_archives(X.faulty_archives(t.part, "p_partkey")).select("document_id", F.concat_ws(",", "codes").alias("codes"))


@query("""
    SELECT kind, codes, count(*) AS n FROM (
        SELECT 'zip' AS kind, CASE p_partkey % 8 WHEN 1 THEN 'E_ARCHIVE_TRAVERSAL' WHEN 2 THEN 'E_ARCHIVE_SYMLINK' WHEN 3 THEN 'E_POLICY_ENCRYPTED' WHEN 4 THEN 'E_POLICY_MACROS' WHEN 5 THEN 'E_ARCHIVE_BOMB' WHEN 6 THEN 'E_ARCHIVE_DEPTH' WHEN 7 THEN 'E_POLICY_BROKEN' ELSE '' END AS codes FROM part
        UNION ALL SELECT CASE s_suppkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pdf' ELSE 'text' END, CASE s_suppkey % 4 WHEN 1 THEN 'E_POLICY_BROKEN' WHEN 2 THEN 'E_POLICY_ENCRYPTED' WHEN 3 THEN 'E_POLICY_BROKEN' ELSE '' END FROM supplier) GROUP BY ALL""")
def policy_applied(t: Tables):
    """Archives, and PDF that are whole, cut off, locked, or empty files."""
    k = F.col("s_suppkey") % 4
    body = F.when(k == 0, "%PDF-1.4 x %%EOF").when(k == 1, "%PDF-1.4 x").when(k == 2, "%PDF-1.4 /Encrypt 1 0 R %%EOF").otherwise("")
    plain = t.supplier.select(F.col("s_suppkey").cast("string").alias("document_id"), body.cast("binary").alias("content"))
    told = S.apply_policy(X.faulty_archives(t.part, "p_partkey").unionByName(plain))
    return told.groupBy("kind", F.concat_ws(",", "codes").alias("codes")).agg(F.count("*").alias("n"))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS document_id, count_if(trim(l, ' ') <> '') AS objects, sha256(string_agg('line[' || n || ']' || l, '|' ORDER BY n) FILTER (trim(l, ' ') <> '')) AS digest FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS l, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS n FROM documents) GROUP BY 1 HAVING objects > 0""")
def text_read(t: Tables):
    """Every document as a text file: an object for each line that isn't blank."""
    plain = t.documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").cast("binary").alias("content"))
    rows = R.read(plain, "text").withColumn("n", F.regexp_extract("structural_path", r"\[(\d+)\]", 1).cast("int"))
    told = F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat("structural_path", "raw_text").alias("x")))), lambda e: e["x"])
    return rows.groupBy("document_id").agg(F.count("*").alias("objects"), digest(F.array_join(told, "|"), "digest"))


def _orders(t: Tables):
    return t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").cast(MONEY).cast("string").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus", "o_orderpriority")


AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"


@query(f"""
    SELECT CAST(o_custkey AS VARCHAR) AS document_id, o_orderkey AS reference, {AMOUNT} AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN o_orderstatus = 'F' THEN 'DBIT' ELSE 'CRDT' END AS mark, strftime(o_orderdate, '%Y-%m-%d') AS booked,
           'S' || o_custkey AS statement, 'EUR' AS account_currency FROM orders""")
def camt053_read(t: Tables):
    """A statement for each customer, an entry for each order; entries beside their statement's header."""
    o = _orders(t)
    entry = F.concat(
        F.lit("<Ntry><NtryRef>"), F.col("o_orderkey").cast("string"), F.lit('</NtryRef><Amt Ccy="'), F.when(F.col("o_orderkey") % 3 == 0, "USD").otherwise("EUR"), F.lit('">'), F.col("amount"),
        F.lit("</Amt><CdtDbtInd>"), F.when(F.col("o_orderstatus") == "F", "DBIT").otherwise("CRDT"), F.lit("</CdtDbtInd><BookgDt><Dt>"), F.col("day"), F.lit("</Dt></BookgDt></Ntry>"),
    )
    head = F.concat(F.lit('<Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt><Id>S'), F.col("document_id"), F.lit("</Id><Acct><Ccy>EUR</Ccy></Acct>"))
    rows = R.read(X.text_files(o, F.col("o_custkey"), ["o_orderkey"], entry, head, F.lit("</Stmt></BkToCstmrStmt></Document>")), "camt053")
    p = lambda k: F.col("properties")[k]
    heads = rows.where(p("kind") == "header").select("document_id", p("id").alias("statement"), p("currency").alias("account_currency"))
    entries = rows.where(p("kind") == "entry").select("document_id", p("reference").cast("long").alias("reference"), F.col("raw_text").alias("amount"), p("currency").alias("currency"), p("mark").alias("mark"), p("booked").alias("booked"))
    return entries.join(heads, "document_id")


@query(f"""
    SELECT CAST(o_custkey AS VARCHAR) AS document_id, '61' AS tag, strftime(o_orderdate, '%y%m%d') || CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'C' END || replace({AMOUNT}, '.', ',') || 'NTRF' AS text, 0 AS continuations FROM orders
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), '86', o_orderpriority || chr(10) || 'order ' || o_orderkey, 1 FROM orders UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), '20', 'REF' || o_custkey, 0 FROM orders""")
def mt940_read(t: Tables):
    """A message for each customer: a reference, and a statement line with its two lines of information for each order."""
    o = _orders(t)
    line = F.concat(F.lit(":61:"), F.substring(F.translate("day", "-", ""), 3, 6), F.when(F.col("o_orderstatus") == "F", "D").otherwise("C"), F.replace("amount", F.lit("."), F.lit(",")), F.lit("NTRF\n:86:"), F.col("o_orderpriority"), F.lit("\norder "), F.col("o_orderkey").cast("string"))
    rows = R.read(X.text_files(o, F.col("o_custkey"), ["o_orderkey"], line, F.concat(F.lit("{1:F01}\n:20:REF"), F.col("document_id"), F.lit("\n")), F.lit("\n-}\n")), "mt940")
    return rows.select("document_id", F.col("properties")["tag"].alias("tag"), F.col("raw_text").alias("text"), F.col("properties")["continuations"].cast("int").alias("continuations"))


@query(f"""
    SELECT CAST(o_custkey AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n, CAST(o_orderkey AS VARCHAR) AS id, {AMOUNT} AS amount, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS name FROM orders""")
def ofx_read(t: Tables):
    """Unclosed tags: a transaction for each order, some without a name."""
    name = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("\n<NAME>"), F.col("o_orderpriority"))).otherwise("")
    block = F.concat(F.lit("<STMTTRN>\n<TRNAMT>"), F.col("amount"), F.lit("\n<FITID>"), F.col("o_orderkey").cast("string"), name, F.lit("\n</STMTTRN>"))
    rows = R.read(X.text_files(_orders(t), F.col("o_custkey"), ["o_orderkey"], block, F.lit("OFXHEADER:100\n<OFX><BANKTRANLIST>"), F.lit("</BANKTRANLIST></OFX>")), "ofx")
    p = lambda k: F.col("properties")[k]
    return rows.select("document_id", F.regexp_extract("structural_path", r"\[(\d+)\]", 1).cast("int").alias("n"), p("FITID").alias("id"), p("TRNAMT").alias("amount"), p("NAME").alias("name"))


@query("""
    WITH c AS (SELECT c_nationkey, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
    SELECT CAST(c_nationkey AS VARCHAR) AS document_id, CAST(n + 1 AS INT) AS file_line, h AS header, v AS text, h = '' AS extra FROM (
        SELECT *, unnest(['key', 'name', 'segment', '']) AS h, unnest([CAST(c_custkey AS VARCHAR), 'a "quoted"; ' || c_name, c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 'more' END]) AS v FROM c) WHERE v IS NOT NULL""")
def csv_read(t: Tables):
    """The agreed form with quotes and delimiters inside cells; some rows are a cell too wide."""
    name = F.concat(F.lit('"a ""quoted""; '), F.col("c_name"), F.lit('"'))
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), name, "c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "more"))
    rows = R.read(X.text_files(t.customer, F.col("c_nationkey"), ["c_custkey"], line, F.lit("key;name;segment\n"), F.lit("\n")), "csv")
    p = lambda k: F.col("properties")[k]
    return rows.select("document_id", p("file_line").cast("int").alias("file_line"), p("header").alias("header"), F.col("raw_text").alias("text"), (p("header") == "").alias("extra"))


def _table_cells():
    return [F.col("c_custkey"), F.col("c_name"), F.concat(F.col("c_mktsegment"), F.lit(" & <é>"))]


CELLS = """
    WITH c AS (SELECT c_nationkey AS d, [CAST(c_custkey AS VARCHAR), c_name, c_mktsegment || ' & <é>'] AS cells, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), x AS (SELECT d, n, unnest(cells) AS text, unnest([1, 2, 3]) AS k FROM c)
"""


@query(CELLS + "SELECT CAST(d AS VARCHAR) AS document_id, 'S!' || chr(CAST(64 + k AS INT)) || n AS place, text FROM x")
def xlsx_read(t: Tables):
    """A workbook for each nation, with shared strings."""
    rows = R.read(X.table_files(t.customer, F.col("c_nationkey"), ["c_custkey"], _table_cells(), "xlsx"), "xlsx")
    return rows.select("document_id", F.col("structural_path").alias("place"), F.col("raw_text").alias("text"))


@query(CELLS + "SELECT CAST(d AS VARCHAR) AS document_id, CASE WHEN n = 1 THEN 'paragraph[' || k || ']' ELSE 'table[1]/row[' || (n - 1) || ']/cell[' || k || ']' END AS place, text FROM x")
def docx_read(t: Tables):
    """A text document for each nation: paragraphs and a table."""
    rows = R.read(X.table_files(t.customer, F.col("c_nationkey"), ["c_custkey"], _table_cells(), "docx"), "docx")
    return rows.select("document_id", F.col("structural_path").alias("place"), F.col("raw_text").alias("text"))


@query(CELLS + """
    SELECT CAST(d AS VARCHAR) AS document_id, CAST((n - 1) // 40 + 1 AS INT) AS page, 'text' AS kind, text, printf('%.3f', 0.1 + 0.2 * (k - 1)) AS x, printf('%.3f', (960 - 20 * ((n - 1) % 40)) / 1000.0) AS y FROM x
    UNION ALL SELECT DISTINCT CAST(d AS VARCHAR), CAST((n - 1) // 40 + 1 AS INT), 'readable', NULL, NULL, NULL FROM x""")
def pdf_read(t: Tables):
    """A PDF for each nation: a composite font with a map to Unicode, boxes inherited from the page tree, packed streams, a page that was revised."""
    rows = R.read(X.table_files(t.customer, F.col("c_nationkey"), ["c_custkey"], _table_cells(), "pdf"), "pdf")
    p = lambda k: F.col("properties")[k]
    return rows.select("document_id", "page", F.coalesce(p("layer"), p("kind")).alias("kind"), F.col("raw_text").alias("text"), p("x").alias("x"), p("y").alias("y"))


@query("""
    SELECT engine, count(*) AS objects, count(DISTINCT d) AS documents FROM (
        SELECT 'csv/1' AS engine, c_nationkey AS d FROM customer, (VALUES (1), (2)) WHERE c_nationkey % 4 = 0 UNION ALL SELECT 'mt940/1', c_nationkey FROM customer WHERE c_nationkey % 4 = 1 UNION ALL
        SELECT 'ofx/1', c_nationkey FROM customer WHERE c_nationkey % 4 = 2 UNION ALL SELECT 'text/1', c_nationkey FROM customer WHERE c_nationkey % 4 = 3) GROUP BY 1""")
def formats_read(t: Tables):
    """Files of several formats in one table, each read by the reader that its format is registered with."""
    own, k = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 4
    line = F.when(k == 0, F.concat(own, F.lit(";x"))).when(k == 1, F.concat(F.lit(":61:"), own)).when(k == 2, F.concat(F.lit("<STMTTRN><FITID>"), own, F.lit("</STMTTRN>"))).otherwise(own)
    files = X.text_files(t.customer.where("c_nationkey % 4 <> 0"), F.col("c_nationkey"), ["c_custkey"], line).unionByName(X.text_files(t.customer.where("c_nationkey % 4 = 0"), F.col("c_nationkey"), ["c_custkey"], line, F.lit("k;v\n")))
    kind = F.element_at(F.array(*map(F.lit, ("csv", "mt940", "ofx", "text"))), (F.col("document_id").cast("int") % 4 + 1))
    return R.read_all(files.withColumn("kind", kind)).groupBy("engine").agg(F.count("*").alias("objects"), F.count_distinct("document_id").alias("documents"))


@query("""
    WITH b AS (SELECT 'lang-' || coalesce(lang, '') AS shelf, 'd' || (doc_id % 200) AS name, coalesce(text, '') AS text, doc_id FROM documents), f AS (SELECT shelf, name, max(sha256(text)) AS h FROM b GROUP BY 1, 2),
    s AS (SELECT shelf, name, max(sha256(text || '!')) AS h FROM b WHERE doc_id % 3 = 0 GROUP BY 1, 2)
    SELECT f.shelf, f.name, coalesce(s.h, f.h) AS document_id, CASE WHEN s.h IS NULL THEN 1 ELSE 2 END::BIGINT AS version FROM f LEFT JOIN s ON s.shelf = f.shelf AND s.name = f.name""")
def store_saved(t: Tables):
    """Blobs saved to a store, then those that changed, then nothing new; restored with their content checked."""
    blobs = t.documents.select(F.concat(F.lit("lang-"), F.coalesce("lang", F.lit(""))).alias("shelf"), F.concat(F.lit("d"), (F.col("doc_id") % 200).cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    box = store.BlobStore(t.spark, new_path(t.spark, "store"))
    box.save(blobs.select("shelf", "name", F.col("text").cast("binary").alias("content")))
    changed = blobs.where("doc_id % 3 = 0").select("shelf", "name", F.concat("text", F.lit("!")).cast("binary").alias("content"))
    box.save(changed)
    if box.save(box.restore().select("shelf", "name", "content")):
        raise store.StoreError("a restored blob was sent again")
    return box.restore().select("shelf", "name", "document_id", F.sha2("content", 256).alias("found")).join(box.listed(), ["shelf", "name", "document_id"]).where("found = document_id").select("shelf", "name", "document_id", "version")


@query(r"""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE regexp_matches(coalesce(html, ''), '(?i)<!\s*(DOCTYPE|ENTITY)') END AS unsafe FROM pages""")
def xml_safety(t: Tables):
    """Pages as they are, and with a document type or an entity put in."""
    k, html = F.col("page_id") % 4, F.coalesce("html", F.lit(""))
    return t.pages.select("page_id", S.unsafe_xml(F.when(k == 0, F.concat(F.lit("<!doctype a>"), html)).when(k == 1, F.concat(html, F.lit("<! ENTITY x 'y'>"))).otherwise(html)).alias("unsafe"))


@query("""
    SELECT event_id, event_id % 7 IN (0, 1, 2, 3) AS formula, event_id % 5 IN (0, 3) AS long FROM events""")
def cell_guards(t: Tables):
    """Texts that a spreadsheet would take for formulas, and numbers with more digits than it keeps."""
    k, d, own = F.col("event_id") % 7, F.col("event_id") % 5, F.col("event_type")
    cell = F.concat(F.when(k == 0, "=").when(k == 1, "@").when(k == 2, "-").when(k == 3, "\t").when(k == 4, " =").otherwise(""), own)
    number = F.when(d == 0, "1234567890.123456").when(d == 1, "-0.000000123456789").when(d == 2, "123456789012345").when(d == 3, "0001000000000000000").otherwise("12.50")
    return t.events.select("event_id", S.formula_like(cell).alias("formula"), S.too_many_digits(number).alias("long"))


@query(r"""
    WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) + 1 AS l FROM n)
    SELECT 'DATA!A' || l AS place, CAST(n_nationkey AS VARCHAR) AS text, 'n' AS type FROM r UNION ALL SELECT 'DATA!B' || l, CASE WHEN n_nationkey % 2 = 0 THEN chr(39) || '=' ELSE '' END || n_name, 'inlineStr' FROM r
    UNION ALL SELECT 'DATA!C' || l, CASE WHEN n_nationkey % 3 = 0 THEN '12345678901234567.' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') ELSE n_nationkey || '.25' END, CASE WHEN n_nationkey % 3 = 0 THEN 'inlineStr' ELSE 'n' END FROM r
    UNION ALL SELECT 'DATA!' || c || '1', v, 'inlineStr' FROM (VALUES ('A', 'key'), ('B', 'name'), ('C', 'amount')) x(c, v) UNION ALL SELECT 'AUDIT!A1', 'n', 'inlineStr' UNION ALL SELECT 'AUDIT!A2', CAST(count(*) AS VARCHAR), 'n' FROM nation""")
def workbook_read_back(t: Tables):
    """Nations as a workbook in the shared folder, read back: exact numbers, long ones as text, formulas guarded; it is refused as an input."""
    k, path = F.col("n_nationkey"), new_path(t.spark, "book")
    long = F.concat(F.lit("12345678901234567."), F.lpad(k.cast("string"), 2, "0")).cast("decimal(20,2)")
    rows = t.nation.orderBy(k).select(k.alias("key"), F.concat(F.when(k % 2 == 0, "=").otherwise(""), "n_name").alias("name"), F.when(k % 3 == 0, long).otherwise((k + F.lit("0.25").cast("decimal(3,2)")).cast("decimal(20,2)")).alias("amount"))
    workbook.save_workbook({"DATA": rows, "AUDIT": t.nation.agg(F.count("*").alias("n"))}, f"{path}/book.xlsx")
    got = S.read_files(t.spark, f"{path}/book.xlsx")
    cells = R.read(got.where(F.array_contains("refusals", "E_DERIVED_INPUT")), "xlsx")
    return cells.select(F.col("structural_path").alias("place"), F.col("raw_text").alias("text"), F.col("properties")["type"].alias("type"))


@query("""
    SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 2 = 0 AS flag, o_orderpriority AS tag FROM orders""")
def run_loaded(t: Tables):
    """A run's entities saved and loaded with their types: decimals, dates, flags, lists."""
    path = new_path(t.spark, "run")
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("amount"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("flag"), F.array("o_orderpriority").alias("tags"))
    store.save_run({"records": rows, "nations": t.nation}, path)
    got = store.load_run(t.spark, path)["records"]
    return got.select("o_orderkey", F.col("amount").cast("string").alias("amount"), F.col("day").cast("string").alias("day"), "flag", F.col("tags")[0].alias("tag"))


@query("""
    WITH d AS (SELECT o_custkey AS batch, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DATA' WHEN o_orderstatus = 'O' THEN 'REVIEW' ELSE 'REJECTED' END AS sheet FROM orders), g AS (SELECT batch, CASE WHEN batch % 7 = 0 THEN NULL WHEN count_if(sheet = 'REVIEW') = 0 AND count_if(sheet = 'DATA') > 0 THEN 'open' ELSE 'closed' END AS gate FROM d GROUP BY 1)
    SELECT 'client' AS book, d.batch, o_orderkey, 'open' AS gate FROM d JOIN g ON g.batch = d.batch WHERE gate = 'open' AND sheet = 'DATA' UNION ALL SELECT 'control', d.batch, o_orderkey, coalesce(gate, 'closed') FROM d JOIN g ON g.batch = d.batch""")
def books_released(t: Tables):
    """The client's rows and the control rows of each customer's orders; some batches have no gate."""
    sheet = F.when(F.col("o_orderstatus") == "F", "DATA").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("REJECTED")
    rows = t.orders.select(F.col("o_custkey").alias("batch"), "o_orderkey", sheet.alias("sheet"))
    gates = rows.groupBy("batch").agg(F.when((F.count_if(F.col("sheet") == "REVIEW") == 0) & (F.count_if(F.col("sheet") == "DATA") > 0), "open").otherwise("closed").alias("gate")).where("batch % 7 <> 0")
    client, control = workbook.release(rows, gates, ["batch"])
    return client.select(F.lit("client").alias("book"), "batch", "o_orderkey", F.lit("open").alias("gate")).unionByName(control.select(F.lit("control").alias("book"), "batch", "o_orderkey", "gate"))


@query("""
    WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_custkey % 5 AS k FROM customer)
    SELECT CAST(c_nationkey AS VARCHAR) AS document_id, CAST(n + 1 AS INT) AS file_line, CASE WHEN k <> 1 THEN CAST(c_custkey AS VARCHAR) END AS operation, CASE k WHEN 1 THEN 'E_FORM_MISSING_OPERATION' WHEN 2 THEN 'E_FORM_SIDE' WHEN 3 THEN 'E_FORM_WIDTH' ELSE '' END AS errors FROM c WHERE c_nationkey <> 3
    UNION ALL SELECT '3', 1, NULL, 'E_FORM_HEADER'""")
def form_read(t: Tables):
    """Annotation forms: missing keys, an unknown side, a row of another width, one file with another header."""
    k = F.col("c_custkey") % 5
    line = F.when(k == 1, F.concat(F.lit("d;"), (F.col("c_custkey") + 1000).cast("string"), F.lit("; ;01;02;2024;;1,50;debit;;;"))).otherwise(F.concat(F.lit("d;1;"), F.col("c_custkey").cast("string"), F.lit(";01;02;2024;;1,50;"), F.when(k == 2, "both").otherwise("debit"), F.lit(";;;"), F.when(k == 3, ";more").otherwise("")))
    head = F.when(F.col("document_id") == "3", "a;b\n").otherwise(";".join(R.FORM) + "\n")
    rows = R.annotation_form(X.text_files(t.customer, F.col("c_nationkey"), ["c_custkey"], line, head, F.lit("\n")))
    return rows.select("document_id", "file_line", "operation", F.concat_ws(",", "errors").alias("errors"))


PACKAGE = (
    '{"identification":{"family":"f@","issuer":"i","form_version":"1","languages":["en"],"positive_markers":["m"],"negative_markers":[]},"schema":{"fields":[{"name":"a","type":"money","required":true}]},'
    '"addressing":{"tables":[],"continuation":null,"record_boundary":null,"columns":[],"requisites":[]},"normalisation":{"date_order":"DMY","decimal_separator":",","group_separator":" ","currency":"RUB"},"coverage":{"expected":[],"allowed_exclusions":[]},'
    '"checks":{"totals":[],"cross_field":[],"order":null,"sequence":null,"duplicates":null},"risk":{"critical_fields":[],"class":"low"},"admission":{"required_rules":[],"thresholds":{}},"versioning":{"owner":"o","approved":"2024-01-01","rollback":null,"min_core":"#"}}'
)


@query(f"""
    WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 AS m, replace(replace('{PACKAGE}', '@', CAST(s_suppkey AS VARCHAR)), '#', CASE WHEN s_suppkey % 5 = 1 THEN '9.0' ELSE '1.0' END) AS t FROM supplier),
    b AS (SELECT *, CASE m WHEN 2 THEN replace(t, 'money', 'guess') WHEN 3 THEN replace(t, '"risk"', '"script"') WHEN 4 THEN substr(t, 1, 100) ELSE t END AS body FROM s)
    SELECT CAST(k AS VARCHAR) AS document_id, CASE WHEN m = 0 THEN 'f' || k END AS family, sha256(body) AS fingerprint, CASE m WHEN 1 THEN 'E_PACKAGE_CORE' WHEN 2 THEN 'E_SPEC_FIELD' WHEN 3 THEN 'E_SPEC_GROUP_MISSING' WHEN 4 THEN 'E_PACKAGE_DAMAGED' END AS refusal FROM b""")
def packages_inspected(t: Tables):
    """A package for each supplier: sound, for a later core, with an unknown type, with code in place of a group, cut off."""
    m = F.col("s_suppkey") % 5
    text = F.replace(F.replace(F.lit(PACKAGE), F.lit("@"), F.col("s_suppkey").cast("string")), F.lit("#"), F.when(m == 1, "9.0").otherwise("1.0"))
    body = F.when(m == 2, F.replace(text, F.lit("money"), F.lit("guess"))).when(m == 3, F.replace(text, F.lit('"risk"'), F.lit('"script"'))).when(m == 4, F.substring(text, 1, 100)).otherwise(text)
    return store.inspect_packages(t.supplier.select(F.col("s_suppkey").cast("string").alias("document_id"), body.cast("binary").alias("content")))
