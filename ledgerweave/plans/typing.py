"""Typing of raw text: money, dates, vocabulary terms, text, warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import values as V
from ledgerweave.operators import provenance as P
from ledgerweave.operators import rules as R
from ledgerweave.plans.registry import Tables, query

MONEY = V.MoneyRules(decimal=",", group=" ", parentheses=True, currency="RUB", labels={"EUR": "EUR", "RUR": "RUB", "USD": "USD"})


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, l_linenumber % 7 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN k IN (5, 6) THEN NULL WHEN k IN (0, 2) THEN CAST(-a AS VARCHAR) ELSE CAST(a AS VARCHAR) END AS value,
           CASE WHEN k IN (5, 6) THEN NULL WHEN k = 3 THEN 'EUR' ELSE 'RUB' END AS currency,
           CASE k WHEN 5 THEN 'E_TYPE_NOT_A_NUMBER' WHEN 6 THEN 'E_TYPE_EMPTY' END AS refusal FROM l""")
def type_money(t: Tables):
    """Amounts written as a document would write them, read back; the oracle computes them from the stored numbers."""
    a = F.col("l_extendedprice").cast("decimal(18,2)")
    comma = F.replace(a.cast("string"), F.lit("."), F.lit(","))
    k = F.col("l_linenumber") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit("("), comma, F.lit(")"))).when(k == 2, F.concat(comma, F.lit("- "))).when(k == 3, F.concat(comma, F.lit(" eur")))
        .when(k == 4, F.concat(F.lit("+ "), F.regexp_replace(comma, "(\\d)(?=(\\d{3})+,)", "$1 "))).when(k == 5, F.concat(comma, F.lit(" kr"))).when(k == 6, "  ").otherwise(comma)
    )
    typed = V.with_money(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), raw, "m", MONEY)
    return typed.select("l_orderkey", "l_linenumber", "l_partkey", F.col("m.text").alias("value"), "m.currency", "m.refusal")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (2, 3, 4) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
           CASE o_orderkey % 10 WHEN 2 THEN 'E_TYPE_AMBIGUOUS_DATE' WHEN 3 THEN 'E_TYPE_DATE_INVALID' WHEN 4 THEN 'E_TYPE_NOT_A_DATE' END AS refusal,
           CASE WHEN o_orderkey % 10 IN (1, 3, 4) THEN false ELSE day(o_orderdate) <= 12 AND month(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) END AS ambiguous
    FROM orders""")
def type_date(t: Tables):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 10
    raw = F.when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "dd/MM/yy")).when(k == 3, "31.02.2024").when(k == 4, "soon").otherwise(F.date_format(d, "dd.MM.yyyy"))
    typed = t.orders.select("o_orderkey", V.date(raw, "DMY").alias("d"), V.ambiguous_date(raw).alias("ambiguous"))
    return typed.select("o_orderkey", F.col("d.value").cast("string").alias("value"), "d.refusal", "ambiguous")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(l_quantity AS BIGINT) AS q, l_partkey % 6 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, k, CASE k WHEN 0 THEN CAST(CAST(a / 10 AS DECIMAL(18,3)) AS VARCHAR) WHEN 1 THEN CAST(CAST(-a / 100 AS DECIMAL(18,4)) AS VARCHAR) WHEN 2 THEN q || '.005' WHEN 5 THEN CAST(q AS VARCHAR) END AS value,
           CASE k WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 5 THEN 0 END AS digits, CASE k WHEN 3 THEN 'E_TYPE_PRECISION' WHEN 4 THEN 'E_TYPE_PRECISION' END AS refusal FROM l""")
def type_exact_money(t: Tables):
    """Amounts of three, four and no digits after the point are kept as they are; those of seven, or of forty before it, are refused and never rounded."""
    a, k = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_partkey") % 6
    point = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    whole = F.col("l_quantity").cast("long").cast("string")
    raw = (
        F.when(k == 0, point((a / 10).cast("decimal(18,3)"))).when(k == 1, F.concat(F.lit("-"), point((a / 100).cast("decimal(18,4)")))).when(k == 2, F.concat(whole, F.lit(",005")))
        .when(k == 3, F.concat(whole, F.lit(",1234567"))).when(k == 4, F.concat(F.repeat(F.lit("9"), 40), F.lit(",5"))).otherwise(whole)
    )
    rules = V.MoneyRules(decimal=",", group=" ", implicit_cents=False, currency="RUB")
    typed = V.with_money(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", k.alias("k"), raw.alias("raw")), F.col("raw"), "m", rules)
    return typed.select("l_orderkey", "l_linenumber", "l_partkey", "k", F.col("m.text").alias("value"), "m.digits", "m.refusal")


@query("""
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS value,
           CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'E_TYPE_NOT_IN_VOCABULARY' END AS refusal FROM orders
    UNION ALL SELECT -o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN 'street' END, CASE WHEN o_orderkey % 5 = 3 THEN 'E_TYPE_EMPTY' WHEN o_orderkey % 5 = 4 THEN 'E_TYPE_NOT_IN_VOCABULARY' END FROM orders""")
def type_vocabulary(t: Tables):
    """A term outside the vocabulary is refused; terms are compared with their case folded: sharp s and SS, composed and decomposed letters."""
    terms = {"1-Urgent": "urgent", "2-high": "high", "3-medium": "medium", "5-low": "low", "Große  Straße": "street"}
    k = F.col("o_orderkey") % 5
    written = F.when(k == 0, "GROSSE STRASSE").when(k == 1, " große\tStraße").when(k == 2, "GROẞE Straße").when(k == 3, " ").otherwise("Grosse Gasse")
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("raw")).unionByName(t.orders.select((-F.col("o_orderkey")).alias("o_orderkey"), written.alias("raw")))
    return rows.select("o_orderkey", V.vocabulary_term(F.col("raw"), terms).alias("v")).select("o_orderkey", "v.value", "v.refusal")


@query("""
    WITH d AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t, nfc_normalize(text) <> text AS c FROM documents)
    SELECT doc_id, length(t) AS chars, sha256(t) AS text_sha256, c AS nfc_changed FROM d""")
def text_normalise(t: Tables):
    text = F.col("text")
    rows = t.documents.select("doc_id", V.normal_text(text).alias("t"), (V.nfc(text) != text).alias("nfc_changed"))
    return rows.select("doc_id", F.char_length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("text_sha256"), "nfc_changed")


@query("""
    WITH o AS (SELECT o_orderkey, o_orderdate, o_orderkey % 4 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
    w AS (
        SELECT 'date' AS field, 'ambiguous_date' AS kind, 'DMY' AS rule FROM o WHERE day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)
        UNION ALL SELECT 'amount', 'implicit_cents', 'declared' FROM o WHERE k = 0
        UNION ALL SELECT 'amount', 'parentheses_sign', 'declared' FROM o WHERE k = 1)
    SELECT 'kind' AS grouping, kind AS name, count(*) AS n FROM w GROUP BY kind
    UNION ALL SELECT 'field', field, count(*) FROM w GROUP BY field
    UNION ALL SELECT 'rule', rule, count(*) FROM w GROUP BY rule""")
def value_warnings_summary(t: Tables):
    """Warnings of each field, counted by kind, by field and by rule in one pass of grouping sets."""
    a = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.replace(a, F.lit("."))).when(k == 1, F.concat(F.lit("("), a, F.lit(")"))).otherwise(a)
    date = F.date_format("o_orderdate", "dd.MM.yyyy")
    warn = lambda when, field, kind, rule: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule")))
    found = F.array_compact(F.array(warn(V.ambiguous_date(date), "date", "ambiguous_date", "DMY"), warn(raw.rlike("^[0-9]+$"), "amount", "implicit_cents", "declared"), warn(raw.startswith("("), "amount", "parentheses_sign", "declared")))
    return P.warning_counts(t.orders.select(F.explode(found).alias("w")).select("w.*"))


@query("""
    WITH e AS (SELECT vec_id, label, least(greatest(CAST(embedding[1] AS DOUBLE), 0), 1) AS x, least(greatest(CAST(embedding[2] AS DOUBLE), 0), 1) AS y FROM embeddings),
    a AS (SELECT substr(sha256(concat_ws('|', 'page', label, printf('%.3f', round_even(CAST(x AS DECIMAL(18,9)), 3)), printf('%.3f', round_even(CAST(y AS DECIMAL(18,9)), 3)))), 1, 32) AS anchor_id, vec_id FROM e)
    SELECT anchor_id, count(*) AS objects, min(vec_id) AS first_object FROM a GROUP BY anchor_id HAVING count(*) > 1""")
def anchors_collisions(t: Tables):
    """Objects whose snapped places give one anchor id."""
    grid = lambda k: V.snapped(F.col("embedding")[k].cast("double")).cast("decimal(4,3)").cast("string")
    rows = t.embeddings.select("vec_id", F.substring(F.sha2(F.concat_ws("|", F.lit("page"), F.col("label").cast("string"), grid(0), grid(1)), 256), 1, 32).alias("anchor_id"))
    return P.anchor_collisions(rows, "anchor_id", "vec_id")


@query("""
    WITH a AS (SELECT l_orderkey % 500 AS k, l_partkey % 50 AS p FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_orderkey % 500 AS k, l_partkey % 50 AS p FROM lineitem WHERE l_linenumber >= 3)
    SELECT coalesce(x.k, y.k) AS document, coalesce(x.p, y.p) AS anchor, CASE WHEN x.k IS NULL THEN 'appeared' WHEN y.k IS NULL THEN 'vanished' ELSE 'survived' END AS fate
    FROM (SELECT DISTINCT * FROM a) x FULL JOIN (SELECT DISTINCT * FROM b) y ON x.k = y.k AND x.p = y.p""")
def anchors_diff(t: Tables):
    from ledgerweave.operators.compare import set_diff

    rows = t.lineitem.select((F.col("l_orderkey") % 500).alias("document"), (F.col("l_partkey") % 50).alias("anchor"), "l_linenumber")
    return set_diff(rows.where("l_linenumber <= 3").drop("l_linenumber"), rows.where("l_linenumber >= 3").drop("l_linenumber"), ["document", "anchor"])


@query("""
    WITH f AS (SELECT * FROM (VALUES ('french', 'lang="fr"', 'lang="xx"'), ('english', 'lang="en"', 'ref=x'), ('any', '<table', '<script src=')) v(family, yes, no)),
    m AS (SELECT page_id, family FROM pages, f WHERE contains(lower(html), yes) AND NOT contains(lower(html), no))
    SELECT p.page_id, count(m.family) AS families, CASE WHEN count(m.family) = 1 THEN min(m.family) END AS family, CASE WHEN count(m.family) = 0 THEN 'E_FAMILY_NONE' WHEN count(m.family) > 1 THEN 'E_FAMILY_SEVERAL' END AS refusal
    FROM pages p LEFT JOIN m ON m.page_id = p.page_id GROUP BY p.page_id""")
def family_recognition(t: Tables):
    """The one family whose markers a text has; none or several is refused. Families are declared: no join is needed."""
    from ledgerweave.operators.families import Family, choose_family

    declared = [Family("french", ['lang="fr"'], ['lang="xx"']), Family("english", ['lang="en"'], ["ref=x"]), Family("any", ["<table"], ["<script src="])]
    return t.pages.select("page_id", choose_family(F.col("html"), declared).alias("c")).select("page_id", "c.*")


@query("""
    SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 1, 0) AS VARCHAR) AS half_up,
           CAST(CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS VARCHAR) AS down, CAST(CAST(ceil(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS VARCHAR) AS up,
           CAST(CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS BIGINT) AS VARCHAR) AS half_even FROM orders""".replace("CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 1, 0) AS VARCHAR)", "CAST(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS BIGINT) AS VARCHAR)"))
def rounding_modes(t: Tables):
    a = F.col("o_totalprice").cast("decimal(18,2)")
    made = {m: V.rounded(a, 0, m).cast("long").cast("string").alias(m) for m in ("half_up", "down", "up", "half_even")}
    return t.orders.select("o_orderkey", *made.values())


@query("""
    SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def presence_rules(t: Tables):
    """F03's presence rule alone, over a field that a ninth of the records lack."""
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("raw"))
    out = R.apply_rules(rows, ["o_orderkey"], [R.Rule("presence", F.when(F.col("raw").isNull(), R.FAIL).otherwise(R.PASS))])
    return out.groupBy("status").agg(F.count("*").alias("n"))
