"""Provenance, dossiers, approvals, and the training document with its corruptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave import fixtures
from ledgerweave.functions import values as V
from ledgerweave.operators import provenance as P
from ledgerweave.operators import rules as R
from ledgerweave.plans.registry import Tables, query


@query("""
    WITH e AS (SELECT user_id AS d, event_id, [event_id % 20, event_id % 20 + 1] AS a, event_type FROM events), x AS (SELECT d, unnest(a) AS a, event_id, event_type FROM e)
    SELECT r.d || '-' || r.a AS record_id, arg_max(event_type, event_id) AS action FROM (SELECT DISTINCT d, a FROM x WHERE a % 3 = 0) r JOIN x ON x.d = r.d AND x.a IN (r.a, r.a + 1) GROUP BY 1""")
def prior_decisions(t: Tables):
    """Decisions by anchors, found again for records that were read anew."""
    k = F.col("event_id") % 20
    told = t.events.select(F.col("user_id").alias("document_id"), F.array(k, k + 1).alias("anchors"), F.col("event_type").alias("action"), F.lit("x").alias("operator"), "event_id")
    a = told.select("document_id", F.explode("anchors").alias("a")).where("a % 3 = 0").distinct()
    now = a.select("document_id", F.concat_ws("-", "document_id", "a").alias("record_id"), F.array("a", F.col("a") + 1).alias("anchors"))
    return P.prior_decisions(told, now, ["event_id"]).select("record_id", "action")


@query("""
    WITH o AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM orders), n AS (SELECT l_orderkey, count(*) AS n, count_if(l_discount <= 0.05) AS p FROM lineitem GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS record_id, i.item, CASE i.item WHEN 'document' THEN 'd' || o_custkey WHEN 'page' THEN CAST(o_orderkey % 7 AS VARCHAR) WHEN 'place' THEN 'unknown' WHEN 'raw' THEN v WHEN 'rule' THEN 'money' WHEN 'value' THEN v
        WHEN 'checks' THEN coalesce(p || ' of ' || n, 'unknown') WHEN 'decision' THEN o_orderstatus ELSE 'unknown' END AS text
    FROM o LEFT JOIN n ON l_orderkey = o_orderkey, (VALUES ('document'), ('page'), ('place'), ('raw'), ('rule'), ('value'), ('checks'), ('decision'), ('history')) i(item)""")
def nine_items(t: Tables):
    v = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    own = t.orders.withColumn("record_id", F.col("o_orderkey").cast("string"))
    fields = own.select("record_id", F.lit("amount").alias("field"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("document"), (F.col("o_orderkey") % 7).alias("page"), F.lit(None).cast("string").alias("place"), v.alias("raw"), F.lit("money").alias("rule"), v.alias("value"))
    checks = t.lineitem.select(F.col("l_orderkey").cast("string").alias("record_id"), F.when(F.col("l_discount") <= 0.05, "PASS").otherwise("FAIL").alias("status"))
    return P.nine_items(fields, checks, own.select("record_id", F.col("o_orderstatus").alias("status")), own.limit(0).select("record_id", F.lit("x").alias("action"))).select("record_id", "item", "text")


@query("""
    SELECT c.claim, coalesce(n > 0 AND n = p, false) AS supported, coalesce(n, 0) AS evidence FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NOTHING')) c(claim)
    LEFT JOIN (SELECT c_mktsegment AS claim, count(*) AS n, count_if(c_mktsegment = 'BUILDING' OR c_custkey % 9 <> 0) AS p FROM customer GROUP BY 1) s ON s.claim = c.claim""")
def dossier(t: Tables):
    claims = t.spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NOTHING",)], "claim string")
    fine = (F.col("c_mktsegment") == "BUILDING") | (F.col("c_custkey") % 9 != 0)
    return P.dossier(claims, t.customer.select(F.col("c_mktsegment").alias("claim"), F.when(fine, "PASS").otherwise("FAIL").alias("status")))


@query("""
    SELECT p_brand AS template, count_if(p_size > 48 AND p_partkey % 5 = 0) = 0 AS approved, count_if(p_size > 48 AND p_partkey % 5 = 0) AS unresolved FROM part GROUP BY 1""")
def template_approval(t: Tables):
    state = F.when((F.col("p_size") > 48) & (F.col("p_partkey") % 5 == 0), "to_decide").otherwise("matched")
    return P.approval(t.part.select(F.col("p_brand").alias("template"), state.alias("state")), ["template"])


@query("SELECT o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 1")
def library_counts(t: Tables):
    return P.library_counts(t.orders.select(F.col("o_orderstatus").alias("level")), "level")


@query("""
    SELECT source, count(*) AS rows, count_if(quality = 1) AS sound, count_if(toxic = 1) AS doubtful FROM labels JOIN documents ON documents.doc_id = labels.doc_id GROUP BY 1""")
def form_summary(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", F.when(F.col("quality") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("E"))).alias("errors"), F.when(F.col("toxic") == 1, "doubt").alias("doubt"))
    return P.form_summary(rows, ["source"])


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n, string_agg(DISTINCT 'amount = ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ': d' || l_orderkey || ', page ' || l_linenumber || ', ' || CASE WHEN l_partkey % 4 = 0 THEN 'no address' ELSE 'cell' END || ', by money', ';' ORDER BY 'amount = ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ': d' || l_orderkey || ', page ' || l_linenumber || ', ' || CASE WHEN l_partkey % 4 = 0 THEN 'no address' ELSE 'cell' END || ', by money') AS trail
    FROM lineitem GROUP BY 1, 2""")
def evidence_trail(t: Tables):
    """Each value's evidence, and where it comes from in one line."""
    from ledgerweave.operators.governance import trail

    value = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    fields = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("amount").alias("field"), value.alias("raw"), value.alias("value"), F.when(F.col("l_partkey") % 4 != 0, "cell").alias("address"), F.lit("money").alias("rule"))
    seen = P.evidence(fields, ["l_orderkey", "l_linenumber"])
    line = trail(F.col("field"), F.col("value"), F.concat(F.lit("d"), F.col("l_orderkey").cast("string")), F.col("l_linenumber"), F.col("address"), F.col("rule"))
    told = seen.withColumn("line", line).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.concat_ws(";", F.array_sort(F.collect_set("line"))).alias("trail"))
    return told


MONEY = V.MoneyRules(decimal=",", group=" ", currency="RUB")


def checked(documents):
    """What the rules find in documents by kind: unreadable amounts, repeats, gaps, cells outside their band, pages that need a second reading."""
    typed = V.with_money(documents, F.col("amount_raw"), "amount", MONEY)
    repeats = R.parse_duplicates(typed, ["kind", "number"]).groupBy("kind").agg(F.count_if(F.col("status") == "FAIL").alias("repeated"))
    gaps = R.gap_check(typed, ["kind"], "number", "forbidden").select("kind", "missing")
    pages = F.count_distinct(F.when((F.col("layer") == "broken") | (F.col("rotation") != 0), F.col("page")))
    n = typed.groupBy("kind").agg(F.count_if(F.col("amount.refusal").isNotNull()).alias("refused"), F.count_if(~F.col("x").between(0.6, 0.8)).alias("outside"), pages.alias("pages"), F.max("page").alias("last_page"), F.sum("amount.value").cast("decimal(38,2)").cast("string").alias("total"))
    return n.join(repeats, "kind").join(gaps, "kind")


@query("""
    WITH r AS (SELECT range AS i FROM range(840)), s AS (SELECT CAST(sum(1000 + 137 * i) + sum(7 * i % 100) / 100 AS DECIMAL(38,2)) AS total, count(*) AS n FROM r), a AS (SELECT CAST(1000 + 137 * 100 + 0 AS DECIMAL(38,2)) AS a)
    SELECT kind, refused, outside, pages, last_page, CAST(CAST(CASE k WHEN 1 THEN total - a WHEN 2 THEN total + a ELSE total END AS DECIMAL(38,2)) AS VARCHAR) AS total, repeated, missing FROM s, a, (VALUES
        ('none', 0, 0, 0, 0, 53, 0, 0), ('rotated_page', 0, 0, 0, 1, 53, 0, 0), ('broken_layer', 0, 0, 0, 1, 53, 0, 0), ('damaged_encoding', 1, 1, 0, 0, 53, 0, 0), ('missing_row', 1, 0, 0, 0, 53, 0, 1), ('duplicated_row', 2, 0, 0, 0, 53, 1, 0),
        ('parentheses', 1, 1, 0, 0, 53, 0, 0), ('leading_zeros', 0, 0, 0, 0, 53, 0, 0), ('changed_form', 0, 0, 840, 0, 53, 0, 0), ('page_break', 0, 0, 0, 0, 54, 0, 0)) v(kind, k, refused, outside, pages, last_page, repeated, missing)""")
def corruptions_found(t: Tables):
    """Nine known corruptions of the training document, each with what the rules must find."""
    document, out = fixtures.training_document(t.spark), None
    for kind in ["none", *fixtures.CORRUPTIONS]:
        one = (document if kind == "none" else fixtures.corrupted(document, kind)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return checked(out.repartition("kind")).select("kind", "refused", "outside", "pages", "last_page", "total", "repeated", "missing")
