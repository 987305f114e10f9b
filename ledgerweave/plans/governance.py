"""Second readings, roles, what leaves, bills of materials, migrations, specifications."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerweave import specs
from ledgerweave.operators import compare as C
from ledgerweave.operators import governance as G
from ledgerweave.operators import quality as Q
from ledgerweave.operators import recheck as K
from ledgerweave.operators import rules as R
from ledgerweave.plans.registry import Tables, query


@query("""
    WITH p AS (SELECT CASE event_id % 3 WHEN 0 THEN 'text_layer' WHEN 1 THEN 'image' ELSE 'paper' END AS a, CASE event_id % 4 WHEN 0 THEN 'text_layer' ELSE 'image' END AS b, event_id % 2 AS e, event_id % 5 % 2 AS f FROM events)
    SELECT CASE WHEN a = 'paper' THEN 'none' WHEN a <> b THEN 'full' WHEN e = f OR a = 'text_layer' THEN 'none' ELSE 'partial' END AS independence, count(*) AS n FROM p GROUP BY 1""")
def reading_independence(t: Tables):
    k = F.col("event_id")
    first, second = F.when(k % 3 == 0, "text_layer").when(k % 3 == 1, "image").otherwise("paper"), F.when(k % 4 == 0, "text_layer").otherwise("image")
    return t.events.select(K.independence(first, k % 2, second, k % 5 % 2).alias("independence")).groupBy("independence").agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT ['broken', 'scan', 'unread', 'empty', 'text', 'other'][1 + page_id % 6] AS layer, page_id % 4 = 0 AS s FROM pages)
    SELECT layer, CASE WHEN s AND layer IN ('broken', 'empty', 'text') THEN 'PASS' ELSE 'UNKNOWN' END AS status, count(*) AS pages FROM l GROUP BY ALL""")
def text_layer_rule(t: Tables):
    layer = F.element_at(F.array(*map(F.lit, ("broken", "scan", "unread", "empty", "text", "other"))), (F.col("page_id") % 6 + 1).cast("int"))
    rows = t.pages.select(layer.alias("layer"), (F.col("page_id") % 4 == 0).alias("second"))
    return rows.groupBy("layer", K.layer_rule(F.col("layer"), F.col("second")).alias("status")).agg(F.count("*").alias("pages"))


@query("""
    WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NO' ELSE 'YES' END AS completeness, CASE WHEN o_orderkey % 7 <> 0 THEN 'YES' END AS exceptions, CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' ELSE 'YES' END AS totals, 'YES' AS run FROM orders),
    u AS (SELECT o_orderkey, concat_ws(',', CASE WHEN exceptions IS NULL THEN 'exceptions' END) AS unmet FROM g) SELECT o_orderkey, CASE WHEN unmet = '' THEN 'open' ELSE 'closed' END AS gate, unmet FROM u""")
def working_gate(t: Tables):
    """The gate of a working book asks for two of the release gate's four conjuncts."""
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(k % 5 == 0, "NO").otherwise("YES").alias("completeness"), F.when(k % 7 != 0, "YES").alias("exceptions"), F.when(k % 3 == 0, "UNKNOWN").otherwise("YES").alias("totals"), F.lit("YES").alias("run"))
    return K.conjunction(rows, ["o_orderkey"], ["exceptions", "run"])


@query("""
    WITH d AS (SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'blocked' WHEN doc_id % 4 = 0 THEN 'partial' ELSE 'completed' END AS s, CASE WHEN n_chars < 500 THEN 2 ELSE 0 END AS w FROM documents)
    SELECT source, count_if(s = 'blocked') AS blocked, CAST(sum(CASE WHEN s <> 'blocked' THEN w ELSE 0 END) AS BIGINT) AS to_review, count_if(s = 'completed' AND w = 0) AS ready, count_if(s = 'partial' AND w = 0) AS in_work FROM d GROUP BY 1""")
def queue_counters(t: Tables):
    k = F.col("doc_id")
    rows = t.documents.select("source", F.when(k % 9 == 0, "blocked").when(k % 4 == 0, "partial").otherwise("completed").alias("s"), F.when(F.col("n_chars") < 500, 2).otherwise(0).alias("w"))
    return K.queue_counters(rows, ["source"], "s", "w")


@query("""
    WITH r AS (SELECT user_id, event_id, CASE WHEN value BETWEEN 0 AND 10 THEN 'date' WHEN value BETWEEN 11 AND 30 THEN 'amount' END AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s AS (SELECT user_id, count_if(f = 'date') AS d, count_if(f = 'amount') AS a, count_if(f IS NULL) AS x FROM r WHERE n <= 10 GROUP BY 1)
    SELECT user_id, 'date' AS field, CASE WHEN d > 0 THEN 'matched' ELSE 'vanished' END AS state FROM s UNION ALL SELECT user_id, 'amount', CASE WHEN a > 0 THEN 'matched' ELSE 'vanished' END FROM s
    UNION ALL SELECT user_id, 'purpose', 'vanished' FROM s UNION ALL SELECT user_id, 'outside', 'to_decide' FROM s WHERE x > 0""")
def template_trial(t: Tables):
    v = F.col("value")
    name = F.when(v.between(0, 10), "date").when(v.between(11, 30), "amount")
    rows = t.events.select("user_id", "event_id", F.array_compact(F.array(name)).alias("fields"), name.isNull().cast("int").alias("extra"))
    return K.trial(rows, ["date", "amount", "purpose"], ["user_id"], ["event_id"])


@query("""
    SELECT o_orderkey, f.field, CASE WHEN o_orderkey % 4 <> 0 THEN 'page/' || o_orderkey END AS place, CASE WHEN f.field = 'date' AND day(o_orderdate) <= 12 THEN 'ambiguous_date' ELSE '' END AS warnings
    FROM orders, (VALUES ('amount'), ('date')) f(field) WHERE o_orderstatus = 'P'""")
def review_screen(t: Tables):
    fields = t.orders.select("o_orderkey", F.explode(F.array(F.lit("amount"), F.lit("date"))).alias("field"))
    evidence = fields.where("o_orderkey % 4 <> 0").withColumn("place", F.concat(F.lit("page/"), F.col("o_orderkey").cast("string")))
    warnings = t.orders.where(F.dayofmonth("o_orderdate") <= 12).select("o_orderkey", F.lit("date").alias("field"), F.lit("ambiguous_date").alias("kind"))
    decisions = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "review").otherwise("accepted_auto").alias("status"))
    return K.review_screen(fields, evidence, warnings, decisions, ["o_orderkey"]).withColumn("warnings", F.concat_ws(",", "warnings"))


@query("""
    WITH a AS (SELECT doc_id, quality AS q, toxic AS x FROM labels WHERE doc_id % 31 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS q, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS x FROM labels WHERE doc_id % 37 <> 0),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.q AS aq, b.q AS bq, a.x AS ax, b.x AS bx, a.doc_id IS NOT NULL AS ia, b.doc_id IS NOT NULL AS ib FROM a FULL JOIN b ON a.doc_id = b.doc_id)
    SELECT doc_id, 'quality' AS field, CAST(aq AS VARCHAR) AS first_value, CAST(bq AS VARCHAR) AS second_value FROM j WHERE ia AND ib AND aq <> bq UNION ALL SELECT doc_id, 'toxic', CAST(ax AS VARCHAR), CAST(bx AS VARCHAR) FROM j WHERE ia AND ib AND ax <> bx
    UNION ALL SELECT doc_id, NULL, CASE WHEN ia THEN 'present' ELSE 'absent' END, CASE WHEN ib THEN 'present' ELSE 'absent' END FROM j WHERE NOT ia OR NOT ib""")
def annotators_compared(t: Tables):
    flip = lambda c, k: F.when(F.col("doc_id") % k == 0, 1 - F.col(c)).otherwise(F.col(c)).alias(c)
    b = t.labels.where("doc_id % 37 <> 0").select("doc_id", flip("quality", 5), flip("toxic", 7))
    return C.disagreements(t.labels.where("doc_id % 31 <> 0"), b, ["doc_id"], ["quality", "toxic"])


@query("""
    WITH a AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 31 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 37 <> 0)
    SELECT count_if(b.doc_id IS NULL) AS missed, count_if(a.doc_id IS NULL) AS extra, count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) * 2 AS compared, count_if(a.quality = b.quality) + count_if(a.toxic = b.toxic) AS agreed FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def annotator_qualification(t: Tables):
    """A pupil's annotation against the reference one: values compared and agreed, rows missed and extra."""
    b = t.labels.where("doc_id % 37 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), "toxic")
    return C.qualification(t.labels.where("doc_id % 31 <> 0"), b, ["doc_id"], ["quality", "toxic"])


@query("""
    SELECT role, event_type AS work, CASE WHEN role = 'operator' AND event_type IN ('click', 'view') THEN true WHEN role = 'annotator' AND event_type = 'error' THEN true ELSE false END AS permitted, count(*) AS n
    FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'annotator' ELSE 'stranger' END AS role, event_type FROM events) GROUP BY ALL""")
def role_permission(t: Tables):
    role = F.when(F.col("user_id") % 3 == 0, "operator").when(F.col("user_id") % 3 == 1, "annotator").otherwise("stranger")
    rows = t.events.select(role.alias("role"), F.col("event_type").alias("work"))
    may = G.permitted(F.col("role"), F.col("work"), {"operator": ("click", "view"), "annotator": ("error",), "auditor": ()})
    return rows.groupBy("role", "work", may.alias("permitted")).agg(F.count("*").alias("n"))


@query("""
    WITH e AS (SELECT CASE WHEN event_id % 50 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS stage, CASE WHEN event_id % 70 = 0 THEN -1 ELSE event_id END AS records FROM events)
    SELECT CASE WHEN NOT regexp_matches(stage, '[A-Za-z]') THEN 'stage' WHEN records < 0 THEN 'records' END AS refusal, count(*) AS n FROM e GROUP BY 1""")
def outgoing_checked(t: Tables):
    """Digits alone are data and no code; negative counts are refused; columns beyond the list never leave."""
    k = F.col("event_id")
    rows = t.events.select(F.when(k % 50 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type")).alias("stage"), F.when(k % 70 == 0, -1).otherwise(k).alias("records"), (k >= 0).alias("ok"), "props")
    return G.outgoing(rows).groupBy("refusal").agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT o_orderpriority AS run, o_orderkey, o_orderstatus FROM orders) SELECT run, count(*) AS records, true AS repeatable FROM l GROUP BY 1""")
def result_fingerprint(t: Tables):
    """Two runs over the same records in another order give one fingerprint; a changed record gives another."""
    rows = t.orders.select(F.col("o_orderpriority").alias("run"), "o_orderkey", "o_orderstatus")
    of = lambda d: G.result_fingerprint(d, ["run"], ["o_orderkey"], ["o_orderstatus"])
    same = of(rows).join(of(rows.repartition(5, "o_orderkey")).withColumnRenamed("fingerprint", "again"), "run")
    changed = of(rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") < 100, "?").otherwise(F.col("o_orderstatus")))).withColumnRenamed("fingerprint", "other")
    n = rows.groupBy("run").agg(F.count("*").alias("records"))
    return same.join(changed, "run").join(n, "run").select("run", "records", ((F.col("fingerprint") == F.col("again")) & (F.col("fingerprint") != F.col("other"))).alias("repeatable"))


@query("""
    SELECT 'runs' AS measure, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'documents', 'all', count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'operator', CAST(o_custkey % 7 AS VARCHAR), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'action', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def usage_summary(t: Tables):
    return G.usage(t.events.select(F.col("event_type").alias("state"), F.col("user_id").alias("document_id")), t.orders.select((F.col("o_custkey") % 7).alias("operator"), F.col("o_orderstatus").alias("action")))


@query("""
    WITH a AS (SELECT p_partkey, p_size AS f FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE p_size END AS f FROM part WHERE p_partkey % 17 <> 0)
    SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'unlisted' WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.f = b.f THEN 'ok' ELSE 'changed' END AS verdict FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def bill_of_materials(t: Tables):
    b = t.part.where("p_partkey % 17 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, -1).otherwise(F.col("p_size")).alias("f"))
    return G.bill_of_materials(t.part.where("p_partkey % 11 <> 0").select("p_partkey", F.col("p_size").alias("f")), b, "p_partkey", "f")


@query("""
    WITH d AS (SELECT doc_id, list_filter(['apache', 'mit', 'bsd'], lambda x: regexp_matches(lower(text), '(^|[^a-z])' || x || '([^a-z]|$)')) AS m FROM documents), w AS (SELECT doc_id, list_sort(list_filter(m, lambda x: x <> 'mit')) AS w FROM d)
    SELECT doc_id, array_to_string(w, ',') AS wider FROM w WHERE len(w) > 0""")
def licence_obligations(t: Tables):
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(low.rlike(f"(^|[^a-z]){x}([^a-z]|$)"), x) for x in ("apache", "mit", "bsd"))))
    return G.licence_obligations(t.documents.select("doc_id", F.lit("MIT").alias("declared"), found.alias("mentioned")), "doc_id", "declared", "mentioned")


@query("""
    SELECT source AS shelf, lang AS name, CASE WHEN source IN ('src0', 'src1') AND lang <> 'es' THEN 'new' ELSE 'old' END AS body FROM (SELECT DISTINCT source, lang FROM documents)""")
def blob_upsert(t: Tables):
    store = t.documents.select(F.col("source").alias("shelf"), F.col("lang").alias("name")).distinct().withColumn("body", F.lit("old"))
    sent = store.where("shelf IN ('src0', 'src1') AND name <> 'es'").withColumn("body", F.lit("new"))
    return G.upsert_blobs(store, sent)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 5")
def upgrade_losses(t: Tables):
    return G.lost_in_upgrade(t.orders, t.orders.where("o_orderkey % 97 <> 5"), ["o_orderkey"])


@query("SELECT o_orderstatus, '1>2>3' AS migrated, count(*) AS n, 0 AS lost FROM orders GROUP BY 1")
def migration_preserved(t: Tables):
    """Two steps between versions; the payload is the same multiset before and after."""
    m = G.Migrations()
    m.add("record", "1", "2", lambda d: d.withColumnRenamed("o_comment", "note") if "o_comment" in d.columns else d.withColumn("note", F.lit(None).cast("string")))
    m.add("record", "2", "3", lambda d: d.withColumn("schema_version", F.lit("record/3")))
    now, lost = m.migrate(t.orders, "record", "1", "3", ["o_orderkey", "o_orderstatus"])
    gone = lost.groupBy("o_orderstatus").agg(F.count("*").cast("int").alias("lost"))
    return now.groupBy("o_orderstatus", "migrated").agg(F.count("*").alias("n")).join(gone, "o_orderstatus", "left").fillna(0, ["lost"])


SPEC = {
    "identification": {"family": "orders", "issuer": "x", "form_version": "1", "languages": ["en"], "positive_markers": ["order"], "negative_markers": []},
    "schema": {"fields": [{"name": "o_totalprice", "type": "money", "required": True, "max_digits": 2}]},
    "addressing": {"tables": [], "continuation": None, "record_boundary": {}, "columns": [{"field": "o_totalprice", "from": "0.1", "to": "0.4"}], "requisites": []},
    "normalisation": {"date_order": "DMY", "decimal_separator": ",", "group_separator": " ", "currency": "USD"},
    "coverage": {"expected": [], "allowed_exclusions": []},
    "checks": {"totals": [], "order": None, "sequence": None, "duplicates": None, "cross_field": [
        {"kind": "bounds", "value": "o_totalprice", "low": "1000", "high": "400000", "critical": True}, {"kind": "admissible", "condition": "o_orderstatus", "when": ["P"], "value": "o_orderpriority", "allowed": ["1-URGENT", "2-HIGH"]},
        {"kind": "composition", "condition": "o_orderstatus", "values": ["F"], "required": ["o_custkey"], "forbidden": ["requisite_hold"]}, {"kind": "currency_match", "own": "o_orderstatus", "other": "requisite:status"}]},
    "risk": {"critical_fields": ["o_totalprice"], "class": "usual"}, "admission": {"required_rules": [], "thresholds": {}}, "versioning": {"owner": "x", "approved": "2024-01-01", "rollback": "0"},
}


@query("""
    SELECT rule_id, status, severity, count(*) AS n FROM (
        SELECT 'cross_field/0/bounds' AS rule_id, CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) BETWEEN 1000 AND 400000 THEN 'PASS' ELSE 'FAIL' END AS status, 'critical' AS severity FROM orders
        UNION ALL SELECT 'cross_field/1/admissible', CASE WHEN o_orderstatus = 'P' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'FAIL' ELSE 'PASS' END, 'fixable' FROM orders
        UNION ALL SELECT 'cross_field/2/composition', 'PASS', 'fixable' FROM orders
        UNION ALL SELECT 'cross_field/3/currency_match', CASE WHEN o_orderkey % 6 = 0 THEN 'UNKNOWN' WHEN o_orderstatus = 'O' THEN 'PASS' ELSE 'FAIL' END, 'fixable' FROM orders) GROUP BY ALL""")
def spec_rules(t: Tables):
    """Rules compiled from a family's JSON; one refers to a requisite of the document. The input is scanned once."""
    spec = specs.load(json.dumps(SPEC))
    rows = t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("requisite_status", F.when(F.col("o_orderkey") % 6 != 0, "O")).withColumn("requisite_hold", F.lit(None).cast("string"))
    return R.apply_rules(rows, ["o_orderkey"], spec.cross_field(rows.columns)).groupBy("rule_id", "status", "severity").agg(F.count("*").alias("n"))


@query("""
    WITH r AS (SELECT CASE WHEN l_discount > 0.08 THEN 'FAIL' WHEN l_linenumber = 7 THEN 'UNKNOWN' ELSE 'PASS' END AS s FROM lineitem UNION ALL SELECT CASE WHEN l_tax > 0.07 THEN 'FAIL' ELSE 'PASS' END FROM lineitem)
    SELECT count_if(s = 'PASS') AS passed, count_if(s = 'FAIL') AS failed, count_if(s = 'UNKNOWN') AS unknown FROM r""")
def rule_summary(t: Tables):
    """Union of two levels' results, counted by status."""
    one = R.apply_rules(t.lineitem, ["l_orderkey"], [R.Rule("discount", F.when(F.col("l_discount") > 0.08, R.FAIL).when(F.col("l_linenumber") == 7, R.UNKNOWN).otherwise(R.PASS))])
    two = R.apply_rules(t.lineitem, ["l_orderkey"], [R.Rule("tax", F.when(F.col("l_tax") > 0.07, R.FAIL).otherwise(R.PASS))])
    return R.rule_summary(one.unionByName(two), [])


@query("""
    WITH g AS (SELECT n_regionkey AS r, count(*) AS gold, count_if(c_custkey % 10 <> 0) AS found, count_if(c_custkey % 50 = 3) AS unknown, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 5)
    SELECT r AS region, sum(greatest(0, gold - found) + unknown) / sum(gold) AS coverage_loss FROM g GROUP BY 1""")
def coverage_loss(t: Tables):
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region"), "c_nationkey")
    return Q.coverage_loss(rows.agg(F.count("*").alias("gold"), F.count_if(F.col("c_custkey") % 10 != 0).alias("found"), F.count_if(F.col("c_custkey") % 50 == 3).alias("unknown")), ["region"])


@query("""
    WITH n AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders WHERE o_totalprice < 100000 GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS one_by_one, count(*) AS by_group, CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM orders) AS share FROM n""")
def load_forecast(t: Tables):
    groups = t.orders.where("o_totalprice < 100000").groupBy(F.col("o_orderpriority").alias("group")).agg(F.count("*").alias("records"))
    return Q.load_forecast(groups, t.orders.count())


@query("""
    WITH m AS (SELECT lang, CAST(substr(source, 4) AS INT) AS version, avg(CAST(n_chars < 1000 AS INT)) AS short, avg(CAST(n_chars > 5000 AS INT)) AS long FROM documents GROUP BY 1, 2),
    c AS (SELECT a.lang, a.version, a.short - b.short AS s, a.long - b.long AS l FROM m a JOIN m b ON a.lang = b.lang AND a.version = b.version + 1)
    SELECT lang, version, 'short' AS metric, s AS change FROM c UNION ALL SELECT lang, version, 'long', l FROM c""")
def template_drift(t: Tables):
    """Metrics of each version of a template (here a source of a language) against those of the one before."""
    version = F.substring("source", 4, 10).cast("int").alias("version")
    m = t.documents.groupBy("lang", version).agg(F.avg((F.col("n_chars") < 1000).cast("int")).alias("short"), F.avg((F.col("n_chars") > 5000).cast("int")).alias("long"))
    return Q.template_drift(m, m.withColumn("version", F.col("version") + 1), ["lang", "version"], ["short", "long"])
