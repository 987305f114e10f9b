"""Decisions, run states, gates, selection and modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.operators import rules as R
from ledgerweave.operators import sampling as S
from ledgerweave.operators.graph import connected_components
from ledgerweave.plans.registry import Tables, query

MONEY = "decimal(18,2)"


@query("""
    SELECT CASE WHEN bad > 0 THEN 'NO' WHEN open > 0 THEN 'UNKNOWN' ELSE 'YES' END AS state, count(*) AS orders, count_if(crit > 0) AS critical FROM (
        SELECT l_orderkey, count_if(l_linenumber = 6 OR CAST(l_discount AS DECIMAL(18,2)) > 0.09) AS bad, count_if(l_linenumber = 7) AS open, count_if(CAST(l_discount AS DECIMAL(18,2)) > 0.09) AS crit FROM lineitem GROUP BY 1) GROUP BY 1""")
def fold_results(t: Tables):
    """Rule results of each order folded into one observation."""
    rules = [
        R.Rule("line", F.when(F.col("l_linenumber") == 7, R.UNKNOWN).when(F.col("l_linenumber") == 6, R.FAIL).otherwise(R.PASS), R.FIXABLE),
        R.Rule("bounds", R.cross_field("bounds", F.col("l_discount").cast(MONEY), None, "0.09")),
    ]
    out = R.fold(R.apply_rules(t.lineitem, ["l_orderkey"], rules), ["l_orderkey"])
    return out.groupBy("state").agg(F.count("*").alias("orders"), F.count_if("critical").alias("critical"))


LINE = ["l_orderkey", "l_linenumber"]


def decide_lines(t: Tables):
    """The eleven conjuncts of each line, from all rows that share its address; one bad row of several decides."""
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    shipped = F.when(F.col("l_linenumber") != 7, F.col("l_shipdate"))
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    fine = F.lit(R.PASS)
    rules = {
        "run_not_blocked": [R.Rule("run", fine)],
        "coverage_complete": [R.Rule("coverage", F.when(k % 97 == 5, R.UNKNOWN).otherwise(R.PASS))],
        "provenance_complete": [R.Rule("evidence", F.when(part % 211 == 0, R.FAIL).otherwise(R.PASS), R.FIXABLE)],
        "required_types_valid": [R.Rule("schema", F.when(F.col("l_returnflag").isNull(), R.FAIL).otherwise(R.PASS)), R.Rule("quantity", R.cross_field("bounds", F.col("l_quantity").cast(MONEY), "1", "50"))],
        # Orders whose key ends in 9 declare no control total.
        "required_totals_passed": [R.Rule("totals", F.when(k % 10 == 9, R.UNKNOWN).otherwise(R.PASS))],
        "domain_rules_passed": [R.Rule("dates", R.cross_field("date_order", shipped, F.col("o_orderdate"), "not_earlier"), R.FIXABLE), R.Rule("bounds", R.cross_field("bounds", F.col("l_discount").cast(MONEY), "0.01", "0.10"))],
        "independent_check_passed_or_not_required_by_versioned_policy": [R.Rule("second", fine)],
        "reversibility_check_passed": [R.Rule("reverse", fine)],
        "no_value_warning": [R.Rule("warning", F.when(part % 53 == 7, R.UNKNOWN).otherwise(R.PASS))],
        "template_is_admitted": [R.Rule("template", fine)],
    }
    twice = R.parse_duplicates(t.lineitem, LINE)
    state = F.when(F.col("status") == R.PASS, "YES").when(F.col("status") == R.FAIL, "NO").otherwise("UNKNOWN")
    unique = twice.select(*LINE, F.lit("order_and_duplicate_checks_passed").alias("conjunct"), state.alias("state"), F.lit(False).alias("critical"))
    return R.decide(twice, R.observe(rows, LINE, rules).unionByName(unique), LINE)


LINES = """
    WITH c AS (SELECT l_orderkey, l_linenumber, count(*) > 1 AS twice, max(CAST(CAST(l_discount AS DECIMAL(18,2)) NOT BETWEEN 0.01 AND 0.10 AS INT)) > 0 AS bad, l_linenumber = 7 OR max(CAST(l_shipdate < o_orderdate AS INT)) > 0 AS undated,
        l_orderkey % 10 = 9 AS open, l_orderkey % 97 = 5 AS uncovered, max(CAST(l_partkey % 211 = 0 AS INT)) > 0 AS nowhere, max(CAST(l_partkey % 53 = 7 AS INT)) > 0 AS warned FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
    r AS (SELECT l_orderkey, l_linenumber, CAST(bad OR undated AS INT) + CAST(twice AS INT) + CAST(open AS INT) + CAST(uncovered AS INT) + CAST(nowhere AS INT) + CAST(warned AS INT) AS unmet,
        CASE WHEN bad THEN 'rejected' WHEN undated OR twice OR open OR uncovered OR nowhere OR warned THEN 'review' ELSE 'accepted_auto' END AS status FROM c)
"""


@query(LINES + "SELECT l_orderkey, l_linenumber, status, CASE status WHEN 'rejected' THEN 'REJECTED' WHEN 'review' THEN 'REVIEW' ELSE 'DATA' END AS sheet, CAST(unmet AS BIGINT) AS unmet FROM r")
def decide_records(t: Tables):
    return decide_lines(t).select("l_orderkey", "l_linenumber", "status", "sheet", "unmet")


@query("""
    SELECT o_orderkey, CASE WHEN m = 1 THEN 'E_CONJUNCT_UNKNOWN' WHEN m = 2 THEN 'E_CONJUNCT_CONTRADICTED' END AS error, CASE WHEN m IN (1, 2) THEN 'ERRORS' WHEN m = 3 THEN 'REJECTED' WHEN m IN (4, 5) THEN 'REVIEW' ELSE 'DATA' END AS sheet,
           CASE WHEN m = 3 THEN 'rejected' WHEN m IN (4, 5) THEN 'review' WHEN m NOT IN (1, 2) THEN 'accepted_auto' END AS status FROM (SELECT o_orderkey, o_orderkey % 8 AS m FROM orders)""")
def decide_faulty(t: Tables):
    """Observations of conjuncts: one that the formula hasn't, two states for one, a critical NO, a missing one, an unknown one."""
    m = F.col("o_orderkey") % 8
    cell = lambda c, state, critical=False: F.struct(F.lit(c).alias("conjunct"), F.lit(state).alias("state"), F.lit(critical).alias("critical"))
    first = R.CONJUNCTS[0]
    given = [*(cell(c, "YES") for c in R.CONJUNCTS[1:]), F.when(m == 3, cell(first, "NO", True)).when(m == 5, cell(first, "UNKNOWN")).when(m != 4, cell(first, "YES")), F.when(m == 1, cell("no_such_conjunct", "NO", True)), F.when(m == 2, cell(first, "NO"))]
    told = t.orders.select("o_orderkey", F.explode(F.array_compact(F.array(*given))).alias("o")).select("o_orderkey", "o.*")
    return R.decide(t.orders, told, ["o_orderkey"]).select("o_orderkey", "error", "sheet", "status")


@query(LINES + """SELECT o_orderpriority AS priority, count(*) AS records, count_if(status = 'accepted_auto') AS data, count_if(status = 'review') AS review, count_if(status = 'rejected') AS rejected,
    count_if(status = 'accepted_auto') / count(*) AS automation FROM r JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def decision_summary(t: Tables):
    rows = decide_lines(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority")), "l_orderkey")
    return R.decision_summary(rows, ["priority"])


@query(LINES + """SELECT l_orderkey, CASE WHEN l_orderkey % 40 = 1 THEN 'blocked' WHEN l_orderkey % 40 = 2 THEN 'failed' WHEN count_if(status = 'review') > 0 THEN 'partial' ELSE 'completed' END AS run_state FROM r GROUP BY 1""")
def run_state(t: Tables):
    k = F.col("l_orderkey") % 40
    return R.run_state(decide_lines(t), ["l_orderkey"], k == 1, k == 2)


@query(LINES + """, g AS (SELECT l_orderkey AS batch, count_if(status = 'review') > 0 AS open, count_if(status = 'accepted_auto') = 0 AS none, l_orderkey % 7 <> 0 AS totals FROM r GROUP BY 1)
    SELECT batch, CASE WHEN NOT open AND NOT none AND totals THEN 'open' ELSE 'closed' END AS gate, CAST(CAST(open AS INT) + CAST(none AS INT) + CAST(NOT totals AS INT) AS BIGINT) AS unmet FROM g""")
def release_gate(t: Tables):
    """Each order is a batch; the totals of a seventh don't hold."""
    rows = decide_lines(t).withColumn("batch", F.col("l_orderkey")).withColumn("totals_ok", F.col("l_orderkey") % 7 != 0)
    return R.release_gate(rows, ["batch"])


@query("""
    WITH d AS (SELECT doc_id, n_chars < 300 AS short, lang = 'es' AS es, substr(sha256('seed-1|' || doc_id), 1, 16) AS k FROM documents),
    f AS (SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) AS n FROM d WHERE NOT short AND NOT es)
    SELECT doc_id, CASE WHEN short AND es THEN 'short,language' WHEN short THEN 'short' ELSE 'language' END AS reasons FROM d WHERE short OR es
    UNION ALL SELECT doc_id, 'random' FROM f WHERE n <= (SELECT ceil(count(*) * 0.05) FROM documents)""")
def seeded_sample(t: Tables):
    """Every document with a trigger, and a seeded twentieth of all from the others."""
    rows = t.documents.select("doc_id", S.triggers({"short": F.col("n_chars") < 300, "language": F.col("lang") == "es"}).alias("reasons"))
    return S.select_for_recheck(rows, "doc_id", "stable", 0.05, "seed-1").select("doc_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("""
    WITH k AS (SELECT event_id, substr(sha256('seed-2|' || event_id), 1, 16) AS k FROM events), n AS (SELECT event_id, row_number() OVER (ORDER BY k, event_id) AS n FROM k)
    SELECT '0.00004' AS share, event_id FROM n WHERE n <= (SELECT ceil(count(*) * 0.00004) FROM events) UNION ALL SELECT '0.33333', event_id FROM n WHERE n <= (SELECT ceil(count(*) * 0.33333::DECIMAL(9,5)) FROM events) UNION ALL SELECT '1', event_id FROM n""")
def seeded_shares(t: Tables):
    """Quotas of exact decimal shares: a tiny one still draws a row, and the whole draws all."""
    rows, out = t.events.select("event_id", F.array().cast("array<string>").alias("reasons")), None
    for share in ("0.00004", "0.33333", "1"):
        one = S.select_for_recheck(rows, "event_id", "stable", share, "seed-2").select(F.lit(share).alias("share"), "event_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    WITH m AS (SELECT source, count(*) AS observations, sum(1 - quality) AS errors FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    g AS (SELECT source, observations, CAST(errors AS BIGINT) AS errors, CASE WHEN source = 'src3' THEN 'version' WHEN 3.0 / observations > 0.2 THEN 'rule_of_three' WHEN CAST(errors AS DOUBLE) / observations > 0.2 THEN 'error_share' ELSE 'open' END AS gate FROM m)
    SELECT *, CASE WHEN source = 'src0' THEN 'high_risk' WHEN gate = 'open' THEN 'stable' ELSE 'calibration' END AS mode FROM g""")
def mode_gate(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("observations"), F.sum(1 - F.col("quality")).cast("long").alias("errors")).withColumn("same_version", F.col("source") != "src3")
    return S.choose_mode(S.gate(rows, ["source"], 0.2), F.col("source") == "src0", F.lit(False))


CLUSTERS = """
    WITH RECURSIVE l AS (SELECT c_custkey AS a, s_suppkey + 1000000000 AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 97 = s_suppkey % 97),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
    SELECT node, min(reach) AS component FROM r GROUP BY node"""


def _links(t: Tables):
    c = t.customer.select("c_custkey", "c_nationkey", (F.col("c_custkey") % 97).alias("k"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 97).alias("k"))
    return c.join(s, ["c_nationkey", "k"]).select(F.col("c_custkey").alias("a"), (F.col("s_suppkey") + 1_000_000_000).alias("b"))


@query(CLUSTERS)
def cluster_sources(t: Tables):
    """Sources linked by an owner: here customers and suppliers of one nation whose keys agree mod 97."""
    return connected_components(_links(t))


@query("""
    WITH RECURSIVE c AS (SELECT min(c_custkey) AS cluster, count(*) + 1 AS size FROM customer GROUP BY c_nationkey), o AS (SELECT *, row_number() OVER (ORDER BY sha256(concat(least('seed-1', CAST(cluster AS VARCHAR)), greatest('seed-1', CAST(cluster AS VARCHAR)))), cluster) AS n, sum(size) OVER () AS total FROM c),
    r AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS cluster, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS d, NULL::VARCHAR AS part
        UNION ALL SELECT n, cluster, a + CASE WHEN part = 'development' THEN size ELSE 0 END, b + CASE WHEN part = 'check' THEN size ELSE 0 END, d + CASE WHEN part = 'closed' THEN size ELSE 0 END, part FROM (
            SELECT o.n, o.cluster, o.size, a, b, d, a - 0.6::DOUBLE * total AS x, b - 0.2::DOUBLE * total AS y, d - 0.2::DOUBLE * total AS z, CASE WHEN x <= y AND x <= z THEN 'development' WHEN y <= z THEN 'check' ELSE 'closed' END AS part FROM r JOIN o ON o.n = r.n + 1))
    SELECT cluster, part FROM r WHERE n > 0""")
def corpus_split(t: Tables):
    """Customers linked through their nation, each cluster whole to one part."""
    links = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + 1_000_000_000).cast("long").alias("b"))
    clusters = connected_components(links).groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size"))
    return S.split_corpus(clusters, "seed-1")


@query("""
    WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark),
    h AS (SELECT item_id, sha256(trim(line)) AS h FROM b WHERE length(trim(line)) >= 20)
    SELECT DISTINCT item_id FROM h WHERE h IN (SELECT sha256(trim(line)) FROM d)""")
def leakage_check(t: Tables):
    """Items of the closed set of which a line has been seen."""
    line = lambda d, key: d.select(key, F.explode(F.split("text", "\n")).alias("line")).withColumn("h", F.sha2(F.trim("line"), 256))
    closed = line(t.benchmark, "item_id").where(F.char_length(F.trim("line")) >= 20)
    return S.leaked(line(t.documents, "doc_id"), closed, "h").select("item_id").distinct()
