"""Quality of the results: metrics, segments, percentiles, cost, drift, labour, markup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerweave.operators import compare as C
from ledgerweave.operators import quality as Q
from ledgerweave.plans.registry import Tables, query

LABELLED = """
    WITH o AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN n_chars > 4000 THEN 'rejected' WHEN n_chars < 600 THEN 'review' ELSE 'accepted_auto' END AS status, n_chars >= 100 AS eligible,
        CASE WHEN n_chars < 250 THEN 0 ELSE 1 END AS p, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE l.quality END AS g FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    k AS (SELECT *, p = g AS correct FROM o),
    s AS (SELECT *, 'all' AS segment, 'all' AS value FROM k UNION ALL SELECT *, 'lang', lang FROM k UNION ALL SELECT *, 'source', source FROM k),
    m AS (SELECT segment, value, count(*) AS records, count(DISTINCT source) AS sources,
        CASE WHEN count_if(status = 'accepted_auto' AND correct IS NOT NULL) > 0 THEN count_if(coalesce(status = 'accepted_auto' AND NOT correct, false)) / count_if(status = 'accepted_auto' AND correct IS NOT NULL) END AS far,
        CASE WHEN count_if(eligible) > 0 THEN count_if(coalesce(eligible AND status = 'accepted_auto' AND correct, false)) / count_if(eligible) END AS automation,
        count_if(status = 'review') / count(*) AS review_load,
        CASE WHEN count(correct) > 0 THEN count_if(coalesce(NOT correct, false)) / count(correct) END AS field_error,
        CASE WHEN count_if(status = 'review' AND correct IS NOT NULL) > 0 THEN count_if(coalesce(status = 'review' AND correct, false)) / count_if(status = 'review' AND correct IS NOT NULL) END AS false_alarm,
        CASE WHEN count_if(coalesce(status = 'accepted_auto' AND NOT correct, false)) = 0 THEN 3.0::DOUBLE / count(DISTINCT source) END AS rule_of_three FROM s GROUP BY ALL)
"""


def _segmented(t: Tables):
    n = F.col("n_chars")
    status = F.when(n > 4000, "rejected").when(n < 600, "review").otherwise("accepted_auto")
    seen = t.documents.select("doc_id", "source", "lang", status.alias("status"), (n >= 100).alias("eligible"), F.when(n < 250, 0).otherwise(1).alias("quality"))
    gold = t.labels.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("quality")).alias("quality"))
    return Q.by_segments(Q.compare_with_gold(seen, gold, ["doc_id"], ["quality"]), ["lang", "source"])


def _measured(t: Tables):
    return Q.metrics(_segmented(t), ["segment", "value"], 1, "source")


@query(LABELLED + "SELECT * FROM m")
def bench_nine_metrics(t: Tables):
    """The metrics over all and over each segment in one aggregation; documents are predicted by length, labels are gold."""
    return _measured(t)


@query(LABELLED.replace("count(DISTINCT source) AS sources,", "count(DISTINCT source) AS sources, count(DISTINCT doc_id) AS documents, CAST(greatest(0, 30 - count(DISTINCT source)) AS BIGINT) AS shortage,") + """,
    t AS (SELECT max(p) AS p FROM (SELECT CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p FROM events)), c AS (SELECT CAST(sum(CAST(length(text) AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT conv_id) AS c FROM conversations),
    l AS (SELECT sum(greatest(0, g - f)) / sum(g) AS l FROM (SELECT count(*) AS g, count_if(n_chars >= 100) AS f FROM documents GROUP BY source)), d AS (SELECT abs(far - 0.5) AS d FROM m WHERE segment = 'all'),
    u AS (SELECT segment, value, unnest([{'metric': 'far', 'measure': far}, {'metric': 'automation', 'measure': automation}, {'metric': 'review_load', 'measure': review_load}, {'metric': 'field_error', 'measure': field_error}, {'metric': 'false_alarm', 'measure': false_alarm},
        {'metric': 'coverage_loss', 'measure': CASE WHEN segment = 'all' THEN (SELECT l FROM l) END}, {'metric': 'throughput_p95', 'measure': CASE WHEN segment = 'all' THEN (SELECT p FROM t) END}, {'metric': 'full_cost', 'measure': CASE WHEN segment = 'all' THEN (SELECT c FROM c) END},
        {'metric': 'template_drift', 'measure': CASE WHEN segment = 'all' THEN (SELECT d FROM d) END}, {'metric': 'documents', 'measure': documents}, {'metric': 'shortage', 'measure': shortage}]) AS x FROM m)
    SELECT segment, value, x.metric AS metric, CAST(x.measure AS DOUBLE) AS measure FROM u""")
def all_nine_metrics(t: Tables):
    """The nine metrics of the whole and of each segment in one result, with documents as a level of counting and what the rule of three still lacks."""
    rows = _segmented(t)
    measured = Q.metrics(rows, ["segment", "value"], 1, "source", "doc_id", "0.1")
    whole = t.events.select(F.lit(1).alias("k"), "value")
    covered = t.documents.groupBy("source").agg(F.count("*").alias("gold"), F.count_if(F.col("n_chars") >= 100).alias("found")).select(F.lit(1).alias("k"), "gold", "found", F.lit(0).alias("unknown"))
    none = F.lit(0).cast("decimal(18,2)")
    cost = t.conversations.select(F.lit(1).alias("k"), F.col("conv_id").alias("document"), F.char_length("text").cast("decimal(18,2)").alias("compute"), none.alias("api"), none.alias("storage"), none.alias("minutes"), none.alias("minute_price"))
    now = measured.where("segment = 'all'").select(F.lit(1).alias("k"), "far")
    drifted = Q.template_drift(now, now.withColumn("far", F.lit(0.5)), ["k"], ["far"])
    nine = Q.nine_metrics(measured, Q.coverage_loss(covered, ["k"]), Q.percentiles(whole, ["k"], "value"), Q.full_cost(cost, ["k"]), drifted)
    more = measured.select("segment", "value", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("measure")) for c in ("documents", "shortage")))).alias("m")).select("segment", "value", "m.*")
    return nine.unionByName(more)


@query(LABELLED + "SELECT segment, value, far FROM m WHERE segment <> 'all' AND far IS NOT NULL ORDER BY far DESC, segment, value LIMIT 1")
def bench_segments_weakest(t: Tables):
    return Q.weakest(_measured(t), "far").select("segment", "value", "far")


@query(LABELLED + "SELECT segment, value, concat_ws(',', CASE WHEN far IS NULL OR far > 0.1 THEN 'far' END, CASE WHEN automation IS NULL OR automation < 0.2 THEN 'automation' END) AS unmet FROM m")
def admission_checklist(t: Tables):
    return Q.admission(_measured(t), {"far": ("most", 0.1), "automation": ("least", 0.2)}).select("segment", "value", F.concat_ws(",", "unmet").alias("unmet"))


@query("""
    SELECT event_type, count(*) AS n, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY 1""")
def latency_percentiles(t: Tables):
    return Q.percentiles(t.events, ["event_type"], "value")


@query("""
    WITH c AS (SELECT role, conv_id, CAST(length(text) AS DECIMAL(18,2)) AS chars FROM conversations)
    SELECT role, count(DISTINCT conv_id) AS documents, CAST(sum(chars * 0.01 + 0.5 + chars * 0.02) AS DOUBLE) AS total, CAST(sum(chars * 0.01 + 0.5 + chars * 0.02) AS DOUBLE) / count(DISTINCT conv_id) AS cost FROM c GROUP BY 1""")
def cost_per_document(t: Tables):
    chars = F.char_length("text").cast("decimal(18,2)")
    price = lambda x: F.lit(x).cast("decimal(4,2)")
    rows = t.conversations.select("role", F.col("conv_id").alias("document"), (chars * price("0.01")).alias("compute"), price("0.50").alias("api"), price("0.00").alias("storage"), chars.alias("minutes"), price("0.02").alias("minute_price"))
    return Q.full_cost(rows, ["role"]).withColumn("total", F.col("total").cast("double"))


SNAPSHOT = """
    WITH d AS (SELECT lang, CAST(substr(source, 4) AS INT) AS version, doc_id, n_chars, text FROM documents), p AS (SELECT lang, version, arg_min(doc_id, doc_id) AS page, min(doc_id) AS f FROM d GROUP BY 1, 2),
    l AS (SELECT lang, version, len(string_split(x, ' ')) AS cells FROM (SELECT lang, version, unnest(string_split(text, chr(10))) AS x FROM d)), w AS (SELECT lang, version, count_if(cells >= 7) / count(*) AS whole_lines FROM l GROUP BY 1, 2),
    r AS (SELECT lang, version, count_if(n_chars > 4000) / count(*) AS doubtful, count_if(n_chars < 300) / count(*) AS unread FROM d GROUP BY 1, 2),
    s AS (SELECT p.lang, p.version, 8 AS columns, CASE WHEN f % 11 = 0 THEN 'unknown' WHEN f % 3 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, CAST(CASE WHEN f % 13 = 0 THEN 90 ELSE 0 END AS INT) AS rotation, whole_lines, doubtful, unread
        FROM p JOIN w ON w.lang = p.lang AND w.version = p.version JOIN r ON r.lang = p.lang AND r.version = p.version)
"""


def _snapshots(t: Tables):
    d = t.documents.select("lang", F.substring("source", 4, 10).cast("int").alias("version"), "doc_id", "n_chars", "text")
    keys, k = ["lang", "version"], F.col("doc_id")
    pages = d.select(*keys, k.alias("page"), F.when(k % 11 != 0, F.when(k % 3 == 0, 800).otherwise(500)).alias("width"), F.lit(600).alias("height"), F.when(k % 13 == 0, 90).otherwise(0).alias("rotation"))
    lines = d.select(*keys, F.explode(F.split("text", "\n")).alias("line")).select(*keys, F.size(F.split("line", " ")).alias("cells"))
    return C.form_snapshot(pages, lines, d.select(*keys, (F.col("n_chars") > 4000).cast("int").alias("doubts")), d.select(*keys, F.when(F.col("n_chars") < 300, "E_TYPE_EMPTY").alias("refusal")), keys, 8)


@query(SNAPSHOT + "SELECT * FROM s")
def form_snapshots(t: Tables):
    """What each language's form looks like in each of its versions (here sources): first page, whole lines, doubts, unread fields."""
    return _snapshots(t)


@query(SNAPSHOT + """SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.version + 1, b.version) AS version, CASE WHEN a.lang IS NULL OR b.lang IS NULL OR a.orientation <> b.orientation OR a.rotation <> b.rotation THEN 'different form'
    WHEN abs(a.whole_lines - b.whole_lines) > 0.1 OR abs(a.doubtful - b.doubtful) > 0.1 OR abs(a.unread - b.unread) > 0.1 THEN 'drift' ELSE 'same' END AS verdict FROM s a FULL JOIN s b ON a.lang = b.lang AND a.version + 1 = b.version""")
def form_drift(t: Tables):
    """Each version's snapshot against the one before it."""
    now = _snapshots(t)
    was = now.withColumn("version", F.col("version") + 1)
    return C.drift(was, now, ["lang", "version"], ["whole_lines", "doubtful", "unread"], [], ["columns", "orientation", "rotation"])


@query("""
    WITH e AS (SELECT event_type, event_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS s, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 1 END AS r FROM events)
    SELECT event_type AS kind, count_if(r = 1) AS single, count_if(r > 1) AS grouped, CAST(sum(r) AS BIGINT) AS records, CAST(sum(CASE WHEN r = 1 THEN s END) AS DOUBLE) / count_if(r = 1) AS seconds_per_record FROM e GROUP BY 1""")
def labour_by_kind(t: Tables):
    """Time between a user's events as an operator's time for a decision."""
    second = F.date_trunc("second", F.col("ts")).cast("timestamp").cast("long")
    took = second - F.lag(second).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select(F.col("event_type").alias("kind"), took.alias("seconds"), F.when(F.col("event_id") % 4 == 0, 3).otherwise(1).alias("records"))
    return Q.labour(rows, ["kind"])


@query("""
    WITH d AS (SELECT DISTINCT o_orderpriority AS kind, o_orderkey AS r FROM orders WHERE o_totalprice < 100000 OR o_orderkey % 7 = 0),
    n AS (SELECT kind, r, row_number() OVER (PARTITION BY kind ORDER BY r) - 1 AS pos, count(*) OVER (PARTITION BY kind) AS records FROM d),
    f AS (SELECT kind, string_agg(f, ',' ORDER BY f) AS fields FROM (SELECT DISTINCT o_orderpriority AS kind, unnest([CASE WHEN o_totalprice < 100000 THEN 'amount' END, CASE WHEN o_orderkey % 7 = 0 THEN 'date' END]) AS f FROM orders) WHERE f IS NOT NULL GROUP BY 1)
    SELECT n.kind, records, max(CASE WHEN pos = 0 THEN r END) AS first, max(CASE WHEN pos = records // 2 THEN r END) AS middle, max(CASE WHEN pos = records - 1 THEN r END) AS last, fields FROM n JOIN f ON f.kind = n.kind GROUP BY ALL""")
def doubt_groups(t: Tables):
    fields = F.array_compact(F.array(F.when(F.col("o_totalprice") < 100000, "amount"), F.when(F.col("o_orderkey") % 7 == 0, "date")))
    rows = t.orders.select(F.col("o_orderpriority").alias("kind"), "o_orderkey", F.explode(fields).alias("field"))
    return Q.doubt_groups(rows, "kind", "o_orderkey", "field").withColumn("fields", F.concat_ws(",", "fields"))


@query("""
    WITH a AS (SELECT doc_id, quality AS q, toxic AS x FROM labels WHERE doc_id % 31 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS q, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS x FROM labels WHERE doc_id % 37 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
        CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN NULL WHEN a.q = b.q THEN CAST(a.q AS VARCHAR) WHEN a.doc_id % 2 = 0 THEN CAST(b.q AS VARCHAR) ELSE CAST(a.q AS VARCHAR) END AS quality,
        CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN NULL ELSE CAST(a.x AS VARCHAR) END AS toxic,
        a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.x = b.x AND (a.q = b.q OR a.doc_id % 2 = 0) AS accepted FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def annotators_reconcile(t: Tables):
    """Two annotators and a third who settles some of their differences; what stays open rejects the row."""
    a = t.labels.where("doc_id % 31 <> 0")
    flip = lambda c, k: F.when(F.col("doc_id") % k == 0, 1 - F.col(c)).otherwise(F.col(c)).alias(c)
    b = t.labels.where("doc_id % 37 <> 0").select("doc_id", flip("quality", 5), flip("toxic", 7))
    told = b.where("doc_id % 2 = 0").select("doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value"))
    return C.gold(a, b, told, ["doc_id"], ["quality", "toxic"])


@query("""
    WITH a AS (SELECT doc_id, quality AS q FROM labels WHERE doc_id % 31 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS q FROM labels WHERE doc_id % 37 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'UNKNOWN' WHEN a.q = b.q THEN 'PASS' ELSE 'FAIL' END AS status, a.q AS first_value, b.q AS second_value FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def readings_matched(t: Tables):
    """Two independent readings by address."""
    b = t.labels.where("doc_id % 37 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    return C.match_readings(t.labels.where("doc_id % 31 <> 0"), b, ["doc_id"], "quality")


@query("""
    WITH b AS (SELECT lang, n_chars // 1000 AS k FROM documents WHERE doc_id % 10 <> 3), a AS (SELECT lang, n_chars // 1000 AS k FROM documents WHERE doc_id % 10 <> 4),
    n AS (SELECT lang, k, sum(n) AS n FROM (SELECT lang, k, 1 AS n FROM b UNION ALL SELECT lang, k, -1 FROM a) GROUP BY 1, 2)
    SELECT lang, k, CASE WHEN n > 0 THEN 'before' ELSE 'after' END AS side, CAST(abs(n) AS BIGINT) AS times FROM n WHERE n <> 0""")
def preserved_payloads(t: Tables):
    """Multisets of payloads before and after a migration: what was lost, what was added."""
    rows = t.documents.select("doc_id", "lang", F.expr("n_chars div 1000").alias("k"))
    return C.multiset_diff(rows.where("doc_id % 10 <> 3").drop("doc_id"), rows.where("doc_id % 10 <> 4").drop("doc_id"))


@query("""
    WITH e AS (SELECT event_type, sum(value) AS s, count(*) AS n FROM events GROUP BY 1) SELECT event_type AS kind, CASE WHEN event_type <> 'view' THEN (n * 20.0::DOUBLE - s) / (n * 20.0::DOUBLE) END AS saved FROM e""".replace("sum(value) AS s", "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s"))
def labour_savings(t: Tables):
    """Time against a baseline of twenty seconds a decision; without a baseline nothing is told."""
    n = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("s"), F.count("*").alias("n"))
    return n.select("kind", Q.savings(F.col("s"), F.when(F.col("kind") != "view", F.col("n") * 20.0)).alias("saved"))
