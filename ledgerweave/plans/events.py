"""Journals, runs, batches, histories, canonical records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import values as V
from ledgerweave.operators import governance as G
from ledgerweave.operators import journal as J
from ledgerweave.operators import records as R
from ledgerweave.plans.registry import Tables, query


def _chain(t: Tables):
    rows = t.events.select("user_id", "event_id", F.concat_ws("|", "event_id", "event_type").alias("payload"))
    return J.chained(rows, "user_id", ["event_id"], "payload")


@query("""
    SELECT user_id, count(*) AS entries, CASE WHEN user_id % 10 = 3 THEN 1 ELSE 0 END AS broken, CASE WHEN user_id % 10 = 3 THEN 1 END AS first_broken FROM events GROUP BY 1""")
def hash_chain_verify(t: Tables):
    """A journal for each user; the first entry of some is tampered with."""
    tampered = (F.col("user_id") % 10 == 3) & (F.col("sequence") == 1)
    return J.verify_chain(_chain(t).withColumn("payload", F.when(tampered, "x").otherwise(F.col("payload"))), "user_id", "payload")


@query("""
    WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT DISTINCT user_id, n // 20 AS part, NOT (user_id % 10 = 4 AND n // 20 = 1) AS linked FROM s""")
def journal_parts(t: Tables):
    """Parts of twenty entries; one part of some journals begins with another hash."""
    part = F.expr("sequence div 20")
    entries = _chain(t).withColumn("part", part)
    broken = (F.col("user_id") % 10 == 4) & (F.col("part") == 1)
    return J.verify_parts(entries.withColumn("previous_hash", F.when(broken, "x").otherwise(F.col("previous_hash"))), "user_id", "part")


@query("""
    WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'diverged' WHEN n = 10 THEN 'same' ELSE 'extended' END AS verdict, n - 10 AS since FROM n WHERE n >= 10""")
def pinned_head(t: Tables):
    entries = _chain(t)
    pins = entries.where("sequence = 10").select("user_id", F.col("sequence").alias("pinned_sequence"), F.when(F.col("user_id") % 5 == 0, "x").otherwise(F.col("hash")).alias("pinned_hash"))
    return J.compare_head(entries, pins, "user_id")


@query("""
    WITH e AS (SELECT user_id, event_id // 100 AS r, event_id, event_type IN ('purchase', 'signup') AS fin, CAST(value AS INT) % 2 AS p FROM events),
    n AS (SELECT user_id, r, count_if(fin) AS f, count(DISTINCT CASE WHEN fin THEN user_id % 3 * 0 + event_id % 2 END) AS d FROM e GROUP BY 1, 2)
    SELECT CASE WHEN f = 0 THEN 'unfinished' WHEN d > 1 THEN 'mismatch' WHEN f > 1 THEN 'repeat' ELSE 'finished' END AS state, count(*) AS keys FROM n GROUP BY 1""")
def run_registry(t: Tables):
    state = F.when(F.col("event_type").isin("purchase", "signup"), "finished").otherwise("started")
    rows = t.events.select(F.concat_ws("-", "user_id", F.expr("event_id div 100")).alias("key"), state.alias("state"), (F.col("event_id") % 2).cast("string").alias("fingerprint"), "ts", "event_id")
    return J.run_summary(rows, "key", ["ts", "event_id"])


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1")
def history_latest(t: Tables):
    return J.latest(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("""
    WITH e AS (SELECT event_id % 200 AS o, event_id, value FROM events), l AS (SELECT o, arg_max(value, event_id) AS v FROM e GROUP BY 1)
    SELECT o_orderkey, o_totalprice, coalesce(v, o_totalprice) AS corrected_o_totalprice FROM orders LEFT JOIN l ON o = o_orderkey""")
def corrected_copy(t: Tables):
    """Corrections are a layer of their own; the primary value stays beside the corrected one."""
    told = t.events.select((F.col("event_id") % 200).alias("o_orderkey"), "event_id", F.col("value").alias("new_value"))
    return J.corrected(t.orders.select("o_orderkey", "o_totalprice"), told, ["o_orderkey"], ["event_id"], "o_totalprice")


@query("""
    WITH m AS (SELECT o_orderkey, o_orderpriority AS g FROM orders), n AS (SELECT g, count(*) AS n FROM m GROUP BY 1)
    SELECT o_orderkey, m.g AS grp, 'accept' AS action FROM m WHERE g <> '3-MEDIUM' AND o_orderkey % 6 = 0""")
def group_decisions(t: Tables):
    """One decision for each group, where the group has as many members as expected; then some are taken back."""
    members = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("grp"))
    n = members.groupBy("grp").agg(F.count("*").alias("n"))
    told = n.select("grp", (F.col("n") + (F.col("grp") == "3-MEDIUM").cast("int")).alias("expected"), F.lit("accept").alias("action"))
    return J.undo(J.fan_out(told, members, "grp", "o_orderkey"), members.where("o_orderkey % 6 <> 0").select("o_orderkey"), "o_orderkey")


@query("""
    SELECT sha256(lower(text)) AS fingerprint, string_agg(DISTINCT source, ',' ORDER BY source) AS names, count(*) AS submissions FROM documents GROUP BY 1""")
def batch_upsert(t: Tables):
    return J.upsert_batch(t.documents.withColumn("fingerprint", F.sha2(F.lower("text"), 256)), "fingerprint", "source")


@query("""
    WITH f AS (SELECT source, CASE WHEN n_chars < 60 THEN 'failed' WHEN n_chars > 20000 THEN 'unparsed' WHEN n_chars > 15000 THEN 'review' ELSE 'ready' END AS s FROM documents)
    SELECT source, CASE WHEN count_if(s = 'failed') > 0 THEN 'failed' WHEN count_if(s = 'unparsed') > 0 THEN 'unparsed' WHEN count_if(s = 'review') > 0 THEN 'review' ELSE 'ready' END AS state FROM f GROUP BY 1""")
def batch_states(t: Tables):
    n = F.col("n_chars")
    return J.batch_state(t.documents.withColumn("s", F.when(n < 60, "failed").when(n > 20000, "unparsed").when(n > 15000, "review").otherwise("ready")), ["source"], "s")


@query("""
    WITH r AS (SELECT event_id % 700 AS k, arg_max(event_type, event_id) AS state FROM events GROUP BY 1) SELECT doc_id, coalesce(state, 'waiting') AS state FROM documents LEFT JOIN r ON k = doc_id""")
def batch_progress(t: Tables):
    runs = t.events.select((F.col("event_id") % 700).alias("doc_id"), "event_id", F.col("event_type").alias("state"))
    return J.batch_progress(t.documents.select("doc_id"), runs, "doc_id", ["event_id"])


STAGES = {"signup": (1, "accept"), "view": (2, "extract"), "click": (3, "assemble"), "purchase": (5, "decide"), "error": (4, "check")}


@query("""
    WITH s AS (SELECT user_id, event_id, value, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 WHEN 'error' THEN 4 END AS n,
        CASE event_type WHEN 'signup' THEN 'accept' WHEN 'view' THEN 'extract' WHEN 'click' THEN 'assemble' WHEN 'purchase' THEN 'decide' WHEN 'error' THEN 'check' END AS m FROM events)
    SELECT user_id, arg_max(m, n) AS stage, arg_min(m, event_id) FILTER (WHERE value > 50) AS first_failed, count_if(value <= 50) AS done FROM s WHERE n IS NOT NULL GROUP BY 1""")
def stage_rollup(t: Tables):
    return J.stage_rollup(t.events, "user_id", F.col("event_type"), F.col("value") <= 50, ["event_id"], STAGES)


@query("""
    WITH r AS (SELECT o_custkey AS k, o_orderkey AS version, CAST(o_orderdate AS DATE) AS issued, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 400 END AS archived FROM orders)
    SELECT k AS client, count(*) AS in_force, max(version) AS version FROM r WHERE issued <= DATE '1996-06-01' AND (archived IS NULL OR archived >= DATE '1996-06-01') GROUP BY 1""")
def template_asof(t: Tables):
    day = F.to_date("o_orderdate")
    rows = t.orders.select(F.col("o_custkey").alias("client"), F.col("o_orderkey").alias("version"), day.alias("issued"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(day, 400)).alias("archived"))
    asked = t.customer.select(F.col("c_custkey").alias("client"), F.lit("1996-06-01").cast("date").alias("asked"))
    return J.in_force(rows, asked, ["client"], "asked").groupBy("client").agg(F.count("*").alias("in_force"), F.max("version").alias("version"))


@query("""
    WITH o AS (SELECT o_custkey % 50 AS family, CASE o_orderstatus WHEN 'O' THEN 'client' WHEN 'F' THEN 'common' ELSE 'draft' END AS level, o_orderkey AS version FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY level, version DESC) AS n FROM o WHERE level <> 'draft') SELECT family, level, version FROM r WHERE n = 1""")
def template_level(t: Tables):
    level = F.when(F.col("o_orderstatus") == "O", "client").when(F.col("o_orderstatus") == "F", "common").otherwise("draft")
    rows = t.orders.select((F.col("o_custkey") % 50).alias("family"), level.alias("level"), F.col("o_orderkey").alias("version"))
    return J.best_level(rows, ["family"], ["client", "common"], "level", "version")


@query("""
    SELECT p_partkey, p_brand AS brand, CASE WHEN p_brand = 'Brand#11' THEN 'A-1' ELSE 'A-2' END AS advisory FROM part WHERE p_brand = 'Brand#11' OR (p_brand = 'Brand#12' AND p_size IN (1, 2, 3))""")
def vulnerability_feed(t: Tables):
    feed = t.spark.createDataFrame([("Brand#11", None, "A-1"), ("Brand#12", [1, 2, 3], "A-2")], "brand string, versions array<int>, advisory string")
    return J.exposed(t.part.select("p_partkey", F.col("p_brand").alias("brand"), "p_size"), feed, "brand", "p_size").select("p_partkey", "brand", "advisory")


@query("""
    SELECT source, count(*) AS documents, count_if(n_chars < 1000) * 100 // count(*) AS short_percent FROM documents GROUP BY 1""")
def outgoing_counters(t: Tables):
    """What may leave: a closed list of counters and whole percents."""
    return G.outgoing_counters(t.documents, ["source"], {"short": F.col("n_chars") < 1000})


@query("""
    WITH c AS (SELECT o_orderkey, '{"decision":"' || CASE WHEN o_orderstatus = 'O' THEN 'accepted' ELSE 'review' END || '","fields":{"amount":{"currency":"RUB","raw":"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '","value":"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
        || '"},"date":{"raw":"' || strftime(o_orderdate, '%Y-%m-%d') || '","value":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}},"record_id":"r' || o_orderkey || '","schema_version":"record/1","source_anchor_ids":["a' || o_orderkey || '"],"template_version":"1"}' AS j FROM orders)
    SELECT o_orderkey, sha256(j) AS record_sha256, CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS differences FROM c""")
def canonical_json_roundtrip(t: Tables):
    """Canonical JSON of each record, read back by another path and compared field by field; some values are tampered with."""
    amount, day = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = t.orders.select(
        "o_orderkey", F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"), F.array(F.concat(F.lit("a"), F.col("o_orderkey").cast("string"))).alias("source_anchor_ids"),
        F.lit("1").alias("template_version"), F.when(F.col("o_orderstatus") == "O", "accepted").otherwise("review").alias("decision"), amount.alias("amount"), day.alias("day"),
    )
    fields = {"amount": {"currency": F.lit("RUB"), "raw": F.col("amount"), "value": F.col("amount")}, "date": {"raw": F.col("day"), "value": F.col("day")}}
    made = rows.select("o_orderkey", R.canonical(F.col("record_id"), F.col("source_anchor_ids"), F.col("template_version"), F.col("decision"), fields).alias("json"))
    shown = made.select("o_orderkey", "json", F.when(F.col("o_orderkey") % 100 == 0, F.regexp_replace("json", '"raw":"(\\d)', '"raw":"9$1')).otherwise(F.col("json")).alias("other"))
    return shown.select("o_orderkey", F.sha2("json", 256).alias("record_sha256"), R.differences(F.col("json"), F.col("other"), ["amount"]).cast("int").alias("differences"))


@query("""
    WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) SELECT user_id, count(*) AS stalls, max(epoch_us(n) - epoch_us(ts)) / 1000000 AS longest FROM e WHERE (epoch_us(n) - epoch_us(ts)) / 1000000 >= 7200 GROUP BY 1""")
def stall_detection(t: Tables):
    return J.stalls(t.events, "user_id", "ts", 7200).groupBy("user_id").agg(F.count("*").alias("stalls"), F.max("seconds").alias("longest"))


@query("""
    WITH l AS (SELECT doc_id, list_filter(['apache', 'mit', 'gpl', 'bsd'], lambda x: regexp_matches(lower(text), '(^|[^a-z])' || x || '([^a-z]|$)')) AS found FROM documents)
    SELECT doc_id, array_to_string(found, ',') AS licences FROM l WHERE len(found) > 0""")
def licence_mentions(t: Tables):
    """Licences that a text names."""
    found = G.licence_mentions(F.col("text"), ("apache", "mit", "gpl", "bsd"))
    return t.documents.select("doc_id", F.concat_ws(",", found).alias("licences")).where("licences <> ''")


@query("""
    WITH s AS (SELECT user_id, event_id, coalesce(sum(length(props) + 20) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS part FROM events)
    SELECT user_id, CAST(part AS BIGINT) AS part, count(*) AS entries FROM s GROUP BY ALL""")
def journal_cut(t: Tables):
    """A journal's parts by size, here of 500 bytes."""
    rows = t.events.withColumn("sequence", F.col("event_id"))
    return J.cut_parts(rows, "user_id", F.char_length("props") + 20, 500).groupBy("user_id", "part").agg(F.count("*").alias("entries"))


@query("SELECT o_orderkey, sha256(concat_ws(chr(10), 'run/1', CAST(o_custkey AS VARCHAR), o_orderstatus, '', 'c1')) AS run_key FROM orders")
def run_keys(t: Tables):
    return t.orders.select("o_orderkey", V.run_key(F.col("o_custkey"), F.col("o_orderstatus"), F.lit(None).cast("string"), F.lit("c1")).alias("run_key"))
