"""Operators' actions, recovery, signatures, layout levels, streams, and folds whose SQL is recursive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave import manifest as M
from ledgerweave.functions import values as V
from ledgerweave.operators import compare as C
from ledgerweave.operators import coverage as E
from ledgerweave.operators import governance as G
from ledgerweave.operators import journal as J
from ledgerweave.operators import layout as L
from ledgerweave.operators import provenance as P
from ledgerweave.operators import recheck as K
from ledgerweave.operators import totals as T
from ledgerweave.plans.registry import Tables, query
from ledgerweave.streaming import watch
from ledgerweave.work import new_path

MONEY = "decimal(18,2)"


@query("""
    SELECT o_orderkey, chr(64257) || chr(160) || o_orderpriority || 'é' AS plain, 'fi ' || o_orderpriority || 'é' AS compat, true AS changed, 'A' || chr(7) || o_orderpriority AS kept, false AS unchanged FROM orders""")
def policy_normalised(t: Tables):
    """A ligature, a blank that doesn't break, a control and a decomposed letter under three policies of a field."""
    raw = F.concat(F.lit("ﬁ \x07"), F.col("o_orderpriority"), F.lit("é"))
    plain, compat = V.policy_text(raw), V.policy_text(raw, compat=True, nbsp="space")
    kept = V.policy_text(F.concat(F.lit("A\x07"), F.col("o_orderpriority")), keep_control=True)
    rows = t.orders.select("o_orderkey", plain.alias("p"), compat.alias("c"), kept.alias("k"))
    return rows.select("o_orderkey", F.col("p.value").alias("plain"), F.col("c.value").alias("compat"), F.col("c.compat_changed").alias("changed"), F.col("k.value").alias("kept"), F.col("k.compat_changed").alias("unchanged"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 5 = 0 AS ordinal, CASE WHEN l_partkey % 5 <> 0 THEN substr(sha256('{"document_id":"' || l_orderkey || '","page":' || l_linenumber || ',"place":"0.' || (l_partkey % 9) || ',0.5","role":"amount","system":"share","version":"anchor/1"}'), 1, 32) END AS anchor_id FROM lineitem""")
def anchors_made(t: Tables):
    """Stable addresses of places on a page; an address that counts items has none."""
    place = F.when(F.col("l_partkey") % 5 == 0, "table[1]/row[3]").otherwise(F.concat(F.lit("0."), (F.col("l_partkey") % 9).cast("string"), F.lit(",0.5")))
    made = P.anchor_id(F.col("l_orderkey").cast("string"), F.col("l_linenumber"), F.lit("amount"), F.lit("share"), place)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", V.ordinal_path(place).alias("ordinal"), made.alias("anchor_id"))


@query("""
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'built' ELSE c_name || ' ltd' END AS value FROM customer""")
def requisites_cleaned(t: Tables):
    """Requisites without their declared tail, through a vocabulary."""
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("c_name"), F.lit(" (page 1) "))).when(k == 1, "BUILDING (page 1)").otherwise(F.concat(F.col("c_name"), F.lit(" ltd")))
    return t.customer.select("c_custkey", L.cleaned_requisite(raw, "(page 1)", {"BUILDING": "built"}).alias("value"))


@query("""
    SELECT 'record' AS by, event_id FROM events WHERE user_id % 10 = 3 AND event_id % 50 = 7 UNION ALL SELECT 'document', event_id FROM events WHERE user_id = 5 UNION ALL SELECT 'anchor', event_id FROM events WHERE event_id % 20 IN (4, 5) UNION ALL SELECT 'all', event_id FROM events WHERE user_id = 5 AND event_id % 20 IN (4, 5)""")
def history_filtered(t: Tables):
    """Events of a record, of a document, of an anchor, and of both."""
    k = F.col("event_id") % 20
    events = t.events.select("event_id", F.concat_ws("-", F.col("user_id") % 10, F.col("event_id") % 50).alias("record_id"), F.col("user_id").cast("string").alias("document_id"), F.array(F.concat(F.lit("a"), k.cast("string")), F.concat(F.lit("a"), (k + 1).cast("string"))).alias("anchors"))
    of = lambda name, **how: G.history(events, **how).select(F.lit(name).alias("by"), "event_id")
    return of("record", record="3-7").unionByName(of("document", document="5")).unionByName(of("anchor", anchor="a5")).unionByName(of("all", document="5", anchor="a5"))


STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'accepted_auto' WHEN 1 THEN 'review' WHEN 2 THEN 'rejected' WHEN 3 THEN NULL WHEN 4 THEN 'review' ELSE 'rejected' END"
MANUAL = f"""
    WITH o AS (SELECT o_orderkey AS k, {STATUS} AS s, o_orderkey % 4 <> 3 AS asked, CASE WHEN o_orderkey % 7 = 0 THEN 'reject' WHEN o_orderkey % 7 = 1 THEN 'guess' ELSE 'accept' END AS a, o_orderkey % 11 = 0 AS blank FROM orders),
    r AS (SELECT *, CASE WHEN NOT asked THEN NULL WHEN s IS NULL THEN 'E_NO_STATUS' WHEN s NOT IN ('review', 'rejected') THEN 'E_TRANSITION' WHEN blank THEN 'E_EVENT_INCOMPLETE' WHEN a = 'guess' THEN 'E_ACTION_UNKNOWN' END AS refusal FROM o),
    d AS (SELECT k, CASE WHEN asked AND refusal IS NULL THEN CASE a WHEN 'accept' THEN 'accepted_manual' ELSE 'rejected' END ELSE s END AS status, CASE WHEN asked AND refusal IS NULL THEN s END AS was, refusal FROM r)
"""


def _manual(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("accepted_auto", "review", "rejected", None, "review", "rejected"))), (k % 6 + 1).cast("int"))
    decisions = t.orders.select(k.alias("record_id"), status.alias("status"))
    said = F.when(k % 7 == 0, "reject").when(k % 7 == 1, "guess").otherwise("accept")
    asked = t.orders.where("o_orderkey % 4 <> 3")
    event = lambda n, action, basis: asked.select(k.alias("record_id"), action.alias("action"), F.lit("ann").alias("operator"), basis.alias("basis"), F.lit("2024-01-01").alias("time"), F.lit(n).alias("n"))
    events = event(1, F.lit("reject"), F.lit("seen")).unionByName(event(2, said, F.when(k % 11 == 0, " ").otherwise("checked by hand")))
    return J.manual(decisions, events, "record_id", ["n"])


@query(MANUAL + "SELECT k AS record_id, status, was, refusal FROM d")
def manual_decisions(t: Tables):
    """A person accepts or rejects what waits or was rejected; events without a basis, of an unknown kind, or against another status are refused."""
    return _manual(t).select("record_id", "status", "was", "refusal")


@query(MANUAL + "SELECT CASE WHEN status IN ('accepted_auto', 'accepted_manual') THEN 'accepted' WHEN status = 'rejected' THEN 'rejected' ELSE 'review' END AS decision, o_orderpriority AS priority, count(*) AS n FROM d JOIN orders ON o_orderkey = k GROUP BY ALL")
def stamped_records(t: Tables):
    """Decisions stamped into records; nothing else of them changes."""
    records = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("priority"), F.lit("review").alias("decision"))
    return J.stamped(records, _manual(t), "record_id").groupBy("decision", "priority").agg(F.count("*").alias("n"))


@query("""
    SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'kept' WHEN 1 THEN 'continued' WHEN 4 THEN 'replaced' ELSE 'lost' END AS verdict FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def past_survived(t: Tables):
    """Journals before and after an upgrade: kept, continued, cut short, gone, begun anew."""
    before = J.chained(t.events.select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")
    k, own = F.col("user_id") % 5, before.select("user_id", "sequence", "hash")
    top = own.groupBy("user_id").agg(F.max("sequence").alias("top"))
    more = top.where("user_id % 5 = 1").select("user_id", (F.col("top") + 1).alias("sequence"), F.lit("next").alias("hash"))
    same = own.join(top, "user_id").where((k != 3) & ((k != 2) | (F.col("sequence") < F.col("top"))))
    after = same.select("user_id", "sequence", F.when(k == 4, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    return G.past_survived(own, after.unionByName(more), "user_id")


@query("""
    WITH u AS (SELECT user_id AS s, user_id % 6 AS m FROM events GROUP BY ALL)
    SELECT s, CASE m WHEN 0 THEN 'finished' WHEN 1 THEN 'run again' WHEN 2 THEN 'journal broken' WHEN 3 THEN 'no room' WHEN 4 THEN 'no room' ELSE 'journal broken' END AS verdict,
           CASE m WHEN 1 THEN 'E_RESULT_INCOMPLETE' WHEN 2 THEN 'E_JOURNAL_BROKEN' WHEN 3 THEN 'E_NOT_WRITABLE' WHEN 4 THEN 'E_NO_SPACE' WHEN 5 THEN 'E_JOURNAL_PARTS' ELSE '' END AS codes FROM u
    UNION ALL SELECT -1, 'no journal', 'E_JOURNAL_MISSING,E_NOT_WRITABLE,E_NO_SPACE'""")
def recovery_verdicts(t: Tables):
    """After a stop: chains that hold or don't, parts that aren't linked, results that are whole or not, folders without room."""
    m = F.col("s") % 6
    chain = J.chained(t.events.select(F.col("user_id").alias("s"), "event_id", "event_type"), "s", ["event_id"], "event_type")
    entries = J.verify_chain(chain.withColumn("event_type", F.when((m == 2) & (F.col("sequence") == 2), "x").otherwise(F.col("event_type"))), "s", "event_type")
    streams = entries.select("s")
    lone = t.spark.createDataFrame([(-1, True)], "s long, complete boolean")
    results = streams.select("s", (m != 1).alias("complete")).unionByName(lone)
    parts = streams.select("s", F.lit(2).alias("part"), (m != 5).alias("linked"))
    space = streams.select("s", (m != 3).alias("writable"), F.when(m == 4, 5).otherwise(500).cast("long").alias("free"))
    return P.recovery(entries, "s", results, parts, space, 100)


@query("""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'convert' WHEN 2 THEN 'go back to p' || p_partkey ELSE 'rebuild for 2.0' END AS action FROM part""")
def upgrade_actions(t: Tables):
    """What owners of packages do after an upgrade."""
    k = F.col("p_size") % 4
    language = F.when(k == 0, "lang/2").when(k == 1, "lang/1").otherwise("lang/0")
    return t.part.select("p_partkey", G.upgrade_action(language, ("lang/2", "lang/3"), {"lang/1": "lang/2", "lang/0": "lang/9"}, F.when(k == 2, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))), "2.0").alias("action"))


KEY, OTHER = bytes(range(32)), bytes(range(1, 33))


@query("""
    SELECT CAST(n_nationkey AS VARCHAR) AS document_id, CASE n_nationkey % 6 WHEN 1 THEN 'E_MANIFEST_SIGNATURE' WHEN 2 THEN 'E_MANIFEST_POSITIONS,E_MANIFEST_SIGNATURE' WHEN 3 THEN 'E_MANIFEST_NAMES' WHEN 4 THEN 'E_MANIFEST_KEY' WHEN 5 THEN 'E_MANIFEST_DAMAGED' ELSE '' END AS faults FROM nation""")
def manifests_checked(t: Tables):
    """A signed manifest of each nation's parts, sound, changed, numbered anew, with one name twice, under another key, cut off."""
    k = F.col("n_nationkey") % 6
    part = lambda name, of: F.struct(name.alias("name"), F.sha2(of, 256).alias("sha256"))
    parts = t.nation.select(F.col("n_nationkey").cast("string").alias("document_id"), k.alias("k"), F.array(part(F.lit("a"), F.col("n_name")), part(F.when(k == 3, "a").otherwise("b"), F.lit("x"))).alias("parts"))
    made = M.build_manifests(parts.where("k <> 4"), KEY).unionByName(M.build_manifests(parts.where("k = 4"), OTHER))
    m, own = F.col("manifest"), F.col("document_id").cast("int") % 6
    changed = F.when(own == 1, F.replace(m, F.lit('"name": "b"'), F.lit('"name": "c"'))).when(own == 2, F.replace(m, F.lit('"position": 2'), F.lit('"position": 3'))).when(own == 5, F.substring(m, 1, 50)).otherwise(m)
    told = M.check_manifests(made.select("document_id", changed.alias("manifest")), M.public_key(KEY))
    return told.select("document_id", F.concat_ws(",", "faults").alias("faults"))


@query("""
    SELECT CAST(n_nationkey AS VARCHAR) AS document_id, CASE n_nationkey % 5 WHEN 1 THEN 'E_RIGHT_SIGNATURE' WHEN 2 THEN 'E_RIGHT_DATES' WHEN 3 THEN 'E_RIGHT_OWNER' WHEN 4 THEN 'E_RIGHT_FAMILY' ELSE '' END AS faults FROM nation""")
def rights_checked(t: Tables):
    """Signed rights of use: sound, with changed dates, over, of another owner, for other families."""
    k = F.col("n_nationkey") % 5
    rows = t.nation.select(F.col("n_nationkey").cast("string").alias("document_id"), F.col("n_name").alias("owner"), F.array(F.lit("f1"), F.lit("f2")).alias("families"), F.lit("2024-01-01").alias("from"), F.when(k == 2, "2024-02-01").otherwise("2024-12-31").alias("to"))
    made = M.sign_rights(rows, KEY).join(t.nation.select(F.col("n_nationkey").cast("string").alias("document_id"), "n_name"), "document_id")
    k = F.col("document_id").cast("int") % 5
    right = F.when(k == 1, F.replace("right", F.lit("2024-12-31"), F.lit("2025-12-31"))).otherwise(F.col("right"))
    told = M.check_rights(made.select("document_id", right.alias("right"), F.when(k == 3, "someone").otherwise(F.col("n_name")).alias("owner"), F.when(k == 4, "f9").otherwise("f2").alias("family")), "2024-06-01", M.public_key(KEY))
    return told.select("document_id", F.concat_ws(",", "faults").alias("faults"))


@query("""
    SELECT o_orderpriority AS kind, string_agg(DISTINCT f, ',' ORDER BY f) AS fields FROM (SELECT o_orderpriority, unnest([CASE WHEN o_totalprice < 100000 THEN 'amount' END, CASE WHEN o_orderkey % 7 = 0 THEN 'date' END]) AS f FROM orders) WHERE f IS NOT NULL GROUP BY 1""")
def critical_in_groups(t: Tables):
    """The critical fields that each group of doubts touches; notes aren't critical."""
    fields = F.array_compact(F.array(F.when(F.col("o_totalprice") < 100000, "amount"), F.when(F.col("o_orderkey") % 7 == 0, "date"), F.lit("note")))
    return K.critical_fields(t.orders.select(F.col("o_orderpriority").alias("kind"), F.explode(fields).alias("field")), "kind", "field", ["amount", "date"])


@query("""
    SELECT o_orderkey, 'line' AS kind FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 AND n <> 4""")
def estimates_disputed(t: Tables):
    """Orders for which two estimates of their lines differ."""
    counted = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("expected"))
    declared = counted.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(4).cast("long").alias("expected"))
    return E.disputes(counted.unionByName(declared).withColumn("kind", F.lit("line")), ["o_orderkey"])


@query("""
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN 'extra' ELSE 'amount' END AS path, CASE o_orderkey % 6 WHEN 1 THEN 'value' WHEN 2 THEN 'type' WHEN 3 THEN 'missing' ELSE 'extra' END AS kind FROM orders WHERE o_orderkey % 6 IN (1, 2, 3, 4)""")
def field_diffs(t: Tables):
    """Two trees of fields compared by path: another value, another type, a field that is missing, one too many."""
    k = F.col("o_orderkey") % 6
    cell = lambda path, kind, value: F.struct(path.alias("path"), kind.alias("type"), value.alias("value"))
    day, amount = cell(F.lit("day"), F.lit("date"), F.col("o_orderdate").cast("string")), F.col("o_totalprice").cast(MONEY).cast("string")
    first = t.orders.select("o_orderkey", F.explode(F.array(day, cell(F.lit("amount"), F.lit("money"), amount))).alias("c")).select("o_orderkey", "c.*")
    other = F.array_compact(F.array(day, F.when(k != 3, cell(F.lit("amount"), F.when(k == 2, "text").otherwise("money"), F.when(k == 1, "0").otherwise(amount))), F.when(k == 4, cell(F.lit("extra"), F.lit("text"), F.lit("x")))))
    return C.field_diff(first, t.orders.select("o_orderkey", F.explode(other).alias("c")).select("o_orderkey", "c.*"), ["o_orderkey"])


@query("SELECT 'scoped' AS total, count(*) AS n FROM orders WHERE o_orderkey % 10 < 4 UNION ALL SELECT 'whole', count(*) FROM orders")
def scope_of_totals(t: Tables):
    """Records that a total covers: those of its scope, or all where it has none."""
    scopes = t.orders.where("o_orderkey % 10 < 4").select("o_orderkey", F.lit("scoped").alias("name"))
    one = lambda name: T.in_scope(t.orders.select("o_orderkey"), scopes, "o_orderkey", name).agg(F.count("*").alias("n")).select(F.lit(name).alias("total"), "n")
    return one("scoped").unionByName(one("whole"))


@query("""
    WITH o AS (SELECT user_id AS d, event_id % 5 AS m, event_id, event_type FROM events)
    SELECT d, 'p' || event_id AS line, 'record' AS place, 'a=' || event_type || ';b=' || event_id AS cells, false AS unparsed FROM o WHERE event_type = 'view' UNION ALL
    SELECT d, 'message[' || m || ']', 'message', string_agg('t=' || event_type, ';' ORDER BY lpad(CAST(event_id AS VARCHAR), 9, '0')), false FROM o WHERE event_type IN ('click', 'purchase') GROUP BY d, m UNION ALL
    SELECT d, 'p' || event_id, 'none', event_type, true FROM o WHERE event_type NOT IN ('view', 'click', 'purchase')""")
def message_lines(t: Tables):
    """Whole records as lines of their own, the fields of a message as one line, the rest told as unparsed."""
    kind, own = F.col("event_type"), F.col("event_id").cast("string")
    is_record, is_field = kind == "view", kind.isin("click", "purchase")
    path = F.when(is_field, F.lpad(own, 9, "0")).otherwise(F.concat(F.lit("p"), own))
    rows = t.events.select(F.col("user_id").alias("d"), (F.col("event_id") % 5).alias("page"), path.alias("path"), F.when(is_record, "record").otherwise("object").alias("kind"), kind.alias("text"), F.when(is_record, F.create_map(F.lit("b"), own, F.lit("a"), kind)).otherwise(F.create_map().cast("map<string,string>")).alias("cells"), F.when(is_field, "t").alias("label"))
    told = L.whole_lines(rows, ["d"], "page", "path", "kind", "text", "cells", "label")
    return told.select("d", "line", "place", F.concat_ws(";", "cells").alias("cells"), "unparsed")


LEVELS = [("neighbours", 3), ("table", 12), ("page", 120)]


@query("""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT *, 'f' || n AS field FROM l)
    SELECT doc_id, n, 'field' AS level, sha256(field) AS shown, 0 AS at FROM f UNION ALL SELECT doc_id, n, 'line', sha256(line), 0 FROM f UNION ALL """ + " UNION ALL ".join(
    f"SELECT doc_id, n, '{name}', sha256(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN {most // 2} PRECEDING AND {most - most // 2 - 1} FOLLOWING)), CAST(least(n, {most // 2}) AS INT) FROM f" for name, most in LEVELS))
def context_levels(t: Tables):
    """What each of the five levels shows around every line of every document."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("field", F.concat(F.lit("f"), F.col("n").cast("string")))
    told = L.context_levels(lines, ["doc_id"], ["n"], "line", "field")
    return told.select("doc_id", "n", "level", F.sha2(F.array_join("shown", "\n"), 256).alias("shown"), "at")


# Streams over the events, run to their end; what they wrote is read back.


def _stream(t: Tables, files: int | None = None) -> DataFrame:
    """The events as a stream from a folder: in one batch, or in as many as there are files."""
    rows, path = t.events, new_path(t.spark, "stream")
    (rows.repartition(files, "event_id") if files else rows).write.parquet(path)
    reader = t.spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", 1) if files else reader).parquet(path)


def _to_the_end(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    path = new_path(t.spark, name)
    writer = rows.writeStream.option("checkpointLocation", new_path(t.spark, f"{name}-state")).trigger(availableNow=True).format("parquet").option("path", path)
    writer.start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(path)


def _each_batch(t: Tables, rows: DataFrame, name: str, write) -> None:
    rows.writeStream.option("checkpointLocation", new_path(t.spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


@query("""
    WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
    SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS silent_from, (epoch_us(n) - epoch_us(ts)) / 1000000 AS seconds FROM e WHERE (epoch_us(n) - epoch_us(ts)) / 1000000 >= 7200
    UNION ALL SELECT CAST(user_id AS VARCHAR), strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f'), 7200.0 FROM events, w GROUP BY user_id, mark HAVING date_trunc('millisecond', max(ts)) + INTERVAL 2 HOUR < date_trunc('millisecond', mark)""")
def stream_stalls(t: Tables):
    """Silences of two hours between a user's events as a stream tells them, and those that last beyond its watermark."""
    out = _to_the_end(t, watch.watch_stalls(_stream(t), "user_id", "ts", 7200), "stalls")
    return out.select("key", F.date_format("silent_from", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("silent_from"), "seconds")


@query("""
    WITH r AS (SELECT CAST(event_id // 3 AS VARCHAR) AS key, event_type AS fingerprint, row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_type) AS n, first(event_type) OVER (PARTITION BY event_id // 3 ORDER BY ts, event_type) AS f FROM events)
    SELECT key, CASE WHEN n = 1 THEN 'first' WHEN fingerprint = f THEN 'repeat' ELSE 'mismatch' END AS verdict, fingerprint, count(*) AS n FROM r GROUP BY ALL""")
def stream_runs(t: Tables):
    """Runs that come again in a stream: with their first fingerprint, or with another."""
    rows = _stream(t).select(F.expr("event_id div 3").alias("run"), "event_type", "ts")
    out = _to_the_end(t, watch.watch_runs(rows, "run", "event_type", "ts"), "runs")
    return out.groupBy("key", "verdict", "fingerprint").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS entries, 0 AS broken FROM events GROUP BY 1")
def stream_journal(t: Tables):
    """A journal for each user, appended to as the stream comes, its tail checked alone; then the whole chain is verified."""
    path = new_path(t.spark, "journal")
    _each_batch(t, _stream(t, 3).select("user_id", "event_id", "event_type"), "journal", watch.append_chained(path, "user_id", ["event_id"], "event_type"))
    entries = t.spark.read.parquet(f"{path}/entries")
    return J.verify_chain(entries, "user_id", "event_type").select("user_id", "entries", F.col("broken").cast("int").alias("broken"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names, count(*) AS submissions FROM events GROUP BY 1")
def stream_batches(t: Tables):
    """Submissions that grow a batch: one file for each fingerprint, with all names that it came under."""
    path = new_path(t.spark, "batches")
    _each_batch(t, _stream(t, 3).select("user_id", "event_type"), "batches", watch.grow_batch(path, "user_id", "event_type"))
    return watch.read_batch(t.spark.read.parquet(path), "user_id")
