"""Checks of records and of document sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import values as V
from ledgerweave.operators import coverage as C
from ledgerweave.operators import rules as R
from ledgerweave.operators import totals as T
from ledgerweave.plans.registry import Tables, query

MONEY = "decimal(18,2)"


def text(c):
    """Decimals leave as text: the same digits in every engine."""
    return F.col(c).cast("decimal(38,2)").cast("string").alias(c) if isinstance(c, str) else c.cast("decimal(38,2)").cast("string")


@query("""
    WITH r AS (SELECT o_orderkey, o_orderkey % 11 AS k, o_orderpriority AS p FROM orders)
    SELECT field, rule_id, status, count(*) AS n FROM (
        SELECT 'amount' AS field, 'presence' AS rule_id, CASE WHEN k = 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM r
        UNION ALL SELECT 'amount', 'empty_value', 'FAIL' FROM r WHERE k = 2
        UNION ALL SELECT 'amount', 'uninterpreted', 'FAIL' FROM r WHERE k = 3
        UNION ALL SELECT 'amount', 'type', CASE WHEN k = 4 THEN 'FAIL' ELSE 'PASS' END FROM r WHERE k NOT IN (1, 2, 3)
        UNION ALL SELECT 'amount', 'precision', CASE WHEN k = 5 THEN 'FAIL' ELSE 'PASS' END FROM r WHERE k NOT IN (1, 2, 3)
        UNION ALL SELECT 'priority', 'presence', 'PASS' FROM r
        UNION ALL SELECT 'priority', 'type', 'PASS' FROM r
        UNION ALL SELECT 'priority', 'vocabulary', CASE WHEN p = '4-NOT SPECIFIED' THEN 'FAIL' ELSE 'PASS' END FROM r
        UNION ALL SELECT 'note', 'presence', 'PASS' FROM r
        UNION ALL SELECT 'extra', 'unknown_field', 'FAIL' FROM r WHERE k = 6) GROUP BY ALL""")
def schema_check(t: Tables):
    """Orders' fields in long form: missing, empty, uninterpreted, of another type, too precise, unknown."""
    k = F.col("o_orderkey") % 11
    cell = lambda raw, kind, refusal, value, digits: F.struct(raw.alias("raw"), kind.alias("kind"), refusal.alias("refusal"), value.alias("value_text"), digits.alias("digits"))
    amount = F.col("o_totalprice").cast(MONEY).cast("string")
    none = F.lit(None).cast("string")
    cells = {
        "amount": F.when(k != 1, cell(F.when(k == 2, " ").when(k == 3, "n/a").otherwise(amount), F.when(k == 4, "text").otherwise("money"), F.when(k == 3, "E_TYPE_NOT_A_NUMBER"), amount, F.when(k == 5, 3).otherwise(2))),
        "priority": cell(F.col("o_orderpriority"), F.lit("vocabulary"), none, F.col("o_orderpriority"), F.lit(None).cast("int")),
        "extra": F.when(k == 6, cell(amount, F.lit("money"), none, amount, F.lit(2))),
    }
    spec = [R.Field("amount", "money", True, max_digits=2), R.Field("priority", "vocabulary", True, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")), R.Field("note", "text")]
    return R.schema_check(t.orders, ["o_orderkey"], spec, cells).groupBy("field", "rule_id", "status").agg(F.count("*").alias("n"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN count(*) > 1 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS records FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def duplicates_parse(t: Tables):
    return R.parse_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""
    WITH d AS (SELECT sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS content_hash, doc_id FROM documents)
    SELECT content_hash, CASE WHEN count(DISTINCT doc_id) > 1 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS records, count(DISTINCT doc_id) AS addresses FROM d GROUP BY content_hash""")
def duplicates_source(t: Tables):
    return R.source_duplicates(t.documents, V.collapsed(F.lower("text")), "doc_id", "forbidden")


@query("""
    WITH e AS (SELECT user_id, value > coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS wrong FROM events)
    SELECT user_id, CASE WHEN count_if(wrong) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count_if(wrong) AS inversions FROM e GROUP BY user_id""")
def order_inversions(t: Tables):
    """Values of each user's events should ascend in time; every adjacent inversion counts."""
    return R.order_check(t.events, ["user_id"], ["ts", "event_id"], "value", "ascending")


@query("""
    SELECT user_id, ts, event_id, before, after FROM (SELECT user_id, ts, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, value AS after FROM events) WHERE before > after""")
def order_inversions_listed(t: Tables):
    """Every inversion, a row for each."""
    return R.inversions(t.events, ["user_id"], ["ts", "event_id"], "value", "ascending")


@query("""
    WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), s AS (SELECT l_orderkey, max(n) - min(n) + 1 - count(*) AS missing, min(n) AS low, max(n) AS high, list(n) AS held FROM e GROUP BY l_orderkey),
    g AS (SELECT l_orderkey, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) - n > 1 AS hole FROM e), r AS (SELECT l_orderkey, count_if(coalesce(hole, false)) AS runs FROM g GROUP BY 1)
    SELECT s.l_orderkey, CASE WHEN missing > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(missing AS BIGINT) AS missing, runs, array_to_string(list_filter(range(low, high), lambda x: NOT list_contains(held, x)), ',') AS first FROM s JOIN r ON r.l_orderkey = s.l_orderkey""")
def number_gaps(t: Tables):
    return R.gap_check(t.lineitem, ["l_orderkey"], "l_linenumber", "forbidden").withColumn("first", F.concat_ws(",", "first"))


@query("""
    WITH e AS (SELECT DISTINCT user_id, event_id AS n FROM events), s AS (SELECT user_id, max(n) - min(n) + 1 - count(*) AS missing, min(n) AS low, list(n) AS held FROM e GROUP BY 1),
    p AS (SELECT * FROM (VALUES ('allowed', 'PASS'), ('forbidden', 'FAIL'), ('undeclared', 'UNKNOWN'), ('not_a_sequence', 'PASS'), ('no_basis', 'UNKNOWN')) v(policy, found))
    SELECT policy, user_id, CASE WHEN missing > 0 OR policy IN ('undeclared', 'not_a_sequence', 'no_basis') THEN found ELSE 'PASS' END AS status, array_to_string(list_slice(list_filter(range(low, low + 400 + len(held)), lambda x: NOT list_contains(held, x) AND x < list_max(held)), 1, 20), ',') AS first FROM s, p""")
def gap_policies(t: Tables):
    """Gaps in each user's event numbers under every declaration; the first twenty missing numbers are named."""
    policies, out = {"allowed": ("allowed", None), "forbidden": ("forbidden", None), "undeclared": (None, None), "not_a_sequence": ("not_a_sequence", "numbers of other documents"), "no_basis": ("not_a_sequence", None)}, None
    for name, (policy, basis) in policies.items():
        one = R.gap_check(t.events, ["user_id"], "event_id", policy, basis).select(F.lit(name).alias("policy"), "user_id", "status", F.concat_ws(",", "first").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    WITH l AS (SELECT s_nationkey AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, l_returnflag AS f FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    s AS (SELECT n, sum(CASE WHEN f IN ('A', 'N') THEN a ELSE 0 END) AS i, sum(CASE WHEN f = 'R' THEN a ELSE 0 END) AS o FROM l GROUP BY n)
    SELECT n_name AS currency, CASE WHEN n_nationkey % 5 = 4 THEN 'UNKNOWN' WHEN n_nationkey = 3 THEN 'FAIL' ELSE 'PASS' END AS status,
           CAST(CAST(i - o AS DECIMAL(38,2)) AS VARCHAR) AS computed,
           CASE WHEN n_nationkey % 5 <> 4 THEN CAST(CAST(i - o + CASE WHEN n_nationkey = 3 THEN 0.01 ELSE 0 END AS DECIMAL(38,2)) AS VARCHAR) END AS closing
    FROM s JOIN nation ON n_nationkey = n""")
def balance_by_currency(t: Tables):
    """Each nation stands for a currency. Closing totals come from an aggregate of their own; one is a cent off, some are missing."""
    l = t.lineitem.select("l_suppkey", F.col("l_extendedprice").cast(MONEY).alias("a"), "l_returnflag")
    where = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    named = l.join(where, "l_suppkey").withColumn("document", F.lit(1))
    records = named.select("document", F.col("s_nationkey").alias("currency"), T.side(F.col("a"), F.col("l_returnflag"), ["A", "N"], ["R"]).alias("s")).select("document", "currency", "s.*")
    signed = F.sum(F.when(F.col("l_returnflag") == "R", -F.col("a")).otherwise(F.col("a"))).cast("decimal(38,2)")
    closing = named.groupBy("document", F.col("s_nationkey").alias("currency")).agg(signed.alias("v")).where("currency % 5 <> 4")
    cent = F.when(F.col("currency") == 3, F.lit("0.01")).otherwise(F.lit("0.00")).cast("decimal(38,2)")
    ends = closing.select("document", F.lit("closing").alias("name"), "currency", (F.col("v") + cent).cast("decimal(38,2)").alias("value"))
    starts = t.nation.select(F.lit(1).alias("document"), F.lit("opening").alias("name"), F.col("n_nationkey").alias("currency"), F.lit("0.00").cast("decimal(38,2)").alias("value"))
    out = T.balance(records, ends.unionByName(starts), ["document"]).join(F.broadcast(t.nation), F.col("currency") == F.col("n_nationkey"))
    used = out.join(named.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    return used.select(F.col("n_name").alias("currency"), "status", text("computed"), text("closing"))


@query("""
    WITH l AS (SELECT l_orderkey AS k, l_linenumber, l_orderkey % 6 AS m, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(CAST(l_discount AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(38,4)) AS r FROM lineitem),
    s AS (SELECT k, m, CAST(sum(p * r) AS DECIMAL(38,6)) AS c, count(*) AS n FROM l GROUP BY 1, 2),
    v AS (SELECT k, CASE m WHEN 0 THEN CAST(round(c, 2) AS DECIMAL(38,6)) WHEN 1 THEN c WHEN 2 THEN CAST(c + 0.000001 AS DECIMAL(38,6)) WHEN 4 THEN 0 WHEN 5 THEN NULL ELSE c END AS v, c, m FROM s)
    SELECT k AS document, CASE WHEN m IN (3, 4) THEN 'UNKNOWN' WHEN v IS NULL THEN 'UNKNOWN' WHEN v = c THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN m = 4 THEN NULL ELSE CAST(c AS VARCHAR) END AS computed, CAST(v AS VARCHAR) AS declared FROM v""")
def exact_control_totals(t: Tables):
    """Amounts of six digits after the point: a total that was rounded, or is off in the last digit, fails; amounts that weren't read and sums beyond 38 digits are UNKNOWN."""
    k, price = F.col("l_orderkey") % 6, F.col("l_extendedprice").cast(MONEY)
    amount = (price * (F.col("l_discount").cast(MONEY) * F.col("l_tax").cast(MONEY)).cast("decimal(9,4)")).cast("decimal(38,6)")
    rows = t.lineitem.select(F.col("l_orderkey").alias("document"), k.alias("m"), amount.alias("amount"))
    total = rows.groupBy("document", "m").agg(F.sum("amount").alias("c"))
    one = F.lit("0.000001").cast("decimal(7,6)")
    six = lambda c: c.cast("decimal(38,6)")
    value = F.when(F.col("m") == 0, six(F.round("c", 2))).when(F.col("m") == 2, six(F.col("c") + one)).when(F.col("m") == 4, six(F.lit(0))).when(F.col("m") != 5, six(F.col("c")))
    whole = F.lit("9" * 32).cast("decimal(38,6)")
    huge = rows.where("m = 4").select("document", "m").distinct().select("document", F.explode(F.array_repeat(whole, 4)).alias("amount"))
    unread = rows.where("m = 3").select("document").distinct().withColumn("amount", F.lit(None).cast("decimal(38,6)"))
    own = rows.select("document", "amount").unionByName(huge).unionByName(unread)
    out = T.control_totals(own, total.select("document", value.alias("value")), ["document"])
    return out.select("document", "status", F.col("computed").cast("string").alias("computed"), F.col("declared").cast("string").alias("declared"))


@query("""
    WITH o AS (SELECT o_custkey AS document, o_orderpriority AS currency, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) / 8 AS a, o_custkey % 5 AS m FROM orders), e AS (SELECT document, currency, m, CAST(sum(CAST(a AS DECIMAL(38,5))) AS DECIMAL(38,5)) AS c FROM o GROUP BY 1, 2, 3)
    SELECT document, currency, CASE WHEN m = 1 THEN 'UNKNOWN' WHEN m = 2 AND round(c, 2) <> c THEN 'FAIL' ELSE 'PASS' END AS status, CAST(c AS VARCHAR) AS computed FROM e""")
def exact_balance(t: Tables):
    """Thousandths of a unit: exact sums hold, a closing balance that was rounded doesn't, and one record without a currency leaves the document open."""
    m = F.col("o_custkey") % 5
    amount = (F.col("o_totalprice").cast(MONEY) / 8).cast("decimal(38,5)")
    rows = t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("currency"), amount.alias("a"), m.alias("m"))
    sums = rows.groupBy("document", "currency", "m").agg(F.sum("a").alias("c"))
    ends = sums.select("document", F.lit("closing").alias("name"), "currency", F.when(F.col("m") == 2, F.round("c", 2).cast("decimal(38,5)")).otherwise(F.col("c")).alias("value"))
    starts = sums.select("document", F.lit("opening").alias("name"), "currency", F.lit(0).cast("decimal(38,5)").alias("value"))
    unnamed = rows.where("m = 1").select("document").distinct().select("document", F.lit(None).cast("string").alias("currency"), F.lit("1.00000").cast("decimal(38,5)").alias("a"))
    records = rows.select("document", "currency", "a").unionByName(unnamed).select("document", "currency", T.side(F.col("a")).alias("s")).select("document", "currency", "s.*")
    return T.balance(records, starts.unionByName(ends), ["document"]).select("document", "currency", "status", F.col("computed").cast("string").alias("computed"))


@query("""
    WITH n AS (SELECT c_nationkey AS k, count(*) AS n, count(DISTINCT c_mktsegment) AS s, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS t, count_if(c_custkey % 977 = 0) AS open FROM customer GROUP BY 1)
    SELECT k, CASE WHEN s > 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM n UNION ALL
    SELECT c_custkey + 100, CASE WHEN c_custkey % 977 = 0 THEN 'UNKNOWN' ELSE 'PASS' END FROM customer""")
def single_currency_sums(t: Tables):
    """Sums of nations, whose customers have several currencies (here segments), and of single customers, some without one."""
    rows = t.customer.select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_acctbal").cast(MONEY).alias("a"), F.col("c_mktsegment").alias("c"))
    lone = t.customer.select((F.col("c_custkey") + 100).alias("k"), F.col("c_acctbal").cast(MONEY).alias("a"), F.when(F.col("c_custkey") % 977 != 0, F.col("c_mktsegment")).alias("c"))
    return T.single_currency_sum(rows, ["k"], "a", "c").unionByName(T.single_currency_sum(lone, ["k"], "a", "c")).select("k", "status")


@query("""
    SELECT o_orderpriority AS p, trouble, CASE trouble WHEN 'no_value' THEN 'UNKNOWN' WHEN 'no_currency' THEN 'UNKNOWN' ELSE 'FAIL' END AS status, count(*) AS records FROM (
        SELECT o_orderpriority, CASE WHEN o_orderkey % 8 = 0 THEN 'no_value' WHEN o_orderkey % 8 = 1 THEN 'no_currency' END AS trouble FROM orders UNION ALL
        SELECT o_orderpriority, CASE WHEN o_orderkey % 8 = 2 THEN 'not_a_number' ELSE 'binary_fraction' END FROM orders) WHERE trouble IS NOT NULL GROUP BY ALL""")
def amounts_in_trouble(t: Tables):
    """The four troubles: decimals without a value or a currency, and doubles, which are no money whether finite or not."""
    k = F.col("o_orderkey") % 8
    exact = t.orders.select(F.col("o_orderpriority").alias("p"), F.when(k != 0, F.col("o_totalprice").cast(MONEY)).alias("a"), F.when(k != 1, "RUB").alias("c"))
    binary = t.orders.select(F.col("o_orderpriority").alias("p"), F.when(k == 2, float("nan")).otherwise(F.col("o_totalprice")).alias("a"), F.lit("RUB").alias("c"))
    return T.collect_amounts(exact, ["p"], "a", "c")[1].unionByName(T.collect_amounts(binary, ["p"], "a", "c")[1])


SET = """
    WITH r AS (SELECT l_orderkey AS d, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, l_returnflag = 'R' AS ret, l_quantity > 45 AS large, l_orderkey % 7 AS m FROM lineitem),
    s AS (SELECT d, m, sum(a) AS w, coalesce(sum(a) FILTER (ret), 0) AS x, coalesce(sum(a) FILTER (NOT ret), 0) AS y, coalesce(sum(a) FILTER (large), 0) AS z, count(*) AS n, count_if(ret) AS nx, count_if(NOT ret) AS ny, count_if(large) AS nz, count_if(large AND ret) + count_if(large AND NOT ret) AS twice,
        count_if(NOT ret) AS rest FROM r GROUP BY 1, 2),
    t AS (SELECT *, m = 3 AS bad FROM s),
    c AS (
        SELECT d, 'sum/control' AS rule_id, 'whole' AS name, CASE WHEN bad THEN 'UNKNOWN' WHEN m = 1 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN bad THEN NULL ELSE w END AS computed, w + CASE WHEN m = 1 THEN 1 ELSE 0 END AS declared, n AS records FROM t WHERE m <> 5
        UNION ALL SELECT d, 'sum/control', 'returned', CASE WHEN bad OR m = 6 THEN 'UNKNOWN' ELSE 'PASS' END, CASE WHEN bad THEN NULL ELSE x END, CASE WHEN m = 6 THEN NULL ELSE x END, CASE WHEN bad THEN NULL ELSE nx END FROM t WHERE m <> 5
        UNION ALL SELECT d, 'sum/control', 'kept', CASE WHEN bad THEN 'UNKNOWN' ELSE 'PASS' END, CASE WHEN bad THEN NULL ELSE y END, y, CASE WHEN bad THEN NULL ELSE ny END FROM t WHERE m NOT IN (2, 5)
        UNION ALL SELECT d, 'sum/control', 'large', 'PASS', z, z, nz FROM t WHERE m = 4
        UNION ALL SELECT d, 'sum/parts', 'whole', CASE WHEN p = v THEN 'PASS' ELSE 'FAIL' END, p, v, k FROM (SELECT d, w + CASE WHEN m = 1 THEN 1 ELSE 0 END AS v, CASE WHEN m = 6 THEN 0 ELSE x END + CASE WHEN m = 2 THEN 0 ELSE y END + CASE WHEN m = 4 THEN z ELSE 0 END AS p, CASE WHEN m IN (2, 6) THEN 1 WHEN m = 4 THEN 3 ELSE 2 END AS k FROM t WHERE m <> 5)
        UNION ALL SELECT d, 'money/no_value', NULL, 'UNKNOWN', NULL, NULL, 1 FROM t WHERE bad
        UNION ALL SELECT d, 'sum/declared', NULL, 'UNKNOWN', NULL, NULL, NULL FROM t WHERE m = 5
        UNION ALL SELECT d, CASE WHEN m = 4 AND twice > 0 THEN 'sum/overlap' ELSE 'sum/cover' END, NULL, CASE WHEN m = 4 AND twice > 0 THEN 'FAIL' WHEN m = 2 AND rest > 0 THEN 'UNKNOWN' ELSE 'PASS' END, NULL, NULL, CASE WHEN m = 4 AND twice > 0 THEN twice WHEN m = 2 AND rest > 0 THEN rest ELSE n END FROM t WHERE m NOT IN (3, 5))
"""


def _control_set(t: Tables):
    m = F.col("d") % 7
    lines = t.lineitem.select(F.col("l_orderkey").alias("d"), "l_linenumber", F.monotonically_increasing_id().alias("record"), F.lit("RUB").alias("currency"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("l_returnflag"), "l_quantity")
    unread = t.lineitem.select(F.col("l_orderkey").alias("d")).where("d % 7 = 3").distinct().select("d", F.lit(0).alias("l_linenumber"), F.lit(-1).cast("long").alias("record"), F.lit("RUB").alias("currency"), F.lit(None).cast(MONEY).alias("amount"), F.lit("-").alias("l_returnflag"), F.lit(0.0).alias("l_quantity"))
    returned, large = F.col("l_returnflag") == "R", F.col("l_quantity") > 45
    of = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(F.lit(0).cast(MONEY)))
    sums = lines.groupBy("d").agg(F.sum("amount").alias("w"), of(returned).alias("x"), of(~returned).alias("y"), of(large).alias("z"))
    total = lambda name, value, there: F.when(there, F.struct(F.lit(name).alias("name"), F.lit("RUB").alias("currency"), value.cast("decimal(38,2)").alias("value")))
    told = F.array_compact(F.array(total("whole", F.col("w") + F.when(m == 1, 1).otherwise(0), m != 5), total("returned", F.when(m != 6, F.col("x")), m != 5), total("kept", F.col("y"), ~m.isin(2, 5)), total("large", F.col("z"), m == 4)))
    declared = sums.select("d", F.explode(told).alias("t")).select("d", "t.*")
    return T.control_set(lines.unionByName(unread), declared, ["d"], "record", {"returned": returned, "kept": ~returned & (F.col("l_returnflag") != "-"), "large": large})


@query(SET + "SELECT d, rule_id, name, status, CAST(CAST(computed AS DECIMAL(38,2)) AS VARCHAR) AS computed, CAST(CAST(declared AS DECIMAL(38,2)) AS VARCHAR) AS declared, CAST(coalesce(records, CASE WHEN rule_id = 'sum/control' THEN -1 END) AS BIGINT) AS records FROM c")
def control_set(t: Tables):
    """Four control totals of each order: the whole, two parts that cover it, and in some a third that overlaps; some orders lack a part, a value, all totals, or an amount."""
    out = _control_set(t)
    hidden = (F.col("d") % 7 == 3) & (F.col("rule_id") == "sum/control") & (F.col("name") != "whole")
    return out.select("d", "rule_id", "name", "status", text("computed"), text("declared"), F.when(hidden, -1).otherwise(F.col("records")).alias("records"))


@query(SET + ", h AS (SELECT d, count_if(status <> 'PASS') = 0 AS control FROM c GROUP BY 1) SELECT d, control AND d % 4 <> 1 AS hold FROM h")
def totals_hold(t: Tables):
    """Whether all rules over totals pass: control sums, and a balance that doesn't close in a quarter of the orders."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("d"), F.col("l_extendedprice").cast(MONEY).alias("a"), F.lit("RUB").alias("currency"))
    records = lines.select("d", "currency", T.side(F.col("a")).alias("s")).select("d", "currency", "s.*")
    ends = lines.groupBy("d", "currency").agg(F.sum("a").alias("w"))
    cell = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("decimal(38,2)").alias("value"))
    declared = ends.select("d", "currency", F.explode(F.array(cell("opening", F.lit(0)), cell("closing", F.col("w") + F.when(F.col("d") % 4 == 1, 5).otherwise(0)))).alias("t")).select("d", "currency", "t.*")
    return T.totals_hold(T.totals_set(T.balance(records, declared, ["d"]), _control_set(t), ["d"]), ["d"])


CONTROL = """
    WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS c FROM lineitem {where} GROUP BY l_orderkey),
    d AS (SELECT o_orderkey, coalesce(c, 0) AS c, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE coalesce(c, 0) END AS v FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
    SELECT o_orderkey AS l_orderkey, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN v = c THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN v <> c THEN 'critical' ELSE 'fixable' END AS severity,
           CAST(CAST(c AS DECIMAL(38,2)) AS VARCHAR) AS computed, CAST(CAST(v AS DECIMAL(38,2)) AS VARCHAR) AS declared FROM d"""


def _control(t: Tables, condition=None):
    rows = t.lineitem.select("l_orderkey", F.col("l_extendedprice").cast(MONEY).alias("amount"), "l_returnflag")
    own = rows if condition is None else rows.where(condition)
    sums = own.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("amount").cast("decimal(38,2)").alias("s"))
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, None).when(k == 1, F.col("o_totalprice").cast("decimal(38,2)")).otherwise(F.coalesce("s", F.lit(0).cast("decimal(38,2)")))
    declared = t.orders.join(sums, "o_orderkey", "left").select(F.col("o_orderkey").alias("l_orderkey"), value.alias("value"))
    return T.control_totals(rows, declared, ["l_orderkey"], condition).select("l_orderkey", "status", "severity", text("computed"), text("declared"))


@query(CONTROL.format(where=""))
def control_totals(t: Tables):
    return _control(t)


@query(CONTROL.format(where="WHERE l_returnflag = 'R'"))
def control_totals_filtered(t: Tables):
    return _control(t, F.col("l_returnflag") == "R")


@query("""
    WITH o AS (SELECT c_nationkey AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    r AS (SELECT n_regionkey AS r, sum(s) AS s FROM o JOIN nation ON n_nationkey = n GROUP BY 1)
    SELECT r_name AS region, CASE WHEN r = 2 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(CAST(s AS DECIMAL(38,2)) AS VARCHAR) AS parts, CAST(CAST(s + CASE WHEN r = 2 THEN 1 ELSE 0 END AS DECIMAL(38,2)) AS VARCHAR) AS whole
    FROM r JOIN region ON r_regionkey = r""")
def parts_vs_whole(t: Tables):
    """Totals of nations against totals of regions; one region's declared total is off by one."""
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("c_nationkey", F.col("o_totalprice").cast(MONEY).alias("a"))
    nations = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"))
    parts = rows.groupBy("c_nationkey").agg(T.exact_sum(F.col("a")).alias("s")).join(nations, "c_nationkey")
    whole = rows.join(nations, "c_nationkey").groupBy("n_regionkey").agg(T.exact_sum(F.col("a")).alias("w")).withColumn("w", F.col("w") + F.when(F.col("n_regionkey") == 2, 1).otherwise(0))
    out = T.parts_vs_whole(parts, whole, ["n_regionkey"], "s", "w").join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("r_name").alias("region"), "status", text("parts"), text("whole"))


@query("""
    SELECT CASE WHEN o_orderkey % 10 < 4 AND o_orderkey % 3 = 0 THEN 'overlap' WHEN o_orderkey % 10 >= 4 AND o_orderkey % 3 <> 0 THEN 'uncovered' END AS cover, o_orderkey FROM orders WHERE cover IS NOT NULL""")
def scope_overlap_uncovered(t: Tables):
    a = t.orders.where("o_orderkey % 10 < 4").select("o_orderkey", F.lit("first").alias("name"))
    b = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("second").alias("name"))
    return T.scope_cover(t.orders, a.unionByName(b), "o_orderkey")


@query("""
    SELECT CASE WHEN l_linenumber = 7 THEN 'UNKNOWN' WHEN o_orderdate <= l_shipdate THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def cross_field_dates(t: Tables):
    """Shipping not earlier than the order; the seventh lines have no ship date."""
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    shipped = F.when(F.col("l_linenumber") != 7, F.col("l_shipdate"))
    out = R.apply_rules(rows, ["l_orderkey", "l_linenumber"], [R.Rule("ship_after_order", R.cross_field("date_order", shipped, F.col("o_orderdate"), "not_earlier"))])
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("""
    SELECT rule_id, status, count(*) AS n FROM (
        SELECT 'discount' AS rule_id, CASE WHEN CAST(l_discount AS DECIMAL(18,2)) BETWEEN 0.02 AND 0.09 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem
        UNION ALL SELECT 'quantity', CASE WHEN l_quantity <= 45 THEN 'PASS' ELSE 'FAIL' END FROM lineitem
        UNION ALL SELECT 'tax', 'UNKNOWN' FROM lineitem
        UNION ALL SELECT 'no_such_rule', 'UNKNOWN' FROM lineitem) GROUP BY ALL""")
def cross_field_bounds(t: Tables):
    """Bounds as decimal texts; without bounds, or of an unknown kind, a rule is UNKNOWN."""
    rules = [
        R.Rule("discount", R.cross_field("bounds", F.col("l_discount").cast(MONEY), "0.02", "0.09")), R.Rule("quantity", R.cross_field("bounds", F.col("l_quantity").cast(MONEY), None, "45")),
        R.Rule("tax", R.cross_field("bounds", F.col("l_tax"), None, None)), R.Rule("no_such_rule", R.cross_field("guess", F.col("l_tax"))),
    ]
    return R.apply_rules(t.lineitem, ["l_orderkey"], rules).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query("""
    SELECT event_type, CASE WHEN event_type = 'purchase' AND (value < 5 OR user_id % 4 = 0) THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n FROM events GROUP BY ALL""")
def cross_field_composition(t: Tables):
    """A purchase needs a value, and forbids a note that some users leave."""
    value, note = F.when(F.col("value") >= 5, F.col("value")), F.when(F.col("user_id") % 4 == 0, F.lit("note"))
    out = R.apply_rules(t.events, ["event_id", "event_type"], [R.Rule("composition", R.cross_field("composition", F.col("event_type"), ["purchase"], [value], [note]))])
    return out.groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("""
    SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag IN ('A', 'R') AND l_linestatus <> 'F' THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n FROM lineitem GROUP BY ALL""")
def cross_field_admissible(t: Tables):
    out = R.apply_rules(t.lineitem, ["l_returnflag", "l_linestatus"], [R.Rule("status", R.cross_field("admissible", F.col("l_returnflag"), ["A", "R"], F.col("l_linestatus"), ["F"]))])
    return out.groupBy("l_returnflag", "l_linestatus", "status").agg(F.count("*").alias("n"))


@query("""
    SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'UNKNOWN' WHEN c_nationkey = s_nationkey THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def currency_match(t: Tables):
    """Record and document currency, here the supplier's and the customer's nation; some documents declare none."""
    own = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    whole = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 13 != 0, F.col("c_nationkey")).alias("declared"))
    out = R.apply_rules(own.join(whole, "l_orderkey"), ["l_orderkey"], [R.Rule("currency", R.cross_field("currency_match", F.col("s_nationkey"), F.col("declared")))])
    return out.groupBy("status").agg(F.count("*").alias("n"))


def _coverage(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("line").alias("kind"))
    expected = lines.groupBy("l_orderkey", "kind").agg(F.max("l_linenumber").cast("long").alias("expected"))
    second = t.orders.where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("line").alias("kind"), F.lit(4).cast("long").alias("expected"))
    found = lines.dropDuplicates(["l_orderkey", "l_linenumber"]).where("l_linenumber <> 2")
    explained = lines.dropDuplicates(["l_orderkey", "l_linenumber"]).where("l_linenumber = 2")
    return C.coverage_map(expected.unionByName(second), found, explained, ["l_orderkey"])


COVERAGE = """
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
    e AS (SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS expected FROM d GROUP BY 1 UNION ALL SELECT o_orderkey, 4 FROM orders WHERE o_orderkey % 20 = 0),
    f AS (SELECT l_orderkey, count_if(l_linenumber <> 2) AS found, count_if(l_linenumber = 2) AS explained FROM d GROUP BY 1),
    c AS (SELECT e.l_orderkey, 'line' AS kind, expected, coalesce(found, 0) AS found, coalesce(explained, 0) AS explained, expected - coalesce(found, 0) - coalesce(explained, 0) AS unexplained FROM e LEFT JOIN f ON f.l_orderkey = e.l_orderkey)
"""


@query(COVERAGE + "SELECT * FROM c")
def coverage_map(t: Tables):
    """Expected lines of each order against found and explained ones; some orders have a second estimate."""
    return _coverage(t)


@query(COVERAGE + """, s AS (SELECT l_orderkey, count(DISTINCT expected) > 1 AS disputed, max(CAST(unexplained <> 0 AS INT)) AS open FROM c GROUP BY 1)
    SELECT o_orderkey AS l_orderkey, CASE WHEN open IS NULL OR disputed OR o_orderkey % 50 = 7 THEN 'unknown' WHEN open > 0 THEN 'partial' ELSE 'complete' END AS completeness FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def completeness_status(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return C.completeness(orders, _coverage(t), ["l_orderkey"], doubts=orders.where("l_orderkey % 50 = 7"))


@query("""
    SELECT l_orderkey, count(*) AS fields, count_if(l_partkey % 6 <> 0) AS with_address, count_if(l_partkey % 12 = 0) = 0 AS complete FROM lineitem GROUP BY 1""")
def evidence_summary(t: Tables):
    """Addresses of each field; half of those without one say why."""
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("field"), F.when(F.col("l_partkey") % 6 != 0, F.concat_ws("/", "l_orderkey", "l_linenumber")).alias("address"), F.when(F.col("l_partkey") % 12 == 6, "derived").alias("reason"))
    return C.evidence_summary(rows, ["l_orderkey"])
