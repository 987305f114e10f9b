"""Layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.operators import layout as L
from ledgerweave.plans.registry import Tables, query


@query("""
    SELECT conv_id, turn, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM conversations""")
def record_sessionise(t: Tables):
    return L.sessions(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "record")


@query("""
    WITH r AS (SELECT conv_id, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM conversations),
    n AS (SELECT conv_id, record, count(*) AS lines FROM r WHERE record > 0 GROUP BY ALL) SELECT lines, count(*) AS records FROM n GROUP BY 1""")
def record_lengths(t: Tables):
    return L.record_lengths(L.sessions(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user"), ["conv_id"])


@query("""
    WITH b AS (SELECT event_id, concat_ws(',', CASE WHEN value BETWEEN 0 AND 10 THEN 'date' END, CASE WHEN value BETWEEN 9 AND 30 THEN 'amount' END, CASE WHEN value BETWEEN 40 AND 60 THEN 'purpose' END) AS fields FROM events)
    SELECT fields, CASE WHEN fields = '' THEN 'extra' WHEN contains(fields, ',') THEN 'conflict' ELSE 'one' END AS verdict, count(*) AS cells FROM b GROUP BY ALL""")
def column_bands(t: Tables):
    out = L.into_bands(t.events, "value", [("date", 0, 10), ("amount", 9, 30), ("purpose", 40, 60)])
    return out.groupBy(F.concat_ws(",", "fields").alias("fields"), "verdict").agg(F.count("*").alias("cells"))


@query("""
    WITH c AS (SELECT conv_id, turn, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations)
    SELECT conv_id, 'answer' AS name, sha256(arg_min(v, turn)) AS value FROM c WHERE role = 'user' AND v IS NOT NULL GROUP BY 1""")
def requisites_next_cell(t: Tables):
    """A user's turn stands for a label; the next turn is its value, the first hit wins."""
    out = L.next_cell(t.conversations, ["conv_id"], ["turn"], F.when(F.col("role") == "user", "answer"), "text")
    return out.select("conv_id", "name", F.sha2("value", 256).alias("value"))


@query("""
    WITH RECURSIVE o AS (SELECT vec_id AS object_id, label AS page, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, row_number() OVER (PARTITION BY label ORDER BY CAST(embedding[2] AS DOUBLE) DESC, CAST(embedding[1] AS DOUBLE), vec_id) AS n FROM embeddings),
    r AS (SELECT object_id, page, x, y, n, 1 AS line, y AS anchor FROM o WHERE n = 1
        UNION ALL SELECT o.object_id, o.page, o.x, o.y, o.n, CASE WHEN abs(anchor - o.y) > 0.004 THEN line + 1 ELSE line END, CASE WHEN abs(anchor - o.y) > 0.004 THEN o.y ELSE anchor END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1)
    SELECT object_id, page, x, y, line FROM r""")
def line_clustering(t: Tables):
    """Objects placed by their first two components, a page for each label."""
    rows = t.embeddings.select(F.col("vec_id").alias("object_id"), F.col("label").alias("page"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")))
    return L.cluster_lines(rows, ["page"], "x", "y")


@query("""
    WITH RECURSIVE c AS (SELECT event_id // 200 AS page, event_id // 4 AS line, (event_id % 4) * 0.25::DOUBLE + user_id % 3 * 0.011::DOUBLE AS x FROM events),
    l AS (SELECT page, line, list_sort(list(x)) AS xs, row_number() OVER (PARTITION BY page ORDER BY line) AS n FROM c GROUP BY 1, 2),
    r AS (SELECT page, line, n, 1 AS run, line AS first, xs AS shared FROM l WHERE n = 1
        UNION ALL SELECT page, line, n, CASE WHEN joined THEN run ELSE run + 1 END, CASE WHEN joined THEN first ELSE line END, CASE WHEN joined THEN common ELSE xs END FROM (
            SELECT l.page, l.line, l.n, r.run, r.first, l.xs, list_filter(r.shared, lambda a: len(list_filter(l.xs, lambda b: abs(a - b) <= 0.02)) > 0) AS common, l.line = r.line + 1 AND len(common) >= 2 AS joined FROM r JOIN l ON l.page = r.page AND l.n = r.n + 1)),
    t AS (SELECT page, run, min(first) AS first_line, max(line) AS last_line, arg_max(len(shared), n) AS columns, count(*) AS lines FROM r GROUP BY 1, 2)
    SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY first_line) AS INT) AS "table", first_line, last_line, columns FROM t WHERE lines >= 2 AND columns >= 2""")
def table_detect(t: Tables):
    rows = t.events.select((F.col("event_id") / 200).cast("long").alias("page"), (F.col("event_id") / 4).cast("long").alias("line"), ((F.col("event_id") % 4) * 0.25 + F.col("user_id") % 3 * 0.011).alias("x"))
    return L.detect_tables(rows, ["page"], "line", "x")


def _paged(t: Tables):
    """Documents' lines in pages of twenty, each page one table."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    page = (F.col("n") / 20).cast("long")
    n = lines.groupBy("doc_id", page.alias("page")).agg(F.min_by("line", "n").alias("first"), F.max("n").alias("last_n"))
    columns = F.array(F.lit(0.1), F.lit(0.3) + (F.col("page") % 4 == 3).cast("double") * 0.1, F.lit(0.6))
    header = F.when(F.col("page") % 3 == 2, "other").otherwise("header")
    return n.select("doc_id", "page", columns.alias("first_columns"), columns.alias("last_columns"), header.alias("first_header"), header.alias("last_header"))


@query("""
    WITH p AS (SELECT doc_id, unnest(range(0, ceil(len(string_split(text, chr(10))) / 20)::BIGINT)) AS page FROM documents),
    v AS (SELECT doc_id, page, page > 0 AND (page % 4 = 3) = ((page - 1) % 4 = 3) AS follows, (page % 3 = 2) = ((page - 1) % 3 = 2) AS repeated FROM p),
    s AS (SELECT doc_id, page, follows AND repeated AS header_repeated, CASE WHEN NOT follows THEN 'separate' WHEN repeated THEN 'stitched' ELSE 'unresolved' END AS verdict FROM v)
    SELECT *, count_if(verdict <> 'stitched') OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS chain FROM s""")
def table_stitch(t: Tables):
    return L.stitch(_paged(t), ["doc_id"], "page")


@query("""
    WITH l AS (SELECT source, doc_id AS page, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
    g AS (SELECT source, line, count(DISTINCT page) AS pages, min(n) AS pos FROM l GROUP BY 1, 2),
    k AS (SELECT source, line, pages, row_number() OVER (PARTITION BY source ORDER BY pos, line) AS k FROM g WHERE pages >= 2)
    SELECT source, sha256(line) AS line, pages FROM k WHERE k <= 12""")
def repeating_header(t: Tables):
    """Lines that documents of a source share, the first twelve by place; two documents are enough, where a form's header needs 0.9 of its pages."""
    rows = t.documents.select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return L.repeating_header(rows, ["source"], "page", "n", "line", share=0.0).withColumn("line", F.sha2("line", 256))


@query("""
    SELECT conv_id, turn, sha256(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS context FROM conversations""")
def context_window(t: Tables):
    out = L.context(t.conversations, ["conv_id"], ["turn"], "text", 1)
    return out.select("conv_id", "turn", F.sha2(F.concat_ws("\n", "context"), 256).alias("context"))


@query("""
    WITH n AS (SELECT user_id, count_if(event_type = 'view') AS c, count_if(event_type IN ('click', 'purchase', 'error')) AS w, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN c * 2 > n THEN 'grid' WHEN w * 2 > n THEN 'whole' ELSE 'coordinates' END AS method FROM n""")
def layout_method(t: Tables):
    kind = F.when(F.col("event_type") == "view", "cell").when(F.col("event_type").isin("click", "purchase", "error"), "record").otherwise("text")
    return L.layout_method(t.events.withColumn("kind", kind), ["user_id"], "kind")


@query("""
    SELECT l_orderkey, l_linenumber, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_suppkey, l_partkey) AS cells FROM lineitem GROUP BY 1, 2""")
def grid_lines(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("cell"))
    return L.grid_lines(rows, ["l_orderkey"], "l_linenumber", "l_suppkey", "cell").select("l_orderkey", "l_linenumber", F.concat_ws(",", F.transform("cells", lambda x: x.cast("string"))).alias("cells"))


@query("""
    WITH e AS (SELECT label, vec_id, -CAST(embedding[2] AS DOUBLE) AS up, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)
    SELECT label AS record, arg_min(vec_id, struct_pack(a := up, b := x, c := vec_id)) AS object_id FROM e GROUP BY 1""")
def record_anchor(t: Tables):
    rows = t.embeddings.select(F.col("label").alias("record"), F.lit(1).alias("page"), F.col("vec_id").alias("object_id"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")))
    return L.record_anchor(rows, ["record"], "page", "x", "y", "object_id")


@query("""
    WITH p AS (SELECT doc_id, unnest(range(0, ceil(len(string_split(text, chr(10))) / 20)::BIGINT)) AS page FROM documents),
    v AS (SELECT page > 0 AND (page % 4 = 3) = ((page - 1) % 4 = 3) AS follows, (page % 3 = 2) = ((page - 1) % 3 = 2) AS repeated FROM p)
    SELECT CASE WHEN NOT follows THEN 'separate' WHEN repeated THEN 'stitched' ELSE 'unresolved' END AS verdict, count(*) AS pages, count_if(follows AND repeated) AS headers FROM v GROUP BY 1""")
def stitch_counters(t: Tables):
    """How many pages were stitched, left apart or left open, and how many repeated headers were dropped."""
    return L.stitch_counters(L.stitch(_paged(t), ["doc_id"], "page"))
