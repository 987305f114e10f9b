"""Where values come from: anchors, evidence, prior decisions, the nine items, dossiers and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.values import ordinal_path

ANCHOR_VERSION = "anchor/1"


def anchor_id(document: Column, page: Column, role: Column, system: Column, place: Column) -> Column:
    """A stable address: the first 32 hexadecimal digits of SHA-256 of canonical JSON. Null where the place counts items."""
    text = F.to_json(F.struct(document.alias("document_id"), page.alias("page"), place.alias("place"), role.alias("role"), system.alias("system"), F.lit(ANCHOR_VERSION).alias("version")))
    return F.when(~F.coalesce(ordinal_path(place), F.lit(True)), F.substring(F.sha2(text, 256), 1, 32))


def anchor_collisions(objects: DataFrame, anchor: str, key: str) -> DataFrame:
    """(anchor, objects, first_object): anchors that several objects share."""
    return objects.groupBy(anchor).agg(F.count("*").alias("objects"), F.min(key).alias("first_object")).where("objects > 1")


def warning_counts(warnings: DataFrame) -> DataFrame:
    """(grouping, name, n): warnings counted by kind, by field and by rule in one pass of grouping sets (A17). warnings: field, kind, rule."""
    names = ["kind", "field", "rule"]
    sets = warnings.groupingSets([[F.col(c)] for c in names], *names).agg(F.grouping_id(*names).alias("__g"), F.count("*").alias("n"))
    grouping = F.when(F.col("__g") == 3, "kind").when(F.col("__g") == 5, "field").otherwise("rule")
    return sets.select(grouping.alias("grouping"), F.when(F.col("__g") == 3, F.col("kind")).when(F.col("__g") == 5, F.col("field")).otherwise(F.col("rule")).alias("name"), "n")


def evidence(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, raw, value, address, rule, reason): each value beside what was read, by which rule, and why it has no address (P10).

    fields: keys, field, raw, value, address, rule.
    """
    reason = F.when(F.col("address").isNull(), F.when(F.col("raw").isNull(), "not in the document").otherwise("source without places"))
    return fields.select(*keys, "field", "raw", "value", "address", "rule", reason.alias("reason"))


def prior_decisions(events: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """(record_id, action, operator): a person's last decision about any anchor of a record that was read again.

    events: document_id, anchors, action, operator, order; records: document_id, record_id, anchors.
    """
    told = events.select("document_id", F.explode("anchors").alias("anchor"), "action", "operator", *order)
    now = records.select("document_id", "record_id", F.explode("anchors").alias("anchor"))
    last = F.max(F.struct(*order, "action", "operator")).alias("e")
    return now.join(told, ["document_id", "anchor"]).groupBy("record_id").agg(last).select("record_id", "e.action", "e.operator")


#: What a number is shown with, in order.
NINE = ("document", "page", "place", "raw", "rule", "value", "checks", "decision", "history")


def nine_items(fields: DataFrame, checks: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, field, item, text): the nine items behind each number; one that isn't known is told as such.

    fields: record_id, field, document, page, place, raw, rule, value; checks:
    record_id, status; decisions: record_id, status; events: record_id, action.
    """
    n = checks.groupBy("record_id").agg(F.count("*").alias("__n"), F.count_if(F.col("status") == "PASS").alias("__p"))
    h = events.groupBy("record_id").agg(F.count("*").alias("__h"))
    rows = fields.join(n, "record_id", "left").join(decisions.select("record_id", F.col("status").alias("__d")), "record_id", "left").join(h, "record_id", "left")
    text = {c: F.col(c).cast("string") for c in NINE[:6]} | {"checks": F.format_string("%d of %d", "__p", "__n"), "decision": F.col("__d"), "history": F.col("__h").cast("string")}
    text["checks"] = F.when(F.col("__n").isNotNull(), text["checks"])
    items = F.array(*(F.struct(F.lit(k).alias("item"), F.coalesce(text[k], F.lit("unknown")).alias("text")) for k in NINE))
    return rows.select("record_id", "field", F.explode(items).alias("__i")).select("record_id", "field", "__i.*")


def dossier(claims: DataFrame, support: DataFrame) -> DataFrame:
    """(claim, supported, evidence): what a release claims, and what stands behind it; a claim without support is told, not dropped."""
    n = support.groupBy("claim").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("p"))
    out = claims.select("claim").join(n, "claim", "left").fillna(0, ["n", "p"])
    return out.select("claim", ((F.col("n") > 0) & (F.col("n") == F.col("p"))).alias("supported"), F.col("n").alias("evidence"))


def approval(mappings: DataFrame, template: list[str]) -> DataFrame:
    """(template, approved, unresolved): a template is approved when nothing of its trial is left to decide."""
    n = mappings.groupBy(*template).agg(F.count_if(F.col("state").isin("to_decide", "vanished")).alias("unresolved"))
    return n.select(*template, (F.col("unresolved") == 0).alias("approved"), "unresolved")


def library_counts(templates: DataFrame, level: str) -> DataFrame:
    """(level, n): templates by level."""
    return templates.groupBy(level).agg(F.count("*").alias("n"))


def form_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, sound, doubtful): rows of annotation forms, those without an error, those with a doubt (A52). rows: errors, doubt."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.size("errors") == 0).alias("sound"), F.count_if(F.coalesce(F.trim("doubt"), F.lit("")) != "").alias("doubtful"))


def recovery(entries: DataFrame, stream: str, results: DataFrame, parts: DataFrame | None = None, space: DataFrame | None = None, needed: int = 0) -> DataFrame:
    """(stream, verdict, codes): what is left after a stop, and every fault by its code; nothing is mended.

    entries: verify_chain()'s rows; results: stream, complete; parts:
    verify_parts()'s rows; space: stream, writable, free (bytes). The verdict is
    the first of: a broken journal, none, a folder that can't be worked in, a
    finished result, or one that has to run again.
    """
    both = entries.join(results, stream, "full_outer")
    if parts is not None:
        both = both.join(parts.groupBy(stream).agg(F.count_if(~F.col("linked")).alias("unlinked")), stream, "left")
    if space is not None:
        both = both.join(space.select(stream, "writable", "free"), stream, "left")
    broken, unlinked = F.coalesce("broken", F.lit(0)) > 0, F.coalesce("unlinked", F.lit(0)) > 0 if parts is not None else F.lit(False)
    shut = ~F.coalesce("writable", F.lit(False)) if space is not None else F.lit(False)
    full = ~F.coalesce(F.col("free") >= needed, F.lit(False)) if space is not None and needed else F.lit(False)
    none, whole = F.col("entries").isNull(), F.coalesce("complete", F.lit(False))
    faults = {"E_JOURNAL_BROKEN": broken, "E_JOURNAL_PARTS": unlinked, "E_JOURNAL_MISSING": none, "E_RESULT_INCOMPLETE": ~whole, "E_NOT_WRITABLE": shut, "E_NO_SPACE": full}
    codes = F.array_compact(F.array(*(F.when(c, code) for code, c in faults.items())))
    verdict = F.when(broken | unlinked, "journal broken").when(none, "no journal").when(shut | full, "no room").when(whole, "finished").otherwise("run again")
    return both.select(stream, verdict.alias("verdict"), F.concat_ws(",", codes).alias("codes"))
