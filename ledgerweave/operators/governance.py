"""Roles, what may leave, bills of materials, libraries and stores."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.values import percent

#: Which role may do which work; what isn't named is forbidden.
ROLES = {
    "operator": ("confirm", "reject", "correct", "undo"),
    "specialist": ("confirm", "reject", "correct", "undo", "return_spec"),
    "annotator": ("annotate",),
    "administrator": ("grant",),
    "auditor": (),
}


def permitted(role: Column, work: Column, roles: dict[str, tuple[str, ...]] = ROLES) -> Column:
    allowed = F.lit(False)
    for name, works in roles.items():
        if works:
            allowed = allowed | ((role == name) & work.isin(*works))
    return F.coalesce(allowed, F.lit(False))


#: Counters, flags and short codes that may leave; everything else may not.
OUTGOING = {"stage": "code", "version": "code", "run_key": "fingerprint", "records": "count", "milliseconds": "count", "ok": "flag"}


def outgoing(rows: DataFrame, allowed: dict[str, str] = OUTGOING) -> DataFrame:
    """Only allowed columns, with refusal naming the first whose value isn't of its kind: content never passes as a code."""
    broken = []
    for name, kind in allowed.items():
        if name not in rows.columns:
            continue
        c = F.col(name)
        fine = {
            "count": c.try_cast("long").isNotNull() & (c.try_cast("long") >= 0),
            "flag": c.cast("string").isin("true", "false"),
            "code": c.isNull() | (c.rlike(r"^[A-Za-z0-9_./:-]{1,64}$") & c.rlike("[A-Za-z]")),
            "fingerprint": c.isNull() | c.rlike("^[0-9a-f]{16,64}$"),
        }[kind]
        broken.append(F.when(~F.coalesce(fine, F.lit(False)), name))
    return rows.select(*[c for c in allowed if c in rows.columns], F.coalesce(*broken).alias("refusal"))


def result_fingerprint(records: DataFrame, run: list[str], order: list[str], cells: list[str]) -> DataFrame:
    """(run, fingerprint): equal for runs with equal results, whatever their order or time.

    A record is hashed where it is read; a run's fingerprint combines the counts
    and sums of its records' hashes, so no run is gathered in one task.
    """
    own = F.sha2(F.to_json(F.struct(*order, *cells)), 256)
    part = lambda k: F.conv(F.substring("__h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    n = records.withColumn("__h", own).groupBy(*run).agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"s{k}") for k in range(4)))
    return n.select(*run, F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3"))), 256).alias("fingerprint"))


def history(events: DataFrame, record: str | None = None, anchor: str | None = None, document: str | None = None) -> DataFrame:
    """Operator events of a record, of an anchor or of a document."""
    for c, value in (("record_id", record), ("document_id", document)):
        if value is not None:
            events = events.where(F.col(c) == value)
    return events if anchor is None else events.where(F.array_contains("anchors", anchor))


def trail(field: Column, value: Column, document: Column, page: Column, place: Column, rule: Column) -> Column:
    """Where a number comes from, in one line."""
    return F.format_string("%s = %s: %s, page %d, %s, by %s", field, value, document, page, F.coalesce(place, F.lit("no address")), rule)


def usage(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(measure, name, n): runs by state, documents, decisions by operator and by action."""
    one = lambda d, m, c: d.groupBy(F.lit(m).alias("measure"), F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n"))
    docs = runs.agg(F.count_distinct("document_id").alias("n")).select(F.lit("documents").alias("measure"), F.lit("all").alias("name"), "n")
    return one(runs, "runs", "state").unionByName(docs).unionByName(one(decisions, "operator", "operator")).unionByName(one(decisions, "action", "action"))


def bill_of_materials(listed: DataFrame, inside: DataFrame, name: str, fingerprint: str) -> DataFrame:
    """(name, verdict): listed and found parts by name: ok, changed, missing, or unlisted."""
    a, b = listed.select(name, F.col(fingerprint).alias("__a"), F.lit(True).alias("__in_a")), inside.select(name, F.col(fingerprint).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, name, "full_outer")
    return both.select(name, F.when(F.col("__in_a").isNull(), "unlisted").when(F.col("__in_b").isNull(), "missing").when(F.col("__a").eqNullSafe(F.col("__b")), "ok").otherwise("changed").alias("verdict"))


def licence_mentions(text: Column, names: tuple[str, ...]) -> Column:
    """The licences of a declared list that a text names as whole words, in the list's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(f"(^|[^a-z]){re.escape(x)}([^a-z]|$)"), x) for x in names)))


def outgoing_counters(documents: DataFrame, by: list[str], counted: dict[str, Column]) -> DataFrame:
    """(by, documents, NAME_percent...): counts and whole percents, all that leaves for a dashboard."""
    n = documents.groupBy(*by).agg(F.count("*").alias("documents"), *(F.count_if(c).alias(f"__{k}") for k, c in counted.items()))
    return n.select(*by, "documents", *(percent(F.col(f"__{k}"), F.col("documents")).alias(f"{k}_percent") for k in counted))


def licence_obligations(components: DataFrame, name: str, declared: str, mentioned: str) -> DataFrame:
    """(name, wider): licences that a component's text names beyond the declared one: a reason to read it, not a finding."""
    wider = F.filter(mentioned, lambda x: ~F.contains(F.lower(F.col(declared)), F.lower(x)))
    return components.select(name, F.concat_ws(",", F.array_sort(wider)).alias("wider")).where("wider <> ''")


def upsert_blobs(store: DataFrame, sent: DataFrame) -> DataFrame:
    """The store after a save: sent blobs by shelf and name take the place of those there."""
    return sent.unionByName(store.join(sent, ["shelf", "name"], "left_anti"))


def lost_in_upgrade(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the past that an upgrade lost, beyond any that it added."""
    return before.join(after, keys, "left_anti").select(*keys)


def past_survived(before: DataFrame, after: DataFrame, stream: str) -> DataFrame:
    """(stream, verdict): whether each journal outlived an upgrade: kept, continued, lost (gone or shorter), or replaced.

    Both sides are journals' entries: stream, sequence, hash. A journal that is as
    long or longer, but doesn't hold its former head at its place, was replaced.
    """
    head = before.groupBy(stream).agg(F.max(F.struct("sequence", "hash")).alias("h")).select(stream, F.col("h.sequence").alias("__n"), F.col("h.hash").alias("__hash"))
    now = after.groupBy(stream).agg(F.max("sequence").alias("__now"))
    at = after.select(F.col(stream).alias("__s"), F.col("sequence").alias("__at"), F.col("hash").alias("__found"))
    both = head.join(now, stream, "left").join(at, (F.col(stream) == F.col("__s")) & (F.col("__n") == F.col("__at")), "left")
    verdict = F.when(F.col("__now").isNull() | (F.col("__now") < F.col("__n")), "lost").when(~F.coalesce(F.col("__found") == F.col("__hash"), F.lit(False)), "replaced").when(F.col("__now") == F.col("__n"), "kept").otherwise("continued")
    return both.select(stream, verdict.alias("verdict"))


class Migrations:
    """Steps between versions of an artefact, from a version to the next; a route is the shortest one."""

    def __init__(self):
        self.steps: dict[str, dict[str, dict[str, Callable[[DataFrame], DataFrame]]]] = {}

    def add(self, artefact: str, source: str, target: str, step: Callable[[DataFrame], DataFrame]) -> None:
        own = self.steps.setdefault(artefact, {}).setdefault(source, {})
        if target in own:
            raise ValueError(f"{artefact}: a step from {source} to {target} is there")
        own[target] = step

    def route(self, artefact: str, source: str, target: str) -> list[tuple[str, str]]:
        todo, seen = deque([(source, [])]), {source}
        while todo:
            at, way = todo.popleft()
            if at == target:
                return way
            for nxt in sorted(self.steps.get(artefact, {}).get(at, {})):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append((nxt, [*way, (at, nxt)]))
        raise ValueError(f"{artefact}: no route from {source} to {target}")

    def migrate(self, rows: DataFrame, artefact: str, source: str, target: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
        """The rows at the target version with their provenance, and what of their payload was lost or added on the way."""
        from ledgerweave.operators.compare import multiset_diff

        now, way = rows, self.route(artefact, source, target)
        for a, b in way:
            now = self.steps[artefact][a][b](now)
        told = now.withColumn("migrated", F.lit(">".join([source, *(b for _, b in way)])))
        return told, multiset_diff(rows.select(*payload), now.select(*payload))


def upgrade_action(language: Column, supported: tuple[str, ...], convertible: dict[str, str], previous: Column, core: str) -> Column:
    """What a package's owner does after an upgrade: keep, convert, go back, or rebuild (V11), for each package of a table."""
    converts = language.isin(*(source for source, target in convertible.items() if target in supported)) if convertible else F.lit(False)
    return F.when(language.isin(*supported), "keep").when(converts, "convert").when(previous.isNotNull(), F.concat(F.lit("go back to "), previous)).otherwise(f"rebuild for {core}")
