"""Journals, runs, batches and histories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: Sequence numbers that a window goes over at most.
SPAN = 65_536


def entry_hash(sequence: Column, previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("\n", sequence.cast("string"), previous, payload), 256)


def chained(rows: DataFrame, stream: str, order: list[str], payload: str, heads: DataFrame | None = None) -> DataFrame:
    """rows with sequence, previous_hash and hash (V06): each hash feeds the next, so a stream is a fold of its own.

    heads (stream, sequence, hash) is where streams stand; without one a stream begins.
    A stream's rows come sorted and are folded batch by batch: a task holds one hash.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence long, previous_hash string, hash string"
    start = F.lit(None).cast("struct<sequence: long, hash: string>").alias("__head")
    if heads is None:
        told = rows.select(*names, start)
    else:
        told = rows.join(heads.select(F.col(stream).alias("__of"), F.struct("sequence", "hash").alias("__head")), F.col(stream).eqNullSafe(F.col("__of")), "left")
    told = told.select(*names, F.coalesce("__head.sequence", F.lit(0)).alias("__at"), F.coalesce("__head.hash", F.lit(GENESIS)).alias("__last"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, k, last = object(), 0, GENESIS
        for b in batches:
            counted, before, own = [], [], []
            streams = b[stream].astype(object).where(b[stream].notna(), None)
            for s, p, first, head in zip(streams, b[payload], b["__at"], b["__last"], strict=True):
                if s != key:
                    key, k, last = s, int(first), head
                k += 1
                counted.append(k)
                before.append(last)
                last = hashlib.sha256(f"{k}\n{last}\n{p}".encode()).hexdigest()
                own.append(last)
            yield b[names].assign(sequence=counted, previous_hash=before, hash=own)

    return told.repartition(stream).sortWithinPartitions(stream, *order).mapInPandas(fold, schema)


def tail_faults(tails: DataFrame, stream: str, payload: str) -> DataFrame:
    """Streams whose last entry doesn't carry its own hash: nothing may be appended to them (T03). tails: stream, sequence, previous_hash, payload, hash."""
    return tails.where(~F.coalesce(F.col("hash") == entry_hash(F.col("sequence"), F.col("previous_hash"), F.col(payload)), F.lit(False))).select(stream)


def verify_chain(entries: DataFrame, stream: str, payload: str) -> DataFrame:
    """(stream, entries, broken, first_broken): sequence, previous hash and own hash of every entry; each row checks itself."""
    # Windows go over spans of sequence numbers, not over whole streams: one stream may hold most entries. Spans meet at their ends.
    rows = entries.withColumn("__span", F.floor(F.col("sequence") / SPAN))
    spans = rows.groupBy(stream, "__span").agg(F.count("*").alias("__n"), F.max_by("hash", "sequence").alias("__end"))
    before = Window.partitionBy(stream).orderBy("__span")
    spans = spans.select(F.col(stream).alias("__s"), F.col("__span").alias("__of"), F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.coalesce(F.lag("__end").over(before), F.lit(GENESIS)).alias("__link"))
    w = Window.partitionBy(stream, "__span").orderBy("sequence")
    rows = rows.withColumn("__nth", F.row_number().over(w)).withColumn("__last", F.lag("hash").over(w))
    rows = rows.join(spans, F.col(stream).eqNullSafe(F.col("__s")) & F.col("__span").eqNullSafe(F.col("__of")))
    linked = F.col("previous_hash") == F.coalesce("__last", "__link")
    counted = F.col("sequence") == F.col("__before") + F.col("__nth")
    own = F.col("hash") == entry_hash(F.col("sequence"), F.col("previous_hash"), F.col(payload))
    rows = rows.withColumn("__fine", F.coalesce(linked & counted & own, F.lit(False)))
    return rows.groupBy(stream).agg(F.count("*").alias("entries"), F.count_if(~F.col("__fine")).alias("broken"), F.min(F.when(~F.col("__fine"), F.col("sequence"))).alias("first_broken"))


def verify_parts(entries: DataFrame, stream: str, part: str) -> DataFrame:
    """(stream, part, linked): whether a part begins with the hash that the one before ended with."""
    ends = entries.groupBy(stream, part).agg(F.min_by("previous_hash", "sequence").alias("begins"), F.max_by("hash", "sequence").alias("ends"))
    w = Window.partitionBy(stream).orderBy(part)
    return ends.select(stream, part, (F.col("begins") == F.coalesce(F.lag("ends").over(w), F.lit(GENESIS))).alias("linked"))


def compare_head(entries: DataFrame, pins: DataFrame, stream: str) -> DataFrame:
    """(stream, verdict, since): a pinned head is the same, extended, or diverged; since counts entries after it.

    pins: stream, pinned_sequence, pinned_hash.
    """
    head = entries.groupBy(stream).agg(F.max("sequence").alias("last"))
    at = entries.select(stream, F.col("sequence").alias("pinned_sequence"), F.col("hash").alias("found"))
    rows = pins.join(head, stream, "left").join(at, [stream, "pinned_sequence"], "left")
    verdict = F.when(~F.coalesce(F.col("found") == F.col("pinned_hash"), F.lit(False)), "diverged").when(F.col("last") == F.col("pinned_sequence"), "same").otherwise("extended")
    return rows.select(stream, verdict.alias("verdict"), F.greatest(F.col("last") - F.col("pinned_sequence"), F.lit(0)).alias("since"))


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns): the last event of each key by a total order."""
    last = F.max(F.struct(*order, *columns)).alias("e")
    return events.groupBy(*keys).agg(last).select(*keys, *(F.col(f"e.{c}").alias(c) for c in columns))


def corrected(records: DataFrame, corrections: DataFrame, keys: list[str], order: list[str], field: str) -> DataFrame:
    """records with a corrected copy of a field beside the primary one, which stays as it is."""
    last = latest(corrections, keys, order, ["new_value"])
    return records.join(last, keys, "left").withColumn(f"corrected_{field}", F.coalesce("new_value", F.col(field))).drop("new_value")


def may_accept(status: Column) -> Column:
    """A person accepts only what waits for review or was rejected."""
    return status.isin("review", "rejected")


ACCEPTED_MANUAL, REJECTED = "accepted_manual", "rejected"


def manual(decisions: DataFrame, events: DataFrame, record: str, order: list[str]) -> DataFrame:
    """(record, status, was, operator, basis, refusal): decisions after a person's last event for each record.

    events: record, action (accept or reject), operator, basis, time and the
    columns of order. An event needs an operator, a basis and a time, and a
    record that waits for review or was rejected; else it is refused with a code
    and the decision stays. A manual acceptance is a status of its own.
    """
    last = events.groupBy(record).agg(F.max_by(F.struct("action", "operator", "basis", "time"), F.struct(*order)).alias("e"))
    last = last.select(record, F.col("e.action").alias("__action"), "e.operator", "e.basis", "e.time")
    both = decisions.join(last.withColumn("__asked", F.lit(True)), record, "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    refusal = (
        F.when(F.col("__asked").isNull(), None).when(F.col("status").isNull(), "E_NO_STATUS").when(~may_accept(F.col("status")), "E_TRANSITION")
        .when(blank("operator") | blank("basis") | blank("time"), "E_EVENT_INCOMPLETE").when(~F.coalesce(F.col("__action").isin("accept", "reject"), F.lit(False)), "E_ACTION_UNKNOWN")
    )
    done = F.col("__asked").isNotNull() & refusal.isNull()
    status = F.when(done, F.when(F.col("__action") == "accept", ACCEPTED_MANUAL).otherwise(REJECTED)).otherwise(F.col("status"))
    told = lambda c: F.when(done, F.col(c)).alias(c)
    return both.select(record, status.alias("status"), F.when(done, F.col("status")).alias("was"), told("operator"), told("basis"), refusal.alias("refusal"))


def stamped(records: DataFrame, decisions: DataFrame, record: str, field: str = "decision") -> DataFrame:
    """records with their decision's status in one field and nothing else changed (O07); without a status `review`."""
    mark = decisions.select(F.col(record).alias("__of"), F.col("status").alias("__status"))
    told = records.join(mark, F.col(record) == F.col("__of"), "left")
    own = F.when(F.col("__status").startswith("accepted"), "accepted").when(F.col("__status") == REJECTED, "rejected").otherwise("review")
    names = records.columns if field in records.columns else [*records.columns, field]
    return told.withColumn(field, own).select(*names)


def fan_out(decisions: DataFrame, members: DataFrame, group: str, record: str) -> DataFrame:
    """(record, decision..., applied): one decision for each member of its group, where the group has the expected count.

    decisions: group, expected and more; members: group, record.
    """
    n = members.groupBy(group).agg(F.count("*").alias("members"))
    told = decisions.join(n, group, "left").withColumn("applied", F.coalesce(F.col("members") == F.col("expected"), F.lit(False)))
    return told.where("applied").join(members, group).select(record, *[c for c in decisions.columns if c != "expected"])


def undo(decisions: DataFrame, undone: DataFrame, key: str) -> DataFrame:
    """Decisions that no compensating event takes back."""
    return decisions.join(undone, key, "left_anti")


def run_summary(events: DataFrame, key: str, time: list[str]) -> DataFrame:
    """(state, keys): how runs ended; a start without an end is unfinished; equal fingerprints repeat, others mismatch.

    events: key, state (started or finished), fingerprint, time.
    """
    first = F.min_by("fingerprint", F.struct(*time))
    n = events.groupBy(key).agg(
        F.count_if(F.col("state") == "started").alias("started"), F.count_if(F.col("state") == "finished").alias("finished"),
        F.count_distinct(F.when(F.col("state") == "finished", F.col("fingerprint"))).alias("prints"), first.alias("first"),
    )
    state = F.when(F.col("finished") == 0, "unfinished").when(F.col("prints") > 1, "mismatch").when(F.col("finished") > 1, "repeat").otherwise("finished")
    return n.groupBy(state.alias("state")).agg(F.count("*").alias("keys"))


def upsert_batch(files: DataFrame, fingerprint: str, name: str) -> DataFrame:
    """(fingerprint, names, submissions): one file for each fingerprint, with all names it came under."""
    names = F.array_join(F.array_sort(F.collect_set(name)), ",")
    return files.groupBy(fingerprint).agg(names.alias("names"), F.count("*").alias("submissions"))


def batch_state(files: DataFrame, batch: list[str], state: str) -> DataFrame:
    """(batch, state): the worst of its files' states."""
    order = ["failed", "refused", "unparsed", "review", "ready"]
    worst = F.coalesce(*(F.when(F.count_if(F.col(state) == s) > 0, s) for s in order), F.lit("empty"))
    return files.groupBy(*batch).agg(worst.alias("state"))


def batch_progress(files: DataFrame, runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """files with the last state of their run, `waiting` without one."""
    return files.join(latest(runs, [key], order, ["state"]), key, "left").withColumn("state", F.coalesce("state", F.lit("waiting")))


def stage_rollup(marks: DataFrame, document: str, stage: Column, ok: Column, order: list[str], major: dict[str, tuple[int, str]]) -> DataFrame:
    """(document, stage, first_failed, done): the furthest major stage and the first that failed."""
    cases = [(F.when(stage == k, n), F.when(stage == k, m)) for k, (n, m) in major.items()]
    rows = marks.withColumn("__n", F.coalesce(*(c[0] for c in cases))).withColumn("__m", F.coalesce(*(c[1] for c in cases))).withColumn("__ok", ok)
    failed = F.min(F.when(~F.col("__ok"), F.struct(*order, "__m"))).alias("f")
    n = rows.where("__n IS NOT NULL").groupBy(document).agg(F.max(F.struct("__n", "__m")).alias("last"), failed, F.count_if("__ok").alias("done"))
    return n.select(document, F.col("last.__m").alias("stage"), F.col("f.__m").alias("first_failed"), "done")


def in_force(releases: DataFrame, dates: DataFrame, keys: list[str], on: str) -> DataFrame:
    """Releases that were in force on a date: issued by then and not yet archived (J14); an interval join on an equal key.

    releases: keys, issued, archived (or null), version; dates: keys, on.
    """
    return dates.join(releases, keys).where((F.col("issued") <= F.col(on)) & (F.col("archived").isNull() | (F.col("archived") >= F.col(on))))


def best_level(templates: DataFrame, keys: list[str], levels: list[str], level: str, version: str) -> DataFrame:
    """(keys, level, version): a client's template before a common one; other levels are out."""
    rank = F.coalesce(*(F.when(F.col(level) == x, n) for n, x in enumerate(levels)))
    best = F.min(F.struct(rank.alias("r"), (-F.col(version)).alias("v"), level, version)).alias("b")
    return templates.where(F.col(level).isin(levels)).groupBy(*keys).agg(best).select(*keys, F.col(f"b.{level}").alias(level), F.col(f"b.{version}").alias(version))


def exposed(components: DataFrame, feed: DataFrame, name: str, version: str) -> DataFrame:
    """Components that a feed names; a feed row without versions means all of them (J16). feed: name, versions, advisory."""
    hit = (F.coalesce(F.size("versions"), F.lit(0)) <= 0) | F.array_contains("versions", F.col(version))
    return components.join(feed, name).where(hit)


#: Seconds that a window over marks goes over at most.
DAY = 86_400


def stalls(marks: DataFrame, key: str, time: str, limit_seconds: float) -> DataFrame:
    """(key, from, to, seconds): silences of at least the limit between neighbouring marks.

    Neighbours are looked for within days, and between the last mark of a day and
    the first of the next that has one: no key's marks meet in one task.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = marks.select(key, F.col(time).alias("from"), F.floor(micros / (DAY * 1_000_000)).alias("__day"))
    inside = rows.withColumn("to", F.lead("from").over(Window.partitionBy(key, "__day").orderBy("from")))
    edges = rows.groupBy(key, "__day").agg(F.max("from").alias("from"), F.min("from").alias("__first"))
    edges = edges.withColumn("to", F.lead("__first").over(Window.partitionBy(key).orderBy("__day")))
    both = inside.select(key, "from", "to").unionByName(edges.select(key, "from", "to"))
    seconds = (F.unix_micros(F.col("to").cast("timestamp")) - F.unix_micros(F.col("from").cast("timestamp"))) / 1_000_000
    return both.withColumn("seconds", seconds).where(F.col("seconds") >= limit_seconds)


def cut_parts(entries: DataFrame, stream: str, size: Column, limit: int) -> DataFrame:
    """entries with part: a new part begins where the bytes before an entry reach another multiple of the limit.

    Bytes are summed within spans of sequence numbers, on top of those of the spans before.
    """
    rows = entries.withColumn("__size", size).withColumn("__span", F.floor(F.col("sequence") / SPAN))
    before = Window.partitionBy(stream).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(stream, "__span").agg(F.sum("__size").alias("__bytes"))
    spans = spans.select(F.col(stream).alias("__s"), F.col("__span").alias("__of"), F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(stream, "__span").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum("__size").over(own), F.lit(0))).join(spans, F.col(stream).eqNullSafe(F.col("__s")) & (F.col("__span") == F.col("__of")))
    return rows.select(*entries.columns, F.floor((F.col("__before") + F.col("__own")) / limit).cast("long").alias("part"))
