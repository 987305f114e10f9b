"""Incremental operators as Structured Streaming (T01-T06): stalls, runs once only, journals, growing batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from time import monotonic

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerweave.operators import journal

STALL = "key string, silent_from timestamp, seconds double"


def watch_stalls(marks: DataFrame, key: str, time: str, limit_seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, silent_from, seconds): silences of at least the limit between a key's marks, as a stream.

    The state of a key is the time of its last mark. A key that stays silent
    beyond the limit in event time is told once, with the watermark's progress.
    """
    limit = int(limit_seconds * 1000)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((keys[0], pd.Timestamp(last, unit="us"), float(limit_seconds)))
            state.remove()
        else:
            seen = sorted(int(x.value // 1000) for b in batches for x in b["time"])
            last = state.get[0] if state.exists else None
            for now in seen:
                if last is not None and now - last >= limit * 1000:
                    out.append((keys[0], pd.Timestamp(last, unit="us"), (now - last) / 1e6))
                last = now if last is None else max(last, now)
            state.update((last,))
            due = last // 1000 + limit
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["key", "silent_from", "seconds"])

    rows = marks.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)
    return rows.groupBy("key").applyInPandasWithState(step, STALL, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def runs_once(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each run key within the watermark: a repeated submission doesn't run again."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by window; an addition, with no counterpart in document processing."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def append_to(path: str, order: list[str]):
    """A foreachBatch writer that appends each batch under its id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


class JournalError(RuntimeError):
    """Why a batch isn't appended to a journal."""


def append_chained(path: str, stream: str, order: list[str], payload: str):
    """A foreachBatch writer of hash-chained journals that checks each stream's tail alone.

    Each batch continues its streams from their last entries: those are kept
    beside the entries, a row for each stream, under the id of the batch that
    they stand after. A tail that doesn't carry its own hash stops the batch, and
    so does an entry that claims another predecessor (a column previous_hash in
    the batch, where there is one). A repeated batch starts from the same tails
    and replaces itself; what a lost attempt left beyond them is never read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, tails = batch.sparkSession, None
        if batch_id > 0:
            tails = spark.read.parquet(f"{path}/tails/after={batch_id - 1}")
            if bad := [r[0] for r in journal.tail_faults(tails, stream, payload).limit(5).collect()]:
                raise JournalError(f"E_JOURNAL_TAIL {bad}")
        claimed = "previous_hash" in batch.columns
        rows = batch.withColumnRenamed("previous_hash", "__claimed") if claimed else batch
        made = journal.chained(rows, stream, order, payload, tails)
        if claimed:
            wrong = F.col("__claimed").isNotNull() & (F.col("__claimed") != F.col("previous_hash"))
            refused = F.raise_error(F.concat(F.lit("E_JOURNAL_PREDECESSOR "), F.col(stream).cast("string"))).cast("string")
            made = made.withColumn("hash", F.when(wrong, refused).otherwise(F.col("hash"))).drop("__claimed")
        made.write.mode("overwrite").parquet(f"{path}/entries/batch={batch_id}")
        written = spark.read.parquet(f"{path}/entries/batch={batch_id}")
        columns = [stream, "sequence", "previous_hash", payload, "hash"]
        last = written.groupBy(stream).agg(F.max_by(F.struct(*columns[1:]), "sequence").alias("t")).select(stream, "t.*")
        if tails is not None:
            now = last.select(F.col(stream).alias("__of"))
            last = last.unionByName(tails.join(now, F.col(stream).eqNullSafe(F.col("__of")), "left_anti").select(*columns))
        last.write.mode("overwrite").parquet(f"{path}/tails/after={batch_id}")

    return write


RUN = "key string, verdict string, fingerprint string"


def watch_runs(events: DataFrame, key: str, fingerprint: str, time: str, late: str = "1 hour") -> DataFrame:
    """(key, verdict, fingerprint) for each finished run of a stream: first, repeat, or mismatch with the first one's fingerprint.

    The state of a key is its first fingerprint; it is kept, since a repeat may
    come at any time.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(batches)).sort_values(["time", "fingerprint"], kind="stable")
        out, first = [], state.get[0] if state.exists else None
        for own in seen["fingerprint"]:
            out.append((keys[0], "first" if first is None else "repeat" if own == first else "mismatch", own))
            first = own if first is None else first
        state.update((first,))
        yield pd.DataFrame(out, columns=["key", "verdict", "fingerprint"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(fingerprint).cast("string").alias("fingerprint"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)
    return rows.groupBy("key").applyInPandasWithState(step, RUN, "first string", "append", GroupStateTimeout.NoTimeout)


class Heartbeat(StreamingQueryListener):
    """Hands a mark of each query's progress to a writer, at most one a second for each query and never two alike in a row.

    A writer that fails is dropped and the query goes on: a mark isn't worth a run.
    """

    def __init__(self, write: Callable[[dict], None], seconds: float = 1.0, clock: Callable[[], float] = monotonic):
        self.write, self.seconds, self.clock, self.last = write, seconds, clock, {}

    def _mark(self, query: str, state: str, batch: int, rows: int, always: bool = False) -> None:
        now, mark = self.clock(), {"query": query, "state": state, "batch": batch, "rows": rows}
        at, before = self.last.get(query, (None, None))
        if mark == before or (not always and at is not None and now - at < self.seconds):
            return
        self.last[query] = (now, mark)
        with suppress(Exception):
            self.write(mark)

    def onQueryStarted(self, event) -> None:
        self._mark(str(event.id), "started", -1, 0, True)

    def onQueryProgress(self, event) -> None:
        self._mark(str(event.progress.id), "running", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._mark(str(event.id), "idle", -1, 0)

    def onQueryTerminated(self, event) -> None:
        self._mark(str(event.id), "failed" if event.exception else "finished", -1, 0, True)


def grow_batch(path: str, fingerprint: str, name: str):
    """A foreachBatch writer of submissions; read_batch() folds them to one file for each fingerprint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        names = batch.groupBy(fingerprint).agg(F.collect_set(name).alias("names"), F.count("*").alias("submissions"))
        names.write.mode("overwrite").parquet(f"{path}/submission={batch_id}")

    return write


def read_batch(rows: DataFrame, fingerprint: str) -> DataFrame:
    """(fingerprint, names, submissions) over all submissions so far."""
    flat = rows.groupBy(fingerprint).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.sum("submissions").alias("submissions"))
    return flat.select(fingerprint, F.concat_ws(",", "names").alias("names"), "submissions")
