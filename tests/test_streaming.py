"""Streams over small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerweave.streaming import watch

AT = dt.datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame([(k, AT + dt.timedelta(seconds=s), n) for k, s, n in rows], "key string, time timestamp, name string").coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema("key string, time timestamp, name string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stalls(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", 0, ""), ("a", 100, ""), ("b", 0, ""), ("a", 400, "")])
    put(spark, tmp_path / "in", [("c", 2000, "")])
    put(spark, tmp_path / "in", [("c", 2010, "")])
    query = watch.watch_stalls(stream(spark, tmp_path / "in"), "key", "time", 210, "1 second").writeStream.format("memory").queryName("stalls").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["key"], (r["silent_from"].replace(tzinfo=None) - AT).total_seconds()) for r in spark.table("stalls").collect()}
    assert ("a", 100.0) in got and ("b", 0.0) in got and not any(k == "c" for k, _ in got)


def test_runs_once_and_batches(spark, tmp_path):
    put(spark, tmp_path / "in", [("f1", 0, "x"), ("f1", 1, "y")])
    put(spark, tmp_path / "in", [("f1", 2, "x"), ("f2", 3, "z")])
    once = watch.runs_once(stream(spark, tmp_path / "in"), "key", "time").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert sorted(r["key"] for r in spark.table("once").collect()) == ["f1", "f2"]
    out = str(tmp_path / "batch")
    stream(spark, tmp_path / "in").writeStream.foreachBatch(watch.grow_batch(out, "key", "name")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, watch.read_batch(spark.read.parquet(out), "key").collect())) == [("f1", "x,y", 3), ("f2", "z", 1)]
    log = str(tmp_path / "log")
    stream(spark, tmp_path / "in").writeStream.foreachBatch(watch.append_to(log, ["time"])).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(log).count() == 4


def test_tumbling(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", s, "") for s in (0, 30, 61)])
    rows = watch.tumbling(spark.read.parquet(str(tmp_path / "in")), "time", "1 minute", ["key"])
    assert sorted(r["n"] for r in rows.select("n").collect()) == [1, 2] and rows.where(F.col("n") > 1).count() == 1


def test_journals_grow_by_their_tails(spark, tmp_path):
    from ledgerweave.operators import journal

    batch = lambda *rows: spark.createDataFrame(list(rows), "s string, k int, p string, previous_hash string")
    path = str(tmp_path / "journal")
    write = watch.append_chained(path, "s", ["k"], "p")
    write(batch(("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, "z", None), (None, 1, "n", None)), 0)
    last = {r["s"]: r["hash"] for r in spark.read.parquet(f"{path}/tails/after=0").collect()}
    write(batch(("a", 3, "w", last["a"]), ("c", 1, "v", None), (None, 2, "n", None)), 1)
    write(batch(("a", 3, "w", last["a"]), ("c", 1, "v", None), (None, 2, "n", None)), 1)  # a batch that comes again replaces itself
    entries = lambda: spark.read.parquet(f"{path}/entries")
    told = sorted(map(tuple, journal.verify_chain(entries(), "s", "p").collect()), key=str)
    assert told == [("a", 3, 0, None), ("b", 1, 0, None), ("c", 1, 0, None), (None, 2, 0, None)] and spark.read.parquet(f"{path}/tails/after=1").count() == 4
    whole = journal.chained(entries().select("s", "k", "p"), "s", ["k"], "p")
    assert {r["hash"] for r in whole.collect()} == {r["hash"] for r in entries().collect()}
    with pytest.raises(Exception, match="E_JOURNAL_PREDECESSOR"):
        write(batch(("a", 4, "u", "0" * 64)), 2)
    tails = spark.read.parquet(f"{path}/tails/after=1").withColumn("p", F.when(F.col("s") == "b", "forged").otherwise(F.col("p"))).collect()
    spark.createDataFrame(tails).write.mode("overwrite").parquet(f"{path}/tails/after=1")
    with pytest.raises(watch.JournalError, match="E_JOURNAL_TAIL .*b"):
        write(batch(("a", 4, "u", None)), 2)


def test_runs_are_compared(spark, tmp_path):
    put(spark, tmp_path / "in", [("f1", 0, "x"), ("f1", 1, "x"), ("f2", 2, "p")])
    put(spark, tmp_path / "in", [("f1", 3, "y"), ("f2", 4, "p"), ("f3", 5, "q")])
    runs = watch.watch_runs(stream(spark, tmp_path / "in"), "key", "name", "time").writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    runs.awaitTermination(120)
    assert sorted(map(tuple, spark.table("runs").collect())) == [("f1", "first", "x"), ("f1", "mismatch", "y"), ("f1", "repeat", "x"), ("f2", "first", "p"), ("f2", "repeat", "p"), ("f3", "first", "q")]


def test_heartbeats():
    from types import SimpleNamespace as At

    marks, now = [], [0.0]
    beat = watch.Heartbeat(marks.append, clock=lambda: now[0])
    progress = lambda batch, rows: beat.onQueryProgress(At(progress=At(id="q", batchId=batch, numInputRows=rows)))
    beat.onQueryStarted(At(id="q"))
    for at, batch in ((0.2, 1), (1.1, 2), (1.5, 3), (2.2, 3), (3.4, 3)):
        now[0] = at
        progress(batch, 5)
    beat.onQueryTerminated(At(id="q", exception=None))
    assert [(m["state"], m["batch"]) for m in marks] == [("started", -1), ("running", 2), ("running", 3), ("finished", -1)]
    watch.Heartbeat(lambda mark: 1 / 0).onQueryStarted(At(id="q"))  # a writer that fails stops nothing
