"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies: the source's
target over its size. The whole part is taken as it is. The fractional parts are
rounded in pairs: mass moves between two documents, in words, in a random
direction whose odds keep each document's expectation, until one of them is
integral. A pair keeps its words, so a source's total stays at its target up to
one last document.

Rows are dealt to buckets by a hash of their id, so a hot source is spread over
many. A bucket leaves at most one fractional document; these residuals meet in
further rounds, FAN of them at a time, up to one for each source: a reduction
tree. Every choice follows from a hash of the seed, the level and the ids, so
reruns agree.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.arrow import batch, sliced, word_counts
from ledgerweave.work import written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: Rows of a source in a bucket; residuals that meet in one step of the tree.
BUCKET_ROWS, FAN = 2_000, 64
TINY = 1e-9


def row_digest(docs: DataFrame) -> Column:
    """A number that tells rows of docs apart by all their columns; rows that share it are alike (maps can't be hashed and play no part)."""
    return F.xxhash64(*(docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()))


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, digest, size): words of each whole text, however long; a null text has none."""

    def run(batches):
        for b in sliced(batches, 1024):
            yield batch({"doc_id": b["doc_id"], "source": b["source"], "digest": b["digest"], "size": word_counts(b["text"])})

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), row_digest(docs).alias("digest"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, digest long, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rows, target), one row for each source.

    Sources by code point, null last, weigh `weights`, repeating. They share the
    sum of all sizes by weight; what lies over `most` times a source's size goes
    to the others by weight, until none is above. With sources ordered by
    capacity over weight, those that stop come first: the level of the rest is
    what is left over their weight. One row for each source meets in a window,
    never a row for each document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").isNull(), "source")
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("share", F.col("left") / F.col("open"))
    per = per.withColumn("stops", F.col("share") >= F.col("level"))
    # Shares rise up to the first source that doesn't stop and fall after it; its share is the common level.
    per = per.withColumn("common", F.max(F.when(~F.col("stops"), F.col("share"))).over(everything))
    target = F.when(F.col("level") <= F.coalesce(F.col("common"), F.lit(float("inf"))), F.col("cap")).otherwise(F.col("weight") * F.col("common"))
    return per.select("source", "source_size", "rows", target.alias("target"))


def draw(seed: int, *of: object) -> random.Random:
    """A generator that depends on what it is for and on nothing else."""
    return random.Random(int.from_bytes(hashlib.blake2b(repr((seed, *of)).encode(), digest_size=8).digest(), "big"))


def pivot(odds: list[float], size: list[int], rng: random.Random) -> tuple[list[float], int | None]:
    """Rounded odds, and the row that stays fractional, if any. Words odds*size keep their sum but for that row."""
    odds, open_row = list(odds), None
    for k, p in enumerate(odds):
        if size[k] == 0:
            odds[k] = 1.0 if rng.random() < p else 0.0
            continue
        if p <= TINY or p >= 1 - TINY:
            odds[k] = float(p > 0.5)
            continue
        if open_row is None:
            open_row = k
            continue
        i, r = open_row, size[k] / size[open_row]
        q = odds[i]
        up = min(1 - q, p * r)  # row i gains, row k gives
        down = min(q, (1 - p) * r)
        if rng.random() * (up + down) < down:
            q, p = q + up, p - up / r
        else:
            q, p = q - down, p + down / r
        left = None
        for row, x in ((i, q), (k, p)):
            if x <= TINY or x >= 1 - TINY:
                odds[row] = float(x > 0.5)
            else:
                odds[row], left = x, row
        open_row = left
    return odds, open_row


ROWS = "source string, bucket long, doc_id long, digest long, nth long, size long, source_size long, target double, whole long, odds double, settled boolean"


def _reduce(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        source, bucket = (x.as_py() for x in key)
        ids, digest, nth, size, odds = (rows[c].to_pylist() for c in ("doc_id", "digest", "nth", "size", "odds"))
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, digest[k], nth[k]))
        rng = draw(seed, level, source, bucket)
        rng.shuffle(order)
        odds, left = pivot([odds[k] for k in order], [size[k] for k in order], rng)
        if last and left is not None:
            odds[left], left = float(rng.random() < odds[left]), None
        rows = rows.take(pa.array(order, pa.int64())).drop_columns(["odds", "settled"])
        settled = pa.array([k != left for k in range(len(order))], pa.bool_())
        return rows.append_column("odds", pa.array(odds, pa.float64())).append_column("settled", settled)

    return run


def mix(sized: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """(doc_id, digest, nth, size, source, source_size, target, copies, taken), one row for each row of sized.

    No row has more than `most` copies. A source whose texts are all empty has
    target 0. Rows that repeat an id are rows of their own: their digest tells
    them apart, and nth counts those that are alike in all columns. Rows are
    dealt out by id, digest and nth, so that one id (or none) with very many rows
    is spread, too. A null source is a source, and comes last. An empty table
    gives an empty result. Bucket counts follow from the sources' row counts
    alone.
    """
    per = written(targets(sized, weights, most), "targets")
    alike = sized.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("n"))  # combined before the shuffle
    rows = alike.select("doc_id", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"), "source", "size")
    per = per.select(F.col("source").alias("of"), "source_size", "rows", "target")
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("of")))
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    expected = F.when(F.abs(expected - F.round(expected)) < TINY, F.round(expected)).otherwise(expected)
    buckets = F.greatest(F.ceil(F.col("rows") / bucket_rows), F.lit(1))
    rows = rows.select("source", F.pmod(F.xxhash64("doc_id", "digest", "nth"), buckets).alias("bucket"), "doc_id", "digest", "nth", "size", "source_size", "target", F.floor(expected).alias("whole"), (expected - F.floor(expected)).alias("odds"))
    rows = rows.withColumn("settled", F.lit(False))
    columns = [c.split()[0] for c in ROWS.split(", ")]
    level, done, most_buckets = 0, [], per.agg(F.max(F.ceil(F.col("rows") / bucket_rows))).first()[0] or 1
    while True:
        last = most_buckets <= 1
        step = written(rows.select(columns).groupBy("source", "bucket").applyInArrow(_reduce(seed, level, last), ROWS), "mix")
        done.append(step.where("settled"))
        if last:
            break
        rows = step.where("NOT settled").withColumn("bucket", F.expr(f"bucket div {fan}")).withColumn("settled", F.lit(False))
        level, most_buckets = level + 1, -(-most_buckets // fan)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("odds").cast("long")
    return out.select("doc_id", "digest", "nth", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 42, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """mix() of documents, from whole texts; null and empty ones have no words."""
    return mix(written(sizes(docs, text, key, source), "sizes"), seed, **options)


def apply_mix(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    Null and empty texts have no words; their copies are drawn like others'. Rows
    that share an id are told apart by all their columns, so reruns agree, and
    rows that are alike stand for each other. Very long texts are counted whole.
    An empty table gives an empty one.
    """
    key, digest = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__lw_digest"
    first = F.row_number().over(Window.partitionBy("__lw_key", digest).orderBy(F.lit(1)))  # of rows that are alike one; the limit is applied before the shuffle, too
    rows = docs.withColumn(digest, row_digest(docs)).withColumn("__lw_key", key).withColumn("__lw_first", first).where("__lw_first = 1").drop("__lw_first")
    plan = mix(written(sizes(docs), "sizes"), seed, **options).where("copies > 0").select(key.alias("__lw_of"), F.col("digest").alias("__lw_like"), F.col("copies").cast("int").alias("__lw_copies"))
    told = rows.join(plan, (F.col("__lw_key") == F.col("__lw_of")) & (F.col(digest) == F.col("__lw_like")))
    return told.withColumn("__lw_copy", F.explode(F.sequence(F.lit(1), F.col("__lw_copies")))).select(*docs.columns)
