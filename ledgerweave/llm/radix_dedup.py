"""Exact duplicates by distributed MSD radix partitioning.

The radix key of a text is its byte length followed by its bytes, A-Z lowered.
Digits are runs of successive bytes of that key. Equality is decided by the
bytes alone; no digest takes part.

1. Each task splits its own rows by successive digits until groups are single
   or ended. A group of copies leaves a task as one class, so that no later
   step meets a hot key, however many copies there are.
2. Classes are dealt out by the first digit: the length and 64 bytes. A digit
   whose classes hold more than HOT_BYTES gets a number, and its classes are
   dealt out by that number and the next, longer digit, over and over, until
   what a digit holds is small or its texts have ended. Numbers stay in tables.
3. Texts that have ended are equal where their digits are: an aggregation joins
   them. Each task splits what else was dealt to it by further digits to the
   end, and joins equal classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.arrow import as_bytes
from ledgerweave.work import written

#: Bytes of text that a task holds while it splits its own rows.
HELD_BYTES = 48 << 20
#: Bytes of the first digit, and how much longer each further one is.
FIRST, STEP = 64, 16
#: A digit is split again where its classes hold more bytes than this.
HOT_BYTES = 48 << 20


def split(texts: list[bytes], at: int = 0, width: int = 16) -> list[list[int]]:
    """Groups of equal texts, by successive digits; each digit is twice as long as the one before."""
    groups, todo = [], [(list(range(len(texts))), at, width)]
    while todo:
        rows, at, width = todo.pop()
        if len(rows) == 1:
            groups.append(rows)
            continue
        bins: dict[bytes, list[int]] = {}
        for r in rows:
            bins.setdefault(texts[r][at : at + width], []).append(r)
        for digit, own in bins.items():
            if len(own) == 1 or len(digit) < width:  # single, or ended
                groups.append(own)
            else:
                todo.append((own, at + width, 2 * width))
    return groups


def _collapse(names: list[str], text: str, key: str):
    """Task side of step 1: rows to classes. The row with the largest key stands for its class and keeps its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId() << 40, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held)
            raw = [x.lower() for x in as_bytes(table[text])]
            ids = table[key].to_pylist()
            n = len(raw)
            cls, cnt, head, top = [0] * n, [0] * n, [None] * n, [None] * n
            for own in split(raw):
                best = max(own, key=lambda r: (ids[r] is not None, ids[r] or 0, -r))
                made += 1
                for r in own:
                    cls[r], cnt[r], top[r] = part + made, len(own), ids[best]
                head[best] = best
            rows = table.take(pa.array(head, pa.int64())).combine_chunks()
            out = {
                "cls": pa.array(cls, pa.int64()), "key": pa.array(ids, pa.int64()), "sha": pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                "cnt": pa.array(cnt, pa.int64()), "top": pa.array(top, pa.int64()), "head": pa.array([h is not None for h in head]),
                "len": pa.array([len(x) for x in raw], pa.int64()), "digit": pa.array([x[:FIRST] if h is not None else None for x, h in zip(raw, head, strict=True)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays([*out.values(), *(rows[f"{c}"].combine_chunks() for c in names)], [*out, *(f"row_{c}" for c in names)])

        for b in batches:
            for at in range(0, b.num_rows, 512):
                piece = b.slice(at, 512)
                held.append(piece)
                size += piece.nbytes
                if size > HELD_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _join_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side of step 3: rows sorted by bucket, HOT_BYTES of texts in each at most. Gives rows for classes that equal another only."""
    key, own, texts = None, [], []

    def merged() -> Iterator[pa.RecordBatch]:
        out = []
        for group in split(texts, key[3]) if len(own) > 1 else []:
            if len(group) > 1:
                win = max((own[r] for r in group), key=lambda x: (x[2] is not None, x[2] or 0, -x[0]))
                size = sum(own[r][1] for r in group)
                out += [(own[r][0], win[0], win[2], size) for r in group]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["cls", "win", "keep", "size"])

    for b in batches:
        for at in range(0, b.num_rows, 512):
            p = b.slice(at, 512)
            rows = zip(*(p[c].to_pylist() for c in ("cls", "cnt", "top", "len", "parent", "digit", "upto")), as_bytes(p["text"]), strict=True)
            for cls, cnt, top, *bucket, raw in rows:
                if bucket != key:
                    if key is not None:
                        yield from merged()
                    key, own, texts = bucket, [], []
                own.append((cls, cnt, top))
                texts.append(raw.lower())
    if key is not None:
        yield from merged()


def _classes(docs: DataFrame, text: str, key: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Staged rows (heads carry the columns to keep), and classes that equal another."""
    names = list(dict.fromkeys([*keep, text]))
    source = docs.select(*{c: docs[c] for c in [*names, key]}.values())
    kinds = {f.name: f.dataType for f in source.schema}
    schema = T.StructType([T.StructField(n, k) for n, k in (("cls", T.LongType()), ("key", T.LongType()), ("sha", T.StringType()), ("cnt", T.LongType()), ("top", T.LongType()), ("head", T.BooleanType()), ("len", T.LongType()), ("digit", T.BinaryType()))] + [T.StructField(f"row_{c}", kinds[c]) for c in names])
    staged = written(source.mapInArrow(_collapse(names, text, key), schema), "radix")
    # A class's bucket: its length, the number of the digit before (0: none), its digit, and how many bytes both cover.
    bucket = ["len", "parent", "digit", "upto"]
    todo = staged.where("head").select("cls", "cnt", "top", "len", F.lit(0).cast("long").alias("parent"), "digit", F.lit(FIRST).cast("long").alias("upto"), F.col(f"row_{text}").alias("text"))
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")
    settled, upto, made = [], FIRST, 0
    while True:
        held = todo.where(F.col("len") > upto).groupBy(*bucket).agg(F.sum("len").alias("held"), F.count("*").alias("classes")).where((F.col("held") > HOT_BYTES) & (F.col("classes") > 1))
        hot = written(held.select(*(F.col(c).alias(f"hot_{c}") for c in bucket[:3]), (F.monotonically_increasing_id() + made + 1).alias("number")), "radix-hot")
        last = hot.agg(F.max("number")).first()[0]
        if last is None:
            settled.append(todo)
            break
        # Spark knows the table's size: it is broadcast where it is small, and else the join's skewed keys are split.
        told = todo.join(hot, (F.col("len") == F.col("hot_len")) & (F.col("parent") == F.col("hot_parent")) & (F.col("digit") == F.col("hot_digit")), "left")
        settled.append(told.where("number IS NULL").select(todo.columns))
        digit = F.substring(lowered, upto + 1, upto * (STEP - 1))
        todo = written(told.where("number IS NOT NULL").select("cls", "cnt", "top", "len", F.col("number").alias("parent"), digit.alias("digit"), F.lit(upto * STEP).cast("long").alias("upto"), "text"), "radix-todo")
        upto, made = upto * STEP, last
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    merged = rows.where("len > upto").repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_join_classes, "cls long, win long, keep long, size long")
    merged = written(merged, "radix-merged")
    ended = rows.where("len <= upto").select("cls", "cnt", "top", *bucket)
    best = F.max(F.struct(F.col("top").isNotNull().alias("known"), "top", (-F.col("cls")).alias("win"))).alias("best")
    alike = ended.groupBy(*bucket).agg(best, F.sum("cnt").alias("size"), F.count("*").alias("classes")).where("classes > 1")
    alike = alike.select(*(F.col(c).alias(f"of_{c}") for c in bucket), (-F.col("best.win")).alias("win"), F.col("best.top").alias("keep"), "size")
    same = [F.col(c) == F.col(f"of_{c}") for c in bucket]
    short = ended.join(alike, same).select("cls", "win", "keep", "size")
    return staged, merged.unionByName(written(short, "radix-ended"))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Texts are equal when identical after lowering A-Z; a null text is empty. Of
    equal texts the row with the largest key stays; a null key counts as the
    smallest, and of rows that share the largest key one stays. Very long texts
    are compared whole. Rows that repeat have rows of their own. Empty tables
    give an empty result. Other columns play no part.
    """
    staged, merged = _classes(docs, text, key, [])
    rows = staged.select("cls", "key", "sha", "cnt", "top", "head").join(merged, "cls", "left")
    same = F.col("win").isNull()
    return rows.select(
        F.col("key").alias("doc_id"),
        F.when(same, F.col("top")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(same, F.col("cnt")).otherwise(F.col("size")).alias("group_size"),
        (F.col("head") & (same | (F.col("win") == F.col("cls")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns.

    Null and empty texts are equal, so one such row stays; of rows that tie or
    repeat one stays. An empty table gives an empty one.
    """
    staged, merged = _classes(docs, text, key, docs.columns)
    lost = merged.where("win <> cls").select("cls")
    return staged.where("head").join(lost, "cls", "left_anti").select(*(F.col(f"row_{c}").alias(c) for c in docs.columns))
