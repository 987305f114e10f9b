"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours share many bits, and
cut into blocks. A block is a tree: an upper node factors out the bits that all
fingerprints below share (a pattern under a mask), and a lower node holds only
further bits. A search goes down from the root with the differences that it has
met so far and leaves out a whole group once they exceed the threshold; at the
leaves all bits have been compared, so the links are exact.

Blocks are searched in pairs, and only pairs whose shared bits differ in few
enough places: of B blocks in Gray order that is about B * C(log2 B, <= 3), not
B * B. A pair of blocks returns a spanning forest of its links, at most one link
for each fingerprint, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.arrow import as_bytes, sliced
from ledgerweave.operators.graph import connected_components
from ledgerweave.work import written

SEED, SHINGLE, NEAR = 42, 3, 3
#: Fingerprints in a block, children of a node, and queries that go down a tree together.
BLOCK, FANOUT, TOGETHER = 8192, 8, 1024
#: Links that are held before they are joined into the forest.
LINKS = 2_000_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, each the majority over the XXH64 of the text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[min(size, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    pairs = list(zip(starts.tolist(), ends.tolist(), strict=True))
    for at in range(0, n, 65_536):
        h = np.array([digest(line[a:b], SEED) for a, b in pairs[at : at + 65_536]], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the exclusive or of all its prefixes."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long, for each row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(t) for t in as_bytes(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rank = gray_rank(b["fp"].to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)  # signed order is unsigned order then
        yield pa.RecordBatch.from_arrays([b["fp"], pa.array(rank.view(np.int64))], ["fp", "rank"])


def shared_bits(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask of each run of codes: the mask has the bits on which the run agrees."""
    ones, zeros = np.bitwise_and.reduceat(codes, begins), np.bitwise_and.reduceat(~codes, begins)
    return ones, ones | zeros


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, held = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)

    def block(codes: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        made += 1
        pattern, mask = shared_bits(codes.view(np.uint64), np.array([0]))
        return pa.RecordBatch.from_arrays([pa.array([part + made]), pa.array(pattern.view(np.int64)), pa.array(mask.view(np.int64)), pa.array([codes.tobytes()], pa.binary())], ["block", "pattern", "mask", "codes"])

    for b in batches:
        held = np.concatenate([held, b["fp"].to_numpy()])
        while len(held) >= BLOCK:
            yield block(held[:BLOCK])
            held = held[BLOCK:]
    if len(held):
        yield block(held)


class GrayTree:
    """A block's hierarchy: levels from the root down, each with the first child's place, pattern and further mask of its nodes."""

    def __init__(self, codes: np.ndarray):
        n, widths = len(codes), [1]
        while widths[-1] < n:
            widths.append(widths[-1] * FANOUT)
        self.levels, above = [], None
        for w in reversed(widths):
            begins = np.arange(0, n, w)
            pattern, mask = shared_bits(codes, begins)
            own = mask if above is None else mask & ~np.repeat(above, FANOUT)[: len(begins)]
            self.levels.append((pattern, own))
            above = mask

    def search(self, codes: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (of the query, in this block) of all pairs that differ in at most `near` bits."""
        query, node, met = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint8)
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                query, met = np.repeat(query, FANOUT), np.repeat(met, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                if node.size and node.max() >= len(pattern):
                    real = node < len(pattern)
                    query, node, met = query[real], node[real], met[real]
            met = met + np.bitwise_count((codes[query] ^ pattern[node]) & own[node])
            close = met <= near
            query, node, met = query[close], node[close], met[close]
        return query, node


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a with b: the smallest place that each place reaches."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def block_links(left: np.ndarray, right: np.ndarray | None, near: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks, or within one."""
    every = left if right is None else np.concatenate([left, right])
    tree, shift = GrayTree(left if right is None else right), 0 if right is None else len(left)
    labels, a, b, held = np.arange(len(every)), [], [], 0
    for at in range(0, len(left), TOGETHER):
        q, n = tree.search(left[at : at + TOGETHER], near)
        q, n = q + at, n + shift
        if right is None:
            q, n = q[q < n], n[q < n]
        a, b, held = [*a, q], [*b, n], held + len(q)
        if held > LINKS:
            labels, a, b, held = _forest(labels, np.concatenate(a), np.concatenate(b)), [], [], 0
    if a:
        labels = _forest(labels, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(labels != np.arange(len(every)))
    return every[moved], every[labels[moved]]


def fingerprint_links(codes: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b): links whose components are those of all fingerprints within `near` bits of each other.

    codes has distinct fingerprints in column fp. What goes to every task is 24
    bytes for each block of BLOCK fingerprints.
    """
    spark = codes.sparkSession
    ranked = codes.mapInArrow(_ranked, "fp long, rank long").repartitionByRange("rank").sortWithinPartitions("rank")
    blocks = written(ranked.select("fp").mapInArrow(_blocks, "block long, pattern long, mask long, codes binary"), "gray-blocks")
    heads = blocks.select("block", "pattern", "mask").collect()
    ids, pattern, mask = (np.array([h[k] for h in heads], np.int64) for k in range(3))
    shared = spark.sparkContext.broadcast((ids, pattern.view(np.uint64), mask.view(np.uint64)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pattern, mask = shared.value
        for b in batches:
            for block, p, m in zip(*(b[c].to_pylist() for c in ("block", "pattern", "mask")), strict=True):
                p, m = (np.array([x], np.int64).view(np.uint64) for x in (p, m))
                other = ids[(ids >= block) & (np.bitwise_count((p ^ pattern) & m & mask) <= near)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), block)), pa.array(other)], ["block", "other"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16):
            for x, y, left, right in zip(b["block"].to_pylist(), b["other"].to_pylist(), b["codes"].to_pylist(), b["codes2"].to_pylist(), strict=True):
                u, v = block_links(np.frombuffer(left, np.uint64), None if x == y else np.frombuffer(right, np.uint64), near)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    pairs = blocks.select("block", "pattern", "mask").mapInArrow(candidates, "block long, other long")
    right = blocks.select(F.col("block").alias("other"), F.col("codes").alias("codes2"))
    tasks = max(1, min(len(heads) ** 2 // 2, 4 * spark.sparkContext.defaultParallelism, 10_000), len(heads))
    work = pairs.join(blocks.select("block", "codes"), "block").join(right, "other").repartition(tasks, "block", "other")
    return written(work.mapInArrow(links, "a long, b long"), "gray-links")


def components(rows: DataFrame, near: int = NEAR) -> DataFrame:
    """(fp, component_id, keep_fp) of the fingerprints in rows (doc_id, fp). The row that names a component has keep_fp."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(fingerprint_links(classes.select("fp"), near))
    found = found.select(F.col("node").alias("fp"), "component")
    named = written(classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "components")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first")
    least = named.groupBy("component").agg(first).select("component", F.col("first.least").alias("component_id"), F.col("first.fp").alias("keep_fp"))
    return named.join(least, "component").select("fp", "component_id", "keep_fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", near: int = NEAR) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs.

    Fingerprints within `near` bits are linked; component_id is the smallest id
    that a row reaches over links. A text without words has fingerprint zero and
    is linked like any other; very long texts count whole. Rows that repeat have
    rows of their own. Null ids name no component unless it has no other id. An
    empty table gives an empty result; other columns play no part.
    """
    rows = written(fingerprints(docs, text, key), "fingerprints")
    return rows.join(components(rows, near).drop("keep_fp"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """Of each component the row with the smallest id, with all its columns.

    Rows that share that id and its fingerprint all stand for one document; one
    of them stays. Null and empty texts are one group; an empty table gives an
    empty one.
    """
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(t) for t in as_bytes(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(fp)], [*names, "__lw_fp"])

    staged = written(docs.mapInArrow(run, f"{kinds}, __lw_fp long"), "near-rows")
    rows = staged.select("doc_id", F.col("__lw_fp").alias("fp"))
    named = components(rows, near).where("component_id IS NOT NULL OR fp = keep_fp")
    kept = rows.join(named, "fp").where("doc_id <=> component_id AND fp = keep_fp").groupBy("doc_id", "fp").agg(F.count("*").alias("__lw_many"))
    kept = written(kept.select(F.col("doc_id").alias("__lw_id"), F.col("fp").alias("__lw_kept"), "__lw_many"), "near-kept")
    same = F.col("doc_id").eqNullSafe(F.col("__lw_id")) & (F.col("__lw_fp") == F.col("__lw_kept"))
    once = staged.join(kept.where("__lw_many = 1"), same, "left_semi")
    repeated = staged.join(kept.where("__lw_many > 1"), same, "left_semi").dropDuplicates(["doc_id", "__lw_fp"])
    return once.unionByName(repeated).select(*names)
