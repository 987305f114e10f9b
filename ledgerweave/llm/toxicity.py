"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of pairs of neighbours, of triples and of
pairs that skip one word, hashed to 2**BITS places. Each coordinate has its own
rate, and L1 keeps a weight at zero until its evidence is large enough, so a
model is a short list of places and weights. Features that only one or two rows
have are not learnt.

The model is fitted on at most TRAIN_ROWS labelled documents (those with the
smallest hash of their id) and at most TRAIN_PLACES features of theirs in all;
both are documented bounds, so the one task that learns holds no more than that.
Scoring reads every whole text; a model has at most 2**BITS weights of 12 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.arrow import as_bytes, held, sliced
from ledgerweave.work import written

#: Places that features are hashed to, and labelled rows that a model is fitted on, at most.
BITS, TRAIN_ROWS = 22, 12_000
#: Features that a model is fitted on, at most, over all rows; 4 bytes each. Rows that would exceed it are left out.
TRAIN_PLACES = 48_000_000
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 4.0, 0.0, 8
#: A feature is learnt if so many of the rows have it.
LEAST_ROWS = 3
THRESHOLD = 0.7
#: Scores hold toxic texts to be so many times likelier than they are among the labelled rows: missing one costs more than a false alarm.
#: With few toxic rows to learn from the odds are raised less: as if so many more had been seen that say nothing.
ODDS, DOUBT = 3.0, 20
#: A task's cache of words; longer words aren't kept.
CACHE, LONGEST_KEPT = 300_000, 64
#: Odd multipliers that tell the kinds of features apart (digits of pi and e in hexadecimal).
MIX = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1, 0x082EFA98EC4E6C89, 0xB7E151628AED2A6B))
ENDS = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_#%&/\\|"


class Features:
    """Places of a text's features, each once."""

    def __init__(self, bits: int = BITS):
        self.shift, self.words = np.uint64(64 - bits), {}

    def word(self, raw: bytes) -> int:
        text = raw.decode(errors="replace").lower()
        h = xxhash.xxh64_intdigest(text.strip(ENDS) or text)
        if len(raw) <= LONGEST_KEPT:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[raw] = h
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        words, own = self.words, self.word
        raw = text.split()
        h = np.array([words[w] if w in words else own(w) for w in raw], np.uint64)
        one, two, three, skip, last = MIX
        pair = h[:-1] * two + h[1:]
        kinds = [h * one, pair * two, (pair[:-1] * three + h[2:]) * three, (h[:-2] * skip + h[2:]) * skip]
        x = np.concatenate(kinds)
        x ^= x >> np.uint64(31)
        return np.unique((x * last >> self.shift).astype(np.uint32))


def features_of(bits: int) -> Features:
    """One for each Python worker: its tasks share the bounded cache."""
    return held(("features", bits), lambda: Features(bits))


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.places] = self.weights
        return w


def ftrl(rows: list[np.ndarray], labels: list[int], bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, least_rows: int = LEAST_ROWS) -> Model:
    """FTRL-proximal over rows in order; the last coordinate is the bias, which has no L1."""
    seen = np.zeros(1 << bits, np.int32)
    for x in rows:
        seen[x] += 1
    kept = np.flatnonzero(seen >= least_rows)
    # Rows hold places among the kept features from here on; what is learnt has no room for the others.
    seen[:] = -1
    seen[kept] = np.arange(len(kept), dtype=np.int32)
    size = len(kept) + 1
    rows = [np.append(own[own >= 0], np.int32(size - 1)) for own in (seen[x] for x in rows)]
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, l1)
    penalty[-1] = 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= penalty[at], 0.0, -(zs - np.sign(zs) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = sigmoid(float(w.sum())) - y
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    places = np.flatnonzero(w[:-1])
    return Model(kept[places], w[places], float(w[-1]), bits)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS, train_places: int = TRAIN_PLACES) -> Model:
    """A model from labelled rows whose crc32(doc_id as text) mod 3 isn't 1.

    Labels without an id or a mark are left out; of several for an id the largest
    counts. Of documents that share an id one counts, that whose text has the
    smallest hash. A null text is empty and has no feature; a very long one has
    2**bits at most. Without labelled rows, and for empty tables, every weight is 0.
    """
    named = labels.select(labels["doc_id"].cast("long").alias("__id"), labels["toxic"].cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL AND crc32(CAST(__id AS string)) % 3 <> 1")
    named = named.groupBy("__id").agg(F.max("__y").alias("__y"))
    # A cut on the hash leaves some more than is wanted, however many labels there are; the rest are ranked.
    share = min(1.0, (1.5 * train_rows + 200) / max(1, named.count()))
    draw = F.shiftrightunsigned(F.xxhash64("__id"), 11)
    chosen = named.where(draw <= F.lit(share * 2**53)).orderBy(draw, "__id").limit(train_rows)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    rows = rows.groupBy("doc_id").agg(one, F.first("__y").alias("__y")).select("doc_id", "__y", F.col("t.text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = features_of(bits)
        for b in sliced(batches, 512):
            x = [features(t).tobytes() for t in as_bytes(b["text"])]
            yield pa.RecordBatch.from_arrays([b["order"], b["doc_id"], b["y"], pa.array(x, pa.binary())], ["order", "doc_id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, places = [], [], 0
        for b in batches:
            for row, label in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                if places + len(row) // 4 <= train_places:
                    x.append(np.frombuffer(row, np.uint32))
                    y.append(label)
                    places += len(row) // 4
        m = ftrl(x, y, bits)
        raised = math.log((ODDS * sum(y) + DOUBT) / (sum(y) + DOUBT))
        yield pa.RecordBatch.from_arrays([pa.array([m.places.astype(np.int64).tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias + raised])], ["places", "weights", "bias"])

    ready = rows.select(F.xxhash64("doc_id").alias("order"), "doc_id", F.col("__y").alias("y"), "text").mapInArrow(extract, "order long, doc_id long, y int, x binary")
    ready = written(ready, "toxic-features")
    got = ready.repartition(1).sortWithinPartitions("order", "doc_id", "x").mapInArrow(learn, "places binary, weights binary, bias double").first()
    if got is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, bits)
    return Model(np.frombuffer(got["places"], np.int64), np.frombuffer(got["weights"]), got["bias"], bits)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns in keep and a score between 0 and 1 for each row, from its whole text alone; a null text is empty."""
    names = keep if keep is not None else docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights, features = model.dense(), features_of(model.bits)
        for b in sliced(batches):
            p = [sigmoid(float(weights[features(t)].sum()) + model.bias) for t in as_bytes(b["__lw_text"])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(p, pa.float64())], [*names, name])

    source = docs.select(*names, docs[text].alias("__lw_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__lw_text")
    return source.mapInArrow(run, f"{schema}, `{name}` double")


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    held_out: crc32(doc_id as text) mod 3 is 1; the model has seen none of these.
    A null id isn't held out and has no label. Null and empty texts have the
    bias's score; very long ones are scored whole. Rows that repeat an id have
    rows of their own; an empty table gives an empty result.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = score(own, fit(docs, labels), keep=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns.

    Null and empty texts have the bias's score, very long ones are scored whole;
    rows that tie or repeat stay or go alike. An empty table gives an empty one.
    """
    model = fit(docs, labels)
    return score(docs.select(*docs.columns), model, name="__lw_score").where(F.col("__lw_score") < threshold).select(*docs.columns)
