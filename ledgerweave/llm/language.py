"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words padded by
a blank) in order. A document's distance to a language adds up how far each of
its own n-grams is out of place in the language's profile; an n-gram that the
profile lacks counts as far as can be. The nearest language is predicted.

Profiles are fitted on at most TRAIN_ROWS documents of each language (those with
the smallest hash of their id), for at most MOST_LANGS languages; both are
documented bounds. They hold DEPTH n-grams of each language, and that is all
that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.arrow import as_bytes, sliced
from ledgerweave.work import written

#: N-grams in a profile, and documents that a language's profile is fitted on, at most.
DEPTH, TRAIN_ROWS = 300, 1_000
#: Languages that profiles are fitted for, at most: those with the most documents. It bounds what is broadcast.
MOST_LANGS = 500
UNDETERMINED = "und"
#: The number of a blank in an n-gram; not 0, so that n-grams of different lengths differ.
BLANK = 1


@cache
def letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for all other characters."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            table[c] = ord(s.lower()[0])
    return table


def ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as numbers, ascending, and how often each occurs."""
    codes = letters()[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)]
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]  # one blank between words
    codes[codes == 0] = BLANK
    two = codes[:-1] << 21 | codes[1:]
    three = (two[:-1] << 21 | codes[2:])[codes[1:-1] != BLANK]
    return np.unique(np.concatenate([codes[codes != BLANK], two, three]), return_counts=True) if len(codes) > 1 else (codes[:0], codes[:0])


def ranked(grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The most frequent n-grams in order; equally frequent ones ascend."""
    return grams[np.argsort(-counts, kind="stable")[:depth]]


class Profiles:
    """Ranks of all languages' n-grams in one table; what a profile lacks ranks at -1."""

    def __init__(self, profiles: dict[str, list[int]], depth: int = DEPTH):
        self.names, self.depth = sorted(profiles), depth
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        return np.where(ranks < 0, self.depth, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)

    def predict(self, text: bytes) -> tuple[str, float]:
        """Language and a score: how much nearer it is than the next (to all out of place, for one language)."""
        if not self.names:
            return UNDETERMINED, 0.0
        own = ranked(*ngrams(text), self.depth)
        if not len(own):
            return UNDETERMINED, 0.0
        d = self.distances(own)
        best = int(d.argmin())
        next_best = float(np.delete(d, best).min()) if len(d) > 1 else float(self.depth * len(own))
        return self.names[best], 1 - float(d[best]) / next_best if next_best > d[best] else 0.0


def _chosen(rows: DataFrame, train_rows: int, most_langs: int) -> DataFrame:
    """(lang, doc_id): of each language the documents with the smallest hash of their id, at most train_rows.

    Counts of each language give a cut on the hash that leaves some more than
    that, so that the ranking by language meets a few rows, however many a
    language has. Counts are of different ids, by a sketch; the slack is many
    times its error.
    """
    n = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.05).alias("n"))
    n = n.orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not n:
        return rows.select("lang", "doc_id").limit(0)
    share = F.create_map(*(F.lit(x) for r in n for x in (r["lang"], min(1.0, (1.5 * train_rows + 200) / max(1, r["n"])))))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    drawn = draw <= F.element_at(share, F.col("lang")) * float(2**53)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))
    left = rows.select("lang", "doc_id").where(drawn).distinct()
    return left.withColumn("n", first).where(F.col("n") <= train_rows).select("lang", "doc_id")


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, depth: int = DEPTH, most_langs: int = MOST_LANGS) -> Profiles:
    """Profiles of the languages of documents whose crc32(doc_id as text) mod 4 isn't 2.

    Rows without an id or a language teach nothing; a null or empty text adds no
    n-gram, a very long one counts whole. Of rows that share an id and a
    language one text counts, that with the smallest hash. An empty table gives
    no profiles, and then every prediction is `und`.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text")).where("lang IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS string)) % 4 <> 2")
    chosen = _chosen(rows, train_rows, most_langs).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))
    chosen = written(chosen, "language-rows")  # a table, so that Spark knows its size and broadcasts it only if small
    rows = rows.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")))
    rows = rows.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("lang", F.col("t.text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for b in sliced(batches, 256):
            for lang, text in zip(b["lang"].to_pylist(), as_bytes(b["text"]), strict=True):
                found.setdefault(lang, []).append(ngrams(text))
                if len(found[lang]) >= 256:
                    found[lang] = [_added(found[lang])]
        for lang, parts in found.items():
            grams, counts = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= depth)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, depth)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs, from its whole text alone.

    A text that is null or has no letter is `und` with score 0, and so is every
    text where no language was learnt; a very long text counts whole. Rows that
    repeat an id have rows of their own. held_out: crc32(doc_id as text) mod 4 is
    2; a null id isn't held out and isn't learnt from. Equally near languages:
    the first by name. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for b in sliced(batches):
            names, scores = zip(*map(profiles.predict, as_bytes(b["text"])), strict=True)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")
