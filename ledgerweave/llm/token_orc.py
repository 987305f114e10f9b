"""Token ids as ORC: integer run-length encoded stripes, row indexes, Bloom filters on document ids.

Texts are dealt out by ranges of doc_id and sorted, encoded, and written by
Spark's ORC writer: files and their rows ascend in doc_id. A file's rows carry
the file's number and the count of ids before them in it, so that a reader adds
one offset for each file and never needs a global running sum. Readers split
files by stripe; filters on doc_id skip files and row groups by their minima,
maxima and Bloom filters.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.arrow import as_bytes, held, int_lists, sliced
from ledgerweave.work import new_path

#: Entries of a task's cache of words; it starts anew when full.
CACHE = 500_000
#: Words longer than this aren't kept.
LONGEST_KEPT = 64
#: Texts of these characters are their own NFC form and lower character by character.
PLAIN = re.compile("[\x21-\x7e\xa1-įı-ſ]+")
ORC = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
STAGED = "part int, local_start long, doc_id long, n_tokens long, ids array<int>"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte: itself where it prints, else the next unused code point from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in prints else next(spare)) for b in range(256)}


class _Cache(dict):
    """Ids of words; `ends` has those of single characters that may follow a letter or digit as a word of their own."""

    def __init__(self, make: Callable[[bytes], bytes], ends: dict[int, bytes]):
        super().__init__()
        self.make, self.ends = make, ends

    def __missing__(self, word: bytes) -> bytes:
        if word[-1] in self.ends and word[-2:-1].isalnum():  # a word and a full stop or comma: no entry of its own
            return self[word[:-1]] + self.ends[word[-1]]
        ids = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of a tokenizer whose pieces never cross white space, word by word with a bounded cache.

    A word is encoded by the library's model; where the tokenizer has steps that
    this class doesn't know, or a word has characters beyond PLAIN, the library
    encodes the whole word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        steps = json.loads(self.library.to_str())
        split = next((x for x in (steps.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        names = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])]
        levels = [x["type"] for x in (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if not (split and names == ["NFC", "Replace", "Lowercase"] and levels == ["Split", "ByteLevel"] and split["behavior"] == "Removed" and split["invert"]):
            raise ValueError("the tokenizer must lower its text, drop white space and then work on bytes of words")
        self.added = [x["content"] for x in steps["added_tokens"]]
        self.heads = sorted({x[:2].encode() for x in self.added})
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.tokenize = self.library.model.tokenize
        self.ends = {b: self._letters(bytes([b])) for b in b".,"}
        self.words = _Cache(self._word, self.ends)

    def _letters(self, piece: bytes) -> bytes:
        if not piece.isascii():
            return array("I", [t.id for t in self.tokenize(piece.decode("latin-1").translate(self.letters))]).tobytes()
        return array("I", [t.id for t in self.tokenize(piece.decode())]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self._letters(word.lower())
        text = word.decode()
        if PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return b"".join([self._letters(p.encode()) for p in self.pattern.findall(text.lower())])
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(h in text for h in self.heads):  # else upper-case letters may tell a word from an added token
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """One for each Python worker: its tasks share the bounded cache."""
    return held(("tokens", path), lambda: WordEncoder(path))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before, end = encoder(path), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            ids = [encode(t) + end for t in as_bytes(b["text"])]
            counts = [len(x) // 4 for x in ids]
            starts = list(accumulate(counts, initial=before))
            before = starts.pop()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), b["doc_id"], pa.array(counts, pa.int64()), int_lists(ids)], ["part", "local_start", "doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text: str = "text", key: str = "doc_id") -> None:
    """Write the ids of every whole text to ORC files in ascending order of key.

    A null text is empty and has the end id alone. Null keys come first; rows
    that share a key follow each other by a hash of their text, so a hot key is
    dealt over several files. An empty table writes an empty folder of files.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    encoded = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encode(tokenizer, end_id), STAGED)
    encoded.write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; start counts all ids before the row.

    What is gathered on the driver is one row for each file.
    """
    rows = spark.read.schema(STAGED).orc(path)
    sums = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    offsets = list(zip((p for p, _ in sums), accumulate((n for _, n in sums), initial=0), strict=False))
    before = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_tokens(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter reaches the files' indexes and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        ids = b["ids"]
        at = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(), "<u4")
        crc = [zlib.crc32(values[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write documents' ids, read the files back, and digest what they hold: (doc_id, start, n_tokens, ids_crc32).

    One row for each row of docs: null and empty texts have the end id alone,
    very long ones are encoded whole, and rows that repeat or share an id follow
    each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
