"""SentencePiece encoding and decoding by a streaming Viterbi search.

Boundaries are worked through one after another: from each that a path reaches,
pieces go at most the longest piece's length ahead. Only the boundaries between
the last committed one and the furthest one reached are held, with the best
path's last piece and score. Ids are committed up to the boundary at which the
backpointer paths of all survivors meet: at once where no piece goes over a
boundary, else by stepping back. A text is never held as one lattice.

A unigram model takes the path with the largest sum of scores. For a BPE model
that would be another segmentation than the model's own, so there the search
runs over paths that BPE could have made: each piece must be what BPE makes of
its own characters, and each pair of neighbours what BPE makes of theirs. Such a
path exists and is unique for every prefix, so its ids are those of the
sentencepiece library.

No piece crosses from a character into a following blank, or over a line feed,
so all paths meet there; words between such boundaries are cached, boundedly.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerweave.llm.arrow import as_bytes, held, int_lists, sliced

BLANK = "▁"
#: Entries of a task's caches of words and of pairs; longer words aren't kept.
CACHE, PAIRS, LONGEST_KEPT = 800_000, 1_000_000, 64
#: Characters between looks for a boundary where all paths meet, while pieces stay open.
LOOK = 64
UNIGRAM, BPE = 1, 2


class Vocabulary:
    """Pieces of a model: ids, scores, a trie over characters, and bytes for decoding."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (1, 4)}
        self.scores = [s for _, s, _ in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == 2), 0)
        #: What a character costs that is no piece.
        self.unlikely = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.longest = max(map(len, self.ids), default=1)
        #: A node is its piece's id (-1: none) and the nodes below by character.
        self.trie: list = [-1, {}]
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        #: Neighbouring characters within pieces; between any others all paths meet.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.bytes = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else p.replace(BLANK, " ").encode() for p, _, t in pieces]
        self.splits = all(BLANK not in p.lstrip(BLANK) and "\n" not in p for p in self.ids)
        self.names = [p for p, _, _ in pieces]

    def forget(self, ids: set[int]) -> None:
        """Take pieces out of the trie: those that BPE never makes."""
        for i in ids:
            node = self.trie
            for c in self.names[i]:
                node = node[1][c]
            node[0] = -1

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models that leave texts as they are")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, spec.add_dummy_prefix)


class _Words(dict):
    """Ids of words, boundedly many. A last character that no piece joins to the one before has ids of its own."""

    def __init__(self, make: Callable[[str], bytes], joined: set[str]):
        super().__init__()
        self.make, self.joined = make, joined

    def __missing__(self, word: str) -> bytes:
        if len(word) > 2 and word[-1] in ".," and word[-2] != " " and word[-2:] not in self.joined:
            return self[word[:-1]] + self[word[-1]]
        ids = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class StreamingEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words = _Words(self.chunk, vocabulary.joined)
        self.pairs: dict[int, bool] = {}
        if vocabulary.kind == BPE:
            vocabulary.forget({i for p, i in vocabulary.ids.items() if self.merge(p) != [i]})
        self.pattern = re.compile(r" *[^ \n]+| +|\n+")
        self.most_held = 0  # boundaries that waited for a common one, at most

    def merge(self, text: str) -> list[int]:
        """What BPE makes of a short text, merge by merge: the best score first, then the leftmost."""
        ids, scores, parts = self.v.ids, self.v.scores, list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                return [ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merge(self.v.names[left] + self.v.names[right]) == [left, right]
        return known

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a run of characters (blanks already marked), as soon as they are certain."""
        v, bpe, pairs, root = self.v, self.v.kind == BPE, self.pairs, self.v.trie[1]
        scores, longest, end = v.scores, v.longest, len(text)
        at = done = reach = 0  # the boundary that paths go on from, the last one committed to, the furthest one reached
        # By boundary from `done` on: the last piece of the best path (-1: none, or a character's bytes), its beginning, its score.
        piece, back, score = {0: -1}, {0: 0}, {0: 0.0}

        def path(to: int) -> list[int]:
            out = []
            while to > done:
                i, begin = piece[to], back[to]
                out += [i] if i >= 0 else self.unknown(text[begin:to])[::-1]
                to = begin
            return out[::-1]

        while at < end:
            if at == reach and at > done:  # no piece goes over this boundary: all paths meet here
                yield from path(at)
                done, piece, back, score = at, {at: piece[at]}, {at: at}, {at: 0.0}
            elif at - done > LOOK and at % LOOK == 0:
                meet = {b for b in piece if b >= at}
                while len(meet) > 1:  # the furthest survivor steps back until all are one
                    b = max(meet)
                    meet.discard(b)
                    meet.add(back[b])
                to = meet.pop()
                if to > done:
                    yield from path(to)
                    done = to
                    piece, back, score = ({b: x for b, x in own.items() if b >= to} for own in (piece, back, score))
                self.most_held = max(self.most_held, reach - done)
            before = piece.get(at)
            if before is None:
                at += 1
                continue
            below, to = root, at
            for c in text[at : at + longest]:
                node = below.get(c)
                if node is None:
                    break
                to += 1
                i, below = node
                if i < 0:
                    continue
                if bpe:
                    if to not in piece and (before < 0 or (self.stands(before, i) if (known := pairs.get(before << 32 | i)) is None else known)):
                        piece[to], back[to] = i, at
                        if to > reach:
                            reach = to
                else:
                    total = score[at] + scores[i]
                    if to not in piece or total > score[to]:
                        piece[to], back[to], score[to] = i, at, total
                        reach = max(reach, to)
            if at + 1 not in piece and (reach == at or not bpe and (text[at] not in root or root[text[at]][0] < 0)):
                piece[at + 1], back[at + 1], score[at + 1] = -1, at, score.get(at, 0.0) + v.unlikely
                reach = max(reach, at + 1)
            at += 1
        yield from path(end)

    def unknown(self, char: str) -> list[int]:
        return [self.v.byte_ids[x] for x in char.encode()] if self.v.byte_ids else [self.v.unknown]

    def within_window(self, text: str) -> list[int]:
        """The same search for a BPE word so short that it is committed at its end."""
        root, longest, pairs, end = self.v.trie[1], self.v.longest, self.pairs, len(text)
        piece: list[int | None] = [None] * (end + 1)
        back, reach, piece[0] = [0] * (end + 1), 0, -1
        for at in range(end):
            before = piece[at]
            if before is None:
                continue
            below, to = root, at
            for c in text[at : at + longest]:
                node = below.get(c)
                if node is None:
                    break
                to += 1
                i, below = node
                if i >= 0 and piece[to] is None and (before < 0 or (self.stands(before, i) if (known := pairs.get(before << 32 | i)) is None else known)):
                    piece[to], back[to] = i, at
                    if to > reach:
                        reach = to
            if reach == at:
                piece[at + 1], back[at + 1], reach = -1, at, at + 1
        out: list[int] = []
        while end:
            i, begin = piece[end], back[end]
            out += [i] if i >= 0 else self.unknown(text[begin:end])[::-1]
            end = begin
        out.reverse()
        return out

    def chunk(self, text: str) -> bytes:
        text = text.replace(" ", BLANK)
        return array("I", self.within_window(text) if self.v.kind == BPE and len(text) <= LOOK else self.stream(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; an empty text has none."""
        if not text:
            return b""
        text = (" " if self.v.dummy_prefix else "") + text.replace(BLANK, " ")
        if not self.v.splits:
            return self.chunk(text)
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.v.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


def coder_of(model: str) -> StreamingEncoder:
    """One for each Python worker: its tasks share the bounded caches."""
    return held(("pieces", model), lambda: StreamingEncoder(Vocabulary.load(model)))


def encode_documents(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, decoded_sha256, round_trip), one row for each row of docs.

    Whole texts are encoded, and their ids decoded again: round_trip tells
    whether that gave the text back, but for U+2581, which the model reads as a
    blank. A null text is empty and has no ids; a very long one is encoded whole
    within the window. Rows that repeat have rows of their own; an empty table
    gives an empty result; other columns play no part. ids_crc32 is over little-endian unsigned
    32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        for b in sliced(batches, 1024):
            raw = as_bytes(b["text"])
            texts = [x.decode() for x in raw]
            ids = [coder.encode(x) for x in texts]
            back = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"], int_lists(ids), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y.replace(BLANK, " ") for x, y in zip(back, texts, strict=True)]),
                ],
                ["doc_id", "ids", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
