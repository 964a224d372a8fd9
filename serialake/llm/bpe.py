"""Byte-level BPE by merge replay over a corpus of words, and decoding.

The texts of a slice are split by the tokenizer's pattern and their distinct new words are laid out in one array of byte ids with
links to the neighbours. An inverted index maps each possible merge (its rank) to the word positions where it applies. Ranks are
taken in order; a merge rewrites all its positions, leftmost first, and only the two touched neighbour pairs enter the index
anew. Each distinct word is merged once, then every text's ids are gathered from the words'.

Spark deals the texts; a task holds one slice of texts and a bounded memory of words it has met. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from serialake.llm.common import col, slices

REMEMBERED = 200_000  # words a task keeps between slices; then it starts anew
SLICE = 3_000_000     # bytes of text encoded at once
_NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """Merge replay over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    def rank(self, left: int, right: int) -> int:
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = self.ranks.get(self.tokens[left] + self.tokens[right], _NONE)
        return found

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int] | None] = []
        ids: list[int] = []       # id at a position, the merged one at its first position
        after: list[int] = []     # next live position of the same word
        before: list[int] = []
        spans: list[tuple[int, int, int]] = []
        where: dict[int, list[int]] = {}
        rank, single = self.rank, self.single
        for number, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out.append([whole])
                continue
            out.append(None)
            start, n = len(ids), len(word)
            spans.append((number, start, start + n))
            ids += [single[b] for b in word]
            before += range(start - 1, start + n - 1)
            after += range(start + 1, start + n + 1)
            before[start] = _NONE
            after[-1] = _NONE
            for at in range(start, start + n - 1):
                r = rank(ids[at], ids[at + 1])
                if r >= 0:
                    where.setdefault(r, []).append(at)
        order = sorted(where)
        while order:
            merged = heappop(order)
            places = where.pop(merged, None)
            if not places:
                continue
            places.sort()
            waits = _NONE  # last position of a word whose next merge has a lower rank
            for at in places:
                right = after[at]
                if right < 0 or ids[at] < 0 or rank(ids[at], ids[right]) != merged:
                    continue
                if at <= waits:
                    if merged not in where:
                        where[merged] = []
                        heappush(order, merged)
                    where[merged].append(at)
                    continue
                ids[at], ids[right] = merged, _NONE
                beyond = after[at] = after[right]
                if beyond >= 0:
                    before[beyond] = at
                    r = rank(merged, ids[beyond])
                    if r >= 0:
                        if r not in where:
                            where[r] = []
                            heappush(order, r)
                        where[r].append(at)
                        if r < merged:
                            waits = self._end(after, at)
                behind = before[at]
                if behind >= 0:
                    r = rank(ids[behind], merged)
                    if r >= 0:
                        if r not in where:
                            where[r] = []
                            heappush(order, r)
                        where[r].append(behind)
                        if r < merged:
                            waits = self._end(after, at)
        for number, start, end in spans:
            out[number] = [i for i in ids[start:end] if i >= 0]
        return out

    @staticmethod
    def _end(after: list[int], at: int) -> int:
        while after[at] >= 0:
            at = after[at]
        return at


class _Words(dict):
    """Word to its number; a new word gets the next number and waits for its ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Ids of texts; remembers words from call to call."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.merges, self.find, self.remembered = Merges(ranks), regex.compile(pattern).findall, remembered
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_length, self.token_start = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.merges.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.words, self.length, self.start, self.ids = _Words(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.merges.pairs.clear()

    @staticmethod
    def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        ends = np.cumsum(length)
        return values[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > self.remembered:
            self._forget()
        number = self.words.__getitem__
        found = [np.fromiter(map(number, self.find(text or "")), np.int64) for text in texts]
        if self.words.new:
            made = self.merges.encode([w.encode("utf-8") for w in self.words.new])
            self.words.new = []
            length = np.fromiter(map(len, made), np.int64, len(made))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, np.fromiter((i for ids in made for i in ids), np.uint32, int(length.sum()))])
        return [self._gather(self.ids, self.start[at], self.length[at]) for at in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return self._gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()


def encode_texts(df: DataFrame, *, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
                 with_ids: bool = True, with_digests: bool = True) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids (array<int>), ids_sha256 and decoded_sha256 of every whole text.

    Ids are those of ordinary text: no special tokens. ids_sha256 covers the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 the bytes decoded from the ids. A null text is empty: no ids, digests of nothing. One row per input row,
    repeated rows and null ids included; other columns are not read. The rank file is read on the driver (about a megabyte) and
    broadcast, so executors need no such file.
    """
    sent = df.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    def run(batches):
        encoder = Encoder(*sent.value)
        for batch in slices(batches, "text", SLICE):
            ids = encoder.encode(batch.column(1).to_pylist())
            names, made = ["doc_id", "n_tokens"], [batch.column(0), pa.array([len(i) for i in ids], pa.int64())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                names.append("ids")
                made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())))
            if with_digests:
                names += ["ids_sha256", "decoded_sha256"]
                made.append(pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()))
                made.append(pa.array([hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(made, names)

    schema = "doc_id bigint, n_tokens bigint" + (", ids array<int>" if with_ids else "") + (", ids_sha256 string, decoded_sha256 string" if with_digests else "")
    return df.select(col(id_column).cast("bigint").alias("doc_id"), col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, *, ranks_path: str, pattern: str = "", id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; bytes that are no UTF-8 become U+FFFD, null ids give a null text."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        encoder = Encoder(sent.value, pattern)
        for batch in slices(batches, "ids"):
            texts = [None if i is None else encoder.decode(np.asarray(i, np.int64)).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(col(id_column).cast("bigint").alias("doc_id"), col(ids_column).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
