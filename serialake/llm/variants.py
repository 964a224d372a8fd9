"""Spelling variant grouping: words one edit apart, found by scanning a sorted vocabulary with banded edit-matrix rows.

``vocabulary`` counts the words of a corpus. ``spelling_variants`` sorts them twice in Spark, once as they are and once reversed, and
cuts the order into shards of bounded size (words are distinct, so no key is hot). Two words one edit apart agree on the first half
of the shorter one, or on the rest of it read backwards: the first list finds edits behind the half, the second those before it.

A shard is scanned as the tree its shared prefixes span. All words of a range that share a prefix share the edit-matrix row of that
prefix (three cells, the band of one edit); a branch adds one letter to the row, and a range whose row holds nothing below two is
skipped whole. A word is also sent to the other shards its half reaches, unless the prefix which all words there share is already
more than one edit off. Only one key per shard passes through the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake.llm.common import checkpointed, col, slices

#: Latin-1 bytes: letters A-Z lower-cased, a-z and U+00C0 to U+00FF kept, all else a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
FORWARD, BACKWARD, LAST = "<", ">", "\U0010ffff"
FAR = 9  # a cell outside the matrix or the band


# -- words of a corpus ------------------------------------------------------------------------------------------------

def with_typos(doc_id: object, runs: list[bytes], every: int) -> list[bytes]:
    """``runs`` of one document, where a run whose crc32(``<doc_id>:<run>``) ``every`` divides loses the letter at crc32 % length."""
    state = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    changed = {}
    for run in set(runs):
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), state)
        if h % every == 0:
            changed[run] = run[:h % len(run)] + run[h % len(run) + 1:]
    return [changed.get(run, run) for run in runs] if changed else runs


def vocabulary(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least_length: int = 6, least_count: int = 5,
               typo_every: int = 0) -> DataFrame:
    """word, n: lower-cased letter runs of whole texts with at least ``least_length`` letters and ``least_count`` occurrences.

    ``typo_every`` plants misspellings first (``with_typos``); 0 plants none. Null texts have no words, a null id counts as an empty
    one, repeated rows count again, other columns are not read. Words are counted per slice of a task before the shuffle.
    """
    def count(batches: Iterator) -> Iterator:
        for batch in slices(batches, "text"):
            runs: list[bytes] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = (text or "").encode("latin-1", "replace").translate(LETTERS).split()
                runs += with_typos(key, found, typo_every) if typo_every else found
            counts = [(word.decode("latin-1"), n) for word, n in Counter(runs).items() if len(word) >= least_length]
            words, numbers = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])

    narrow = docs.select(col(id_column).cast("string").alias("doc_id"), col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- one shard --------------------------------------------------------------------------------------------------------

def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in one array, where each begins, and the lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(("".join(words) + "\0").encode("utf-32-le"), np.uint32)
    return codes, np.cumsum(length) - length, length


class SortedList:
    """Distinct words in code-point order with the prefix lengths that neighbours share."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.start, self.length = _codes(words)
        self.shared = np.full(len(words), -1, np.int64)
        same, depth = np.arange(1, len(words)), 0
        while len(same):
            self.shared[same] = depth
            same = same[(self.length[same] > depth) & (self.length[same - 1] > depth)]
            same = same[self.codes[self.start[same] + depth] == self.codes[self.start[same - 1] + depth]]
            depth += 1
        self._order = np.argsort(self.shared, kind="stable")
        self._first = np.searchsorted(self.shared[self._order], np.arange(self.shared.max(initial=0) + 3))

    def _branches(self, depth: int) -> np.ndarray:
        """Positions whose word shares exactly ``depth`` letters with the one before."""
        if depth + 1 >= len(self._first):
            return self._order[:0]
        return self._order[self._first[depth]:self._first[depth + 1]]

    def near(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of words one edit off, among those that share the first ``exact`` letters of the query.

        Works depth by depth on all queries: an item is a query, a range of the list and the row of that range's prefix, of which
        the cells at depth - 1, depth and depth + 1 letters of the query matter.
        """
        codes, start, length = _codes(queries)
        items = [np.zeros(0, np.int64)] * 6
        enter, found = np.argsort(exact, kind="stable"), []
        entry, ranges, depth = 0, {}, int(exact.min(initial=0))
        while entry < len(enter) or len(items[0]):
            fresh = []
            while entry < len(enter) and exact[enter[entry]] == depth:
                query = queries[enter[entry]]
                head = query[:depth]
                if head not in ranges:
                    ranges[head] = bisect_left(self.words, head), bisect_right(self.words, head + LAST)
                if ranges[head][0] < ranges[head][1]:
                    fresh.append((enter[entry], *ranges[head], 1 if depth else FAR, 0, 1 if len(query) > depth else FAR))
                entry += 1
            if fresh:
                items = [np.concatenate([old, np.array(new, np.int64)]) for old, new in zip(items, zip(*fresh))]
            query, low, high, left, middle, right = items
            over = length[query] - depth  # letters of the query beyond the prefix
            ends = self.length[low] == depth
            cell = np.where(over == -1, left, np.where(over == 0, middle, np.where(over == 1, right, FAR)))
            hit = ends & (cell == 1)
            found.append((query[hit], low[hit]))
            low = low + ends
            open_ = low < high
            query, low, high, left, middle, right = (a[open_] for a in (query, low, high, left, middle, right))
            at = self._branches(depth)
            first, last = np.searchsorted(at, low, "right"), np.searchsorted(at, high, "left")
            children = last - first + 1
            item = np.repeat(np.arange(len(query)), children)
            rank = np.arange(len(item)) - np.repeat(np.cumsum(children) - children, children)
            below = np.append(at, 0)
            begin = np.where(rank == 0, low[item], below[first[item] + rank - 1])
            end = np.where(rank == children[item] - 1, high[item], below[np.minimum(first[item] + rank, len(at))])
            letter, q = self.codes[self.start[begin] + depth], query[item]

            def cost(place: int) -> np.ndarray:
                inside = (place >= 0) & (place < length[q])
                return np.where(inside, codes[np.where(inside, start[q] + place, 0)] != letter, FAR)

            left, middle, right = left[item], middle[item], right[item]
            row_left = np.minimum(left + cost(depth - 1), middle + 1)
            row_middle = np.minimum(np.minimum(middle + cost(depth), right + 1), row_left + 1)
            row_middle = np.where(length[q] > depth, row_middle, FAR)
            row_right = np.where(length[q] > depth + 1, np.minimum(right + cost(depth + 1), row_middle + 1), FAR)
            keep = np.minimum(np.minimum(row_left, row_middle), row_right) <= 1
            items = [a[keep] for a in (q, begin, end, row_left, row_middle, row_right)]
            depth += 1
            ranges = {}
        if not found:
            return items[0], items[0]
        return np.concatenate([q for q, _ in found]), np.concatenate([p for _, p in found])


def half(key: str) -> int:
    """Letters of a list key (direction, then the word or its reverse) that a partner on the same list must share."""
    size = len(key) - 2  # the shorter word of a pair may have one letter less
    return 1 + (size // 2 if key[0] == FORWARD else size - size // 2)


def word_of(key: str) -> str:
    return key[1:] if key[0] == FORWARD else key[:0:-1]


def _reports(one: str, other: str) -> bool:
    """Whether the list of these keys is the one to report the pair, so that no pair comes from both lists."""
    forward = one[0] == FORWARD
    one, other = word_of(one), word_of(other)
    middle = min(len(one), len(other)) // 2
    return (one[:middle] == other[:middle]) == forward


def reaches(shared: str, key: str) -> bool:
    """Whether ``shared`` can be a prefix of a word within one edit of ``key``."""
    at = len(commonprefix((shared, key)))
    if at == len(shared):
        return True
    rest = shared[at + 1:]
    return key.startswith(rest, at + 1) or key.startswith(rest, at) or key.startswith(shared[at:], at + 1)


# -- operator ---------------------------------------------------------------------------------------------------------

def near_words(words: DataFrame, *, shard_words: int = 50_000, block: int = 20_000) -> DataFrame:
    """word, n_near, form_n, near: for words with neighbours, how many are one edit off and the most frequent one (ties: smallest).

    ``words`` is a checkpointed table of distinct non-null words with counts ``n``. ``shard_words`` bounds what a task holds and
    ``block`` how many words it looks up at once; neither changes the result.
    """
    keyed = words.select("n", F.explode(F.array(F.concat(F.lit(FORWARD), "word"), F.concat(F.lit(BACKWARD), F.reverse("word")))).alias("key"))
    shards = max(1, -(-2 * words.count() // shard_words))
    lists = checkpointed(keyed.repartitionByRange(shards, "key").select(F.spark_partition_id().alias("shard"), "key", "n"))
    bounds = sorted((r.low, r.high, r.shard) for r in lists.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())
    lows, highs, numbers = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]
    shared = [commonprefix(b[:2]) for b in bounds]

    def route(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for own, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((own, 0, key, n))
                head = key[:half(key)]
                for i in range(bisect_left(highs, head), bisect_right(lows, head + LAST)):
                    if numbers[i] != own and reaches(shared[i], key):
                        rows.append((numbers[i], 1, key, n))
            made = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], ["shard", "guest", "key", "n"])

    def search(batches: Iterator) -> Iterator:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, members in groupby(rows, key=lambda row: row[0]):
            keys: list[str] = []
            counts: list[int] = []
            guests: list[str] = []
            held = None
            for _, guest, key, n in members:
                if not guest:
                    keys.append(key)
                    counts.append(n)
                    continue
                held = held or SortedList(keys)
                guests.append(key)
                if len(guests) == block:
                    yield best(held, counts, guests)
                    guests = []
            held = held or SortedList(keys)
            for at in range(0, len(keys), block):
                yield best(held, counts, keys[at:at + block])
            yield best(held, counts, guests)

    def best(held: SortedList, counts: list[int], keys: list[str]) -> pa.RecordBatch:
        number: Counter = Counter()
        first: dict[int, tuple[int, str]] = {}
        who, where = held.near(keys, np.fromiter(map(half, keys), np.int64, len(keys)))
        for q, p in zip(who.tolist(), where.tolist()):
            if _reports(keys[q], held.words[p]):
                number[q] += 1
                this = -counts[p], word_of(held.words[p])
                first[q] = min(first.get(q, this), this)
        made = [(word_of(keys[q]), k, -first[q][0], first[q][1]) for q, k in number.items()]
        columns = list(zip(*made)) if made else [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["word", "n_near", "near_n", "near"])

    dealt = lists.mapInArrow(route, "shard int, guest int, key string, n bigint").repartition(shards, "shard").sortWithinPartitions("shard", "guest", "key")
    hits = dealt.mapInArrow(search, "word string, n_near bigint, near_n bigint, near string")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")) \
        .select("word", "n_near", (-F.col("first.less")).alias("form_n"), F.col("first.near").alias("near"))


def spelling_variants(words: DataFrame, *, ratio: int = 5, shard_words: int = 50_000) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of words and counts (``word``, ``n``).

    form: the most frequent word one edit off (ties: smallest), if its count is at least ``ratio`` times the word's own, else null,
    as is form_n. root: where following forms ends, the word itself without one; counts rise along a chain, so it has an end. Null
    words are left out, repeated words are added up, an empty table gives an empty result. Pointer doubling finds the roots; a chain
    has at most log(largest count) / log(ratio) links, so few rounds are needed.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: counts have to rise along a chain")
    known = checkpointed(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    joined = known.join(near_words(known, shard_words=shard_words), "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    formed = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                        F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = checkpointed(links.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
