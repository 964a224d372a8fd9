"""Periodic run detection: maximal repetitions among the words of a text, by the grouping phase of Baier's suffix sorter.

That phase never sorts suffixes: it splits groups of positions until each group holds the positions with one and the same Lyndon
prefix, so group lengths are the Lyndon array. Done for the order of the words and for its reverse, every run has a Lyndon root that
starts such a prefix in one of the two. Where a run holds three periods, two neighbouring roots of it lie in one group; comparing
the text with itself one period on (longest common extension, to both sides) gives the run's ends.

Before that a slice of texts is reduced, exactly, to stretches that can hold a run: of a run with at least ``least`` words and
``times`` periods every window of ``window(least, times)`` words occurs twice in it, so text whose windows occur once is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from serialake.llm.common import col, slices

Run = tuple[int, int, int]  # start, length, period


def lyndon_groups(words: list[int]) -> tuple[list[int], list[int]]:
    """(length of the longest Lyndon prefix of each suffix, number of its group): equal numbers mean equal prefixes.

    Groups are taken from the highest prefix down. Each position of a group is counted at the nearest position before it that lies
    in a lower group; there the group's prefix follows the own one as often as it was counted, so the position moves to a new group
    just above its old one, a higher count higher.
    """
    size, letters = len(words), sorted(set(words))
    rank = {letter: i for i, letter in enumerate(letters)}
    group = [rank[w] for w in words]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    length, below, above = [1] * len(letters), list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    done, before = [False] * size, list(range(-1, size - 1))
    top = len(letters) - 1
    while top >= 0:
        own = [i for i in members[top] if group[i] == top]
        members[top] = []
        for i in own:
            done[i] = True
        counted: dict[int, int] = {}
        for i in own:
            j = before[i]
            if j >= 0 and done[j]:
                path = [i]
                while j >= 0 and done[j]:
                    path.append(j)
                    j = before[j]
                for k in path:
                    before[k] = j
            if j >= 0:
                counted[j] = counted.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in counted.items():
            moves.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moves, reverse=True):
            new, next_up = len(length), above[old]
            length.append(length[old] + times * length[top])
            members.append(moves[times, old])
            for j in moves[times, old]:
                group[j] = new
            below.append(old)
            above.append(next_up)
            above[old] = below[next_up] = new
        top = below[top]
    return [length[g] for g in group], group


def _equal_ahead(a: np.ndarray, one: int, two: int) -> int:
    """Longest common extension of two positions to the right."""
    total, step = 0, 32
    while two + total < len(a):
        step = min(2 * step, len(a) - two - total)
        differ = np.flatnonzero(a[one + total:one + total + step] != a[two + total:two + total + step])
        if len(differ):
            return total + int(differ[0])
        total += step
    return total


def _equal_behind(a: np.ndarray, one: int, two: int) -> int:
    """Longest common extension of two positions to the left, themselves left out."""
    total, step = 0, 32
    while one - total > 0:
        step = min(2 * step, one - total)
        differ = np.flatnonzero(a[one - total - step:one - total] != a[two - total - step:two - total])
        if len(differ):
            return total + step - 1 - int(differ[-1])
        total += step
    return total


def runs_of(words: np.ndarray, *, least: int, times: int) -> list[Run]:
    """Maximal runs (start, length, smallest period) with length >= max(least, times * period), in order; ``times`` is 2 or more."""
    found: set[Run] = set()
    size = len(words)
    for ordered in (words.tolist(), (-words).tolist()):
        length, group = lyndon_groups(ordered)
        last: dict[int, tuple[int, int]] = {}
        for i, period in enumerate(length):
            beyond = i + period
            if beyond >= size or times > 2 and group[beyond] != group[i]:
                continue
            start, end = last.get(period, (0, 0))
            if start <= i and beyond <= end:
                continue
            start, end = i - _equal_behind(words, i, beyond), beyond + _equal_ahead(words, i, beyond)
            if end - start >= 2 * period:
                last[period] = start, end
                if end - start >= max(least, times * period):
                    found.add((start, end - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def window(least: int, times: int) -> int:
    """Most words of a window that must occur twice inside any run of the asked length."""
    turn = least // times
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in (max(1, turn), turn + 1)))


def stretches(words: np.ndarray, text: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(start, end) of the longest pieces of the joined texts in which every window of ``width`` words occurs twice in its text."""
    count = len(words) - width + 1
    if count < 2:
        return []
    hashes = text[:count].astype(np.uint64)
    for k in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[k:k + count].astype(np.uint64)
        hashes ^= hashes >> np.uint64(29)
    whole = np.flatnonzero(text[:count] == text[width - 1:])
    order = whole[np.argsort(hashes[whole])]
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(count + 2, bool)
    twice[order[1:][same] + 1] = True
    twice[order[:-1][same] + 1] = True
    edge = np.diff(twice.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # windows of two texts that touch cannot both be whole, so no piece crosses a border unless the width is one
    pieces = []
    for b, e in zip(begin.tolist(), (end + width - 1).tolist()):
        while text[b] != text[e - 1]:
            middle = int(np.searchsorted(text[b:e], text[b], "right")) + b
            pieces.append((b, middle))
            b = middle
        pieces.append((b, e))
    return pieces


def runs_of_texts(texts: list[list[bytes]], *, least: int, times: int) -> list[list[Run]]:
    """``runs_of`` for the words of several texts, worked out only where a run can be."""
    number: dict[bytes, int] = {}
    found: list[list[Run]] = [[] for _ in texts]
    sizes = [len(words) for words in texts]
    ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64, sum(sizes))
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum([0, *sizes])
    for begin, end in stretches(ids, text, window(least, times)):
        if end - begin >= least:
            which = int(text[begin])
            shift = begin - int(first[which])
            found[which] += [(start + shift, length, period) for start, length, period in runs_of(ids[begin:end], least=least, times=times)]
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in found]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words left when every run keeps its first period only."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def plant_period(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document; of one in ten, chosen by the crc32 of its id, a tail is made periodic (a null id: none)."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, size = h // 10, len(words)
    a = g % size
    p = 1 + (size - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(size - a) // p)))[:size - a]


def periodic_runs(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: int = 24, times: int = 3,
                  prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), strongest, collapsed: one row per row of ``docs``.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch with smallest period q and at least
    max(``least``, ``times`` * q) words that no neighbour extends. strongest: the run with the greatest length / period (ties:
    smallest start, then period), null without runs. collapsed: the words outside the repeats of all runs, joined by one blank. A null
    text has no words; other columns are not read; ids may repeat or be null. ``prepare`` may change the words of a document first.
    Row by row, without a shuffle: a task holds one slice of texts, or one text that is longer.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")

    def find(batches: Iterator) -> Iterator:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in slices(batches, "text", 4_000_000):
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            if prepare:
                texts = [prepare(key, words) for key, words in zip(batch.column(0).to_pylist(), texts)]
            found = runs_of_texts(texts, least=least, times=times)
            named = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
            best = [min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None) for runs in named]
            kept = [b" ".join(collapse(words, runs)).decode() for words, runs in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.string())],
                                             ["doc_id", "runs", "strongest", "collapsed"])

    shape = "struct<start: bigint, length: bigint, period: bigint>"
    narrow = docs.select(col(id_column).cast("bigint").alias("doc_id"), col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(find, f"doc_id bigint, runs array<{shape}>, strongest {shape}, collapsed string")
