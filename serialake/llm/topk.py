"""Exact top-k search by distributed histogram selection.

Every query scores every candidate, block by block: a wave of at most about ``WAVE`` queries (a bounded broadcast) meets each
batch of candidates in one matrix product. Scores are integers, so each query has an interval that must hold its k-th value; a
round counts the scores in equal bins of that interval over all candidates and the interval shrinks to the bin of the k-th,
until it holds one value. Then one filter keeps what lies above, ties at the value are broken by the smaller id.

A task reports only the bins at or above its own k-th best score: at most k counts reach the shuffle per query and task.
Scores are exact: products run in double precision while every partial sum is below 2^53, in 64-bit integers up to 2^63,
and larger ones raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from serialake.llm.common import col

WAVE = 2048   # queries in one broadcast (about 1 MB at 64 components)
BINS = 2048
UNIT = 1024   # a component x counts as floor(1024 * x)


def _valid(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) per vector length; vectors that are null, empty or hold null or non-finite values are left out."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten()
    values = np.asarray(flat.fill_null(float("nan")), dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        if size == 0:
            continue
        matrix = values[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        whole = np.floor(matrix[fine] * UNIT)
        if np.abs(whole).max(initial=0) >= 2.0 ** 62:
            raise ValueError("vector components too large for 64-bit scores")
        yield rows[fine], whole.astype(np.int64)


def _candidates(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            piece = batch.slice(start, step)
            ids = piece.column(0)
            known = np.asarray(ids.is_valid())
            numbers = np.asarray(ids.fill_null(0), dtype=np.int64)
            for rows, matrix in _valid(piece.column(1)):
                rows_known = known[rows]
                yield numbers[rows[rows_known]], matrix[rows_known]


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    if not candidates.size or not queries.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    bound = np.abs(queries).sum(axis=1, dtype=np.float64).max() * float(np.abs(candidates).max())
    if bound < 2.0 ** 53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if bound >= 2.0 ** 63:
        raise ValueError("scores exceed 64 bits")
    return queries @ candidates.T


class Block:
    """Queries of one vector length: ids, integer vectors, and of each the interval [low, high) of its k-th score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.low = self.high = self.above = None

    def span(self, largest_norm: float) -> None:
        reach = np.ceil(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)) * largest_norm).astype(np.int64) + 1
        self.low, self.high, self.above = -reach, reach + 1, np.zeros(len(self.ids), np.int64)

    def width(self) -> np.ndarray:
        return np.maximum(1, -(-(self.high - self.low) // BINS))

    def step(self) -> int:
        return max(64, 2_000_000 // max(1, len(self.ids)))  # candidates scored at once: 16 MB of scores

    def count(self, counts: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Add the scores of these candidates to ``counts`` (query, bin)."""
        if matrix.shape[1] != self.vectors.shape[1]:
            return
        width = self.width()[:, None]
        scores = _scores(self.vectors, matrix)
        inside = (scores >= self.low[:, None]) & (scores < self.high[:, None]) & (ids[None, :] != self.ids[:, None])
        bins = (scores - self.low[:, None]) // width + np.arange(len(self.ids))[:, None] * BINS
        counts += np.bincount(bins[inside], minlength=counts.size).reshape(counts.shape)

    def useful(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, bin, count) without bins that cannot hold the k-th score."""
        better = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # in the bins above
        q, b = np.nonzero((counts > 0) & (better < (self.k - self.above)[:, None]))
        return q, b, counts[q, b]

    def refine(self, rows: dict[tuple[int, int], int]) -> None:
        width = self.width()
        by: dict[int, list[tuple[int, int]]] = {}
        for (q, b), n in rows.items():
            by.setdefault(q, []).append((b, n))
        for q in range(len(self.ids)):
            if self.high[q] - self.low[q] <= 1:
                continue
            seen = self.above[q]
            for b, n in sorted(by.get(q, ()), reverse=True):
                if seen + n >= self.k:
                    low = self.low[q] + b * width[q]
                    self.low[q], self.high[q], self.above[q] = low, min(self.high[q], low + width[q]), seen
                    break
                seen += n
            else:  # fewer than k candidates: all of them
                self.low[q], self.high[q], self.above[q] = np.iinfo(np.int64).min, np.iinfo(np.int64).min + 1, seen

    def done(self) -> bool:
        return bool((self.high - self.low <= 1).all())

    def chosen(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, candidate, score) at or above the k-th score, of equal scores only this batch's k smallest ids."""
        for ids, matrix in parts:
            if matrix.shape[1] != self.vectors.shape[1]:
                continue
            scores = _scores(self.vectors, matrix)
            q, c = np.nonzero((scores >= self.low[:, None]) & (ids[None, :] != self.ids[:, None]))
            value = scores[q, c]
            order = np.lexsort((ids[c], -value, q))
            q, c, value = q[order], c[order], value[order]
            first = np.searchsorted(q, q)
            kept = np.arange(len(q)) - first < self.k
            yield self.ids[q[kept]], ids[c[kept]], value[kept]


def top_k(df: DataFrame, queries: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10,
          wave: int = WAVE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best rows of ``df`` other than its own (all, if fewer).

    The score is the inner product of the integer vectors; ties go to the smaller id, equal rows repeated keep their repeats.
    A row with the query's id is its own. Vectors null, empty, or holding null or non-finite components take no part, nor rows
    without an id, nor candidates of another length than the query's. A query id given twice counts once, with its smallest
    vector. Empty tables give an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(col(id_column).cast("bigint").alias("vec_id"), col(vector_column).cast("array<double>").alias("v"))
    asked = (queries.select(col(id_column).cast("bigint").alias("q"), col(vector_column).cast("array<double>").alias("v"))
             .where("q is not null and v is not null")
             .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).groupBy("q").agg(F.min("v").alias("v")))

    def norms(batches):
        best: dict[int, float] = {}
        for _, m in _candidates(batches, 1 << 16):
            if len(m):
                best[m.shape[1]] = max(best.get(m.shape[1], 0.0), float((m.astype(np.float64) ** 2).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], ["size", "square"])

    largest = {r["size"]: r["square"] ** 0.5 for r in
               rows.mapInArrow(norms, "size int, square double").groupBy("size").agg(F.max("square").alias("square")).collect()}
    waves = -(-asked.count() // wave)
    found = None
    for number in range(waves):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(waves)) == number).toArrow()
        blocks = []
        ids = np.asarray(part.column("q").combine_chunks(), dtype=np.int64)
        for at, matrix in _valid(part.column("v").combine_chunks()):
            if matrix.shape[1] in largest:
                block = Block(ids[at], matrix, k)
                block.span(largest[matrix.shape[1]])
                blocks.append(block)
        if not blocks:
            continue
        while not all(b.done() for b in blocks):
            sent = spark.sparkContext.broadcast(blocks)

            def count(batches, sent=sent):
                counts = [np.zeros((len(block.ids), BINS), np.int64) for block in sent.value]
                for batch in batches:
                    for block, own in zip(sent.value, counts):
                        for ids, matrix in _candidates(iter([batch]), block.step()):
                            block.count(own, ids, matrix)
                for n, block in enumerate(sent.value):
                    q, b, c = block.useful(counts[n])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), n), pa.int32()), pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], ["block", "q", "bin", "n"])

            counted = rows.mapInArrow(count, "block int, q int, bin int, n bigint").groupBy("block", "q", "bin").agg(F.sum("n").alias("n")).toArrow()
            columns = [counted.column(c).to_pylist() for c in ("block", "q", "bin", "n")]
            per: list[dict] = [{} for _ in blocks]
            for n, q, b, c in zip(*columns):
                per[n][q, b] = c
            for block, values in zip(blocks, per):
                block.refine(values)
            sent.unpersist()
        sent = spark.sparkContext.broadcast(blocks)

        def choose(batches, sent=sent):
            for batch in batches:
                for block in sent.value:
                    for q, c, s in block.chosen(_candidates(iter([batch]), block.step())):
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

        chosen = rows.mapInArrow(choose, "query_id bigint, vec_id bigint, score bigint")
        found = chosen if found is None else found.unionAll(chosen)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
