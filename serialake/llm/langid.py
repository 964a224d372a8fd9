"""Language identification, word first with backoff to character n-grams.

A known word costs -log10 of its relative frequency in each language (a fixed penalty where a language lacks it). An unseen word
falls back to the longest character n-grams of `` word `` that any language knows: the mean cost of its 4-grams, else of its
3-grams, 2-grams, single letters. A text's cost is the mean over its words, the cheapest language wins.

The model is fitted on a bounded sample: about ``PER_LANGUAGE`` labelled texts per language, chosen by a hash of id and text, whole
texts. Frequencies are sums in Spark; the driver gets one row per (word, language) of the sample.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialake.llm.common import col, slices

PER_LANGUAGE = 2000
LONGEST = 4
PENALTY = 7.0
LEAST_COUNT = 2        # a word seen once is left to its n-grams
REMEMBERED = 500_000   # words a task keeps
UNDETERMINED = "und"

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]     # row of ``costs``
    grams: dict[str, int]
    costs: np.ndarray         # (rows, languages)


def held_out(key: Column) -> Column:
    """Rows kept out of fitting: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, *, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id",
        per_language: int = PER_LANGUAGE) -> Model:
    """Word and n-gram costs of each language. Rows without text or language teach nothing; an empty table gives an empty model."""
    rows = labelled.select(col(lang_column).cast("string").alias("lang"), col(text_column).cast("string").alias("text"), col(id_column).alias("id")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {}, np.zeros((0, 0)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(place < F.element_at(share, F.col("lang")))

    def count(batches):
        for batch in slices(batches, "text"):
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in _WORDS.findall(text.lower()):
                    found[lang, word] = found.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return _model(languages, counted.toArrow())


def _model(languages: list[str], counted: pa.Table) -> Model:
    at = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    blank = lambda: np.zeros(len(languages))
    for lang, word, n in zip(*[counted.column(c).to_pylist() for c in ("lang", "word", "n")]):
        i, padded = at[lang], f" {word} "
        words.setdefault(word, blank())[i] += n
        for size in range(1, LONGEST + 1):
            for start in range(len(padded) - size + 1):
                gram = padded[start:start + size]
                if gram != " ":
                    grams.setdefault(gram, blank())[i] += n
    kept = [w for w, c in words.items() if c.sum() >= LEAST_COUNT]
    total = np.maximum(1, sum(words.values(), start=blank()))
    of_size = {size: np.maximum(1, sum((c for g, c in grams.items() if len(g) == size), start=blank())) for size in range(1, LONGEST + 1)}
    counts = np.array([words[w] / total for w in kept] + [c / of_size[len(g)] for g, c in grams.items()]).reshape(-1, len(languages))
    with np.errstate(divide="ignore"):
        costs = np.where(counts > 0, np.minimum(PENALTY, -np.log10(counts)), PENALTY)
    return Model(languages, {w: i for i, w in enumerate(kept)}, {g: len(kept) + i for i, g in enumerate(grams)}, costs)


class _Rows(dict):
    """Word to its row of costs; an unseen word gets the next row and waits for its costs."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.grams, self.next = model.grams, len(model.costs)
        self.flat: list[int] = []
        self.ends: list[int] = []

    def __missing__(self, word: str) -> int:
        padded = f" {word} "
        for size in range(min(LONGEST, len(padded)), 0, -1):
            known = [self.grams[g] for g in (padded[i:i + size] for i in range(len(padded) - size + 1)) if g in self.grams]
            if known:
                self.flat += known
                break
        self.ends.append(len(self.flat))
        row = self[word] = self.next
        self.next += 1
        return row


class Scorer:
    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.remembered = model, remembered
        self._forget()

    def _forget(self) -> None:
        self.rows, self.costs = _Rows(self.model), self.model.costs

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.rows) > len(self.model.words) + self.remembered:
            self._forget()
        row = self.rows.__getitem__
        found = [np.fromiter(map(row, _WORDS.findall(t.lower())), np.int64) if t and any(map(str.isalpha, t)) else () for t in texts]
        if self.rows.ends:
            ends = np.array(self.rows.ends)
            sums = np.concatenate([np.zeros((1, self.costs.shape[1])), np.cumsum(self.costs[self.rows.flat], axis=0)])
            starts = np.concatenate([[0], ends[:-1]])
            n = (ends - starts)[:, None]
            new = np.where(n > 0, (sums[ends] - sums[starts]) / np.maximum(n, 1), PENALTY)
            self.costs = np.concatenate([self.costs, new])
            self.rows.flat, self.rows.ends = [], []
        return [self._best(self.costs[at].mean(axis=0)) if len(at) else (UNDETERMINED, 0.0) for at in found]

    def _best(self, cost: np.ndarray) -> tuple[str, float]:
        best = int(cost.argmin())  # equal costs: the first language in code point order
        return self.model.languages[best], float(1 / np.power(10.0, cost[best] - cost).sum())


def identify(df: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; ``with_language`` keeps all columns instead.

    score is the winner's share when each language's mean word cost is read as a log10 likelihood (0 to 1). A null text, a text without
    letters, and any text under an empty model give ``und`` with score 0. Only the text is read.
    """
    return with_language(df.select(col(id_column).cast("bigint").alias("doc_id"), col(text_column).cast("string").alias("text")), model).select("doc_id", "lang_pred", "score")


def with_language(df: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """``df`` with lang_pred and score; existing columns of these names are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*[col(c) for c in df.columns if c.lower() not in ("lang_pred", "score")])
    names = [*kept.columns, "lang_pred", "score"]

    def run(batches):
        scorer = Scorer(sent.value) if sent.value.languages else None
        for batch in slices(batches, text_column):
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            made = scorer(texts) if scorer else [(UNDETERMINED, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double")
