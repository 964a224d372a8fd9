"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A window is one word between fixed carrier texts (zstandard looks for no match in the last bytes of a block and stores tiny blocks
raw). Its distance is the length it compresses to with the ordinary dictionary less that with the toxic one. A document is described by its largest
distance and by how many of its distinct windows reach each of a few thresholds; a logistic regression on these, fitted on the labelled
sample, calibrates the score.

Toxic documents consist mostly of ordinary words, so the toxic dictionary is trained on the words that toxic documents contain
significantly more often (log-likelihood ratio over document frequencies; near copies of a document, which share the smallest word hash,
count once). Ordinary words that still look toxic are added to the ordinary dictionary in a few rounds.

Fitting uses a bounded sample of labelled rows: about ``TOXIC_SAMPLE`` and ``ORDINARY_SAMPLE`` documents, whole texts, chosen by a hash.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake.llm.common import checkpointed, col, slices, small_side

TOXIC_SAMPLE = 3000
ORDINARY_SAMPLE = 7000
LEAST_RATIO = 22.0          # log-likelihood ratio a toxic word needs
ORDINARY_BYTES = 8192       # trained part of the ordinary dictionary
HARD_BYTES = 4096           # and room for ordinary words that looked toxic
TOXIC_BYTES = 6000
VOCABULARY_SAMPLE = 150_000
THRESHOLDS = (1, 2, 3, 4, 5)
REMEMBERED = 500_000        # words a task keeps
DECISION = 0.7

_WORDS = re.compile(r"[^\W\d_]+")
_AFTER = b"of that order.\n"
_BEFORE = _AFTER + b" a carrier for one word: "


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=13, hash_log=14, search_log=6, min_match=4, target_length=8, strategy=zstandard.STRATEGY_LAZY,
        write_checksum=False, write_content_size=False, write_dict_id=False)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary + _BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=_parameters())
    return zstandard.ZstdCompressor(dict_data=known, compression_params=_parameters())


def _framed(word: str) -> bytes:
    return f" {word} ".encode()


def _trained(words: list[tuple[str, int]], size: int) -> bytes:
    """Dictionary of at most ``size`` bytes from words with their weights; too few samples to train on are taken as they are."""
    samples = [_framed(w) for w, n in words for _ in range(n)]
    order = np.random.default_rng(7).permutation(len(samples))
    samples = [samples[i] for i in order]
    if sum(map(len, samples)) > 8 * size and len(samples) >= 64:
        try:
            return zstandard.train_dictionary(size, samples, d=6, k=32, steps=1, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(_framed(w) for w, _ in words)[:size]


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(THRESHOLDS) + 3))  # of the features, the last of 1


class Distances(dict):
    """Word to its compression distance."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def __missing__(self, word: str) -> int:
        window = _BEFORE + word.encode() + b" " + _AFTER
        found = self[word] = len(self.ordinary(window)) - len(self.toxic(window))
        return found


class Scorer:
    def __init__(self, model: ToxicityModel, remembered: int = REMEMBERED):
        self.model, self.remembered = model, remembered
        self.distances = Distances(model.toxic, model.ordinary)

    def features(self, text: str | None) -> np.ndarray:
        words = set(_WORDS.findall((text or "").lower()))
        out = np.zeros(len(THRESHOLDS) + 3)
        out[-1] = 1.0
        if words and self.model.toxic:
            if len(self.distances) > self.remembered:
                self.distances.clear()
            found = np.fromiter(map(self.distances.__getitem__, words), np.int64, len(words))
            out[0] = max(0, found.max())
            out[1:-2] = np.log1p([(found >= t).sum() for t in THRESHOLDS])
            out[-2] = np.log1p(len(words))
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.model.weights, -30, 30))))


def _ratio(a, b, toxic: int, ordinary: int):
    """Log-likelihood ratio of a word in ``a`` of toxic and ``b`` of ordinary documents."""
    whole = (a + b) / float(toxic + ordinary)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return 2 * (part(a, toxic * whole) + part(b, ordinary * whole) + part(toxic - a, toxic * (1 - whole)) + part(ordinary - b, ordinary * (1 - whole)))


def _words_of(rows: DataFrame) -> DataFrame:
    """(word, mark, toxic): each document's distinct words once, with the smallest hash among them."""
    def split(batches):
        for batch in slices(batches, "text"):
            words, marks, labels = [], [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(set(_WORDS.findall((text or "").lower())))
                mark = min((zlib.crc32(w.encode()) for w in own), default=0)
                words += own
                marks += [mark] * len(own)
                labels += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int64()), pa.array(labels, pa.int32())], ["word", "mark", "toxic"])

    return rows.select("toxic", "text").mapInArrow(split, "word string, mark bigint, toxic int")


def fit(df: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Model from documents and a label table (id, 0 or 1). Labels without a document, null labels and null ids teach nothing; an id
    labelled twice counts as toxic if either is. Without both classes every score is the share of toxic labels."""
    key = col(id_column)
    known = labels.where(key.isNotNull() & col(label_column).isNotNull()).groupBy(key.alias("l_id")).agg(F.max(col(label_column).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        share = (sizes.get(1, 0) + 0.01) / (sum(sizes.values()) + 0.02)
        return ToxicityModel(weights=np.append(np.zeros(len(THRESHOLDS) + 2), np.log(share / (1 - share))))
    place = F.pmod(F.xxhash64(F.lit("toxic"), "l_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_SAMPLE / sizes[1])).otherwise(min(1.0, ORDINARY_SAMPLE / sizes[0]))
    chosen = known.where(place < share)
    rows = checkpointed(df.select(key.alias("d_id"), col(text_column).cast("string").alias("text")).join(small_side(chosen), F.col("d_id") == F.col("l_id")).select("toxic", "text"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, ordinary = counts.get(1, 0), counts.get(0, 0)
    seen = (_words_of(rows).distinct().groupBy("word")
            .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    seen = checkpointed(seen)
    marked = seen.where((F.col("a") >= 3) & (F.col("a") * ordinary > 5 * F.col("b") * toxic)).where(_ratio(F.col("a"), F.col("b"), toxic, max(1, ordinary)) >= LEAST_RATIO)
    words = sorted((r["word"], int(r["a"])) for r in marked.select("word", "a").collect())
    if not words:
        return ToxicityModel(weights=np.append(np.zeros(len(THRESHOLDS) + 2), np.log((toxic + 0.01) / (ordinary + 0.01))))
    vocabulary = seen.where("b > 0")
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, VOCABULARY_SAMPLE / max(1, vocabulary.count()))))
    usual = sorted((r["word"], int(r["b"])) for r in vocabulary.where(part | (F.col("b") > 20)).select("word", "b").collect())
    model = ToxicityModel(_trained(words, TOXIC_BYTES), _trained([(w, min(n, 20)) for w, n in usual], ORDINARY_BYTES))
    for _ in range(2):
        distances = Distances(model.toxic, model.ordinary)
        hard = sorted((w for w in usual if distances[w[0]] >= 2), key=lambda w: (-w[1], w[0]))
        model.ordinary = b"".join(_framed(w) for w, _ in hard)[:HARD_BYTES // 2] + model.ordinary
    model.weights = _calibrated(rows, model)
    return model


def _calibrated(rows: DataFrame, model: ToxicityModel, steps: int = 30, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression (Newton steps) of the label on the features of the sample."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def describe(batches):
        scorer = Scorer(sent.value)
        for batch in slices(batches, "text"):
            found = [scorer.features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    table = rows.mapInArrow(describe, "toxic int, x array<double>").toArrow()
    x, y = np.array(table.column("x").to_pylist()), np.array(table.column("toxic").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows come in
    x, y = x[order], y[order]
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + decay * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(weights)) * decay
        step = np.linalg.solve(curve, slope)
        weights = weights - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
    return weights


def score_texts(df: DataFrame, model: ToxicityModel, *, id_column: str = "doc_id", text_column: str = "text", decision: float = DECISION) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``decision`` on) of every whole text.

    Empty and null texts have no window and get the score of none. One row per input row; only id and text are read.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in slices(batches, "text"):
            found = np.array([scorer.score(t) for t in batch.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= decision).astype(np.int32))], ["doc_id", "score", "predicted"])

    narrow = df.select(col(id_column).cast("bigint").alias("doc_id"), col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, score double, predicted int")
