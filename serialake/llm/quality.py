"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams, fitted on trusted text.

Counting: each task packs the n-grams of its texts into 64-bit keys and reports (gram, count) per slice; Spark sums them. Lower orders
count distinct left neighbours (continuation counts). Discounts D1, D2, D3+ of each order come from its counts of counts. The
probabilities are joins of count tables on context and suffix, spread over shards by Spark. The counts cover all trusted text:
no sample, no cut-off.

Scoring: the fitted grams of the highest order are split into shards of at most ``SHARD`` entries by their keys; texts are read once per shard,
each position is answered by the one shard its gram belongs to, and the partial sums of a document are added. Character grams
repeat so much that a corpus needs few shards. The model and not the texts is sent around.

A document stays if its perplexity is at most its language's threshold: a quantile of the trusted documents' perplexities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake.llm.common import checkpointed, col, others, slices, small_side, unused

ORDER = 4
SHARD = 2_000_000
QUANTILE = 0.99
MARGIN = 1.4      # a threshold stands this factor above the quantile
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between line breaks, and where each begins."""
    padded = [f"\n{t or ''}\n" for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths


def _keys(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit key of the gram that ends at each position (the first order - 1 are meaningless)."""
    key = np.zeros(len(codes), np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for back in range(order - 1, -1, -1):
        key *= _MIX
        key[back:] += wide[:len(codes) - back]
        key ^= key >> np.uint64(29)
    return key


def _offsets(starts: np.ndarray, total: int) -> np.ndarray:
    """Position within its own text."""
    lengths = np.diff(np.append(starts, total))
    return np.arange(total) - np.repeat(starts, lengths)


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) of all character grams of one order; ``texts`` has one column, text."""
    def count(batches):
        for batch in slices(batches, "text", 1_500_000):
            codes, starts = _codes(batch.column(0).to_pylist())
            ends = np.flatnonzero(_offsets(starts, len(codes)) >= order - 1)
            _, first, n = np.unique(_keys(codes, order)[ends], return_index=True, return_counts=True)
            spelled = codes[ends[first][:, None] - np.arange(order - 1, -1, -1)].tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array([spelled[i:i + order] for i in range(0, len(spelled), order)], pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

    return texts.mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of one order from how many grams are seen once, twice, three and four times."""
    row = table.agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[i] or 0 for i in range(4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9  # too little text for counts of counts
    y = n1 / (n1 + 2 * n2)
    values = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(v, 0.05), i - 0.05) for i, v in zip((1, 2, 3), values))  # type: ignore[return-value]


def fit(trusted: DataFrame, *, text_column: str = "text", order: int = ORDER) -> DataFrame:
    """(gram, p, gamma): interpolated probability of the gram's last character after the rest (null: a context seen at the beginning of
    texts only), and the weight that the gram as a context leaves to shorter ones (null: never a context). The empty gram holds the probability of an unseen character.

    Null texts count as empty. No text at all gives a model in which every character is equally unlikely.
    """
    texts = trusted.select(col(text_column).cast("string").alias("text"))
    tables = {order: checkpointed(gram_counts(texts, order))}
    for size in range(order - 1, 0, -1):
        tables[size] = checkpointed(tables[size + 1].groupBy(F.substring("gram", 2, size).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    letters = tables[1].count() + 1
    lower, parts = None, []
    gammas = {}
    for size in range(1, order + 1):
        table, (d1, d2, d3) = tables[size], discounts(tables[size])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.substring("gram", 1, size - 1)
        heads = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("left"))
        gammas[size - 1] = heads.select(F.col("context").alias("gram"), (F.col("left") / F.col("total")).alias("gamma"))
        own = table.withColumn("context", context).join(heads, "context")
        shorter = F.lit(1.0 / letters) if lower is None else F.col("p_low")
        if lower is not None:
            own = own.withColumn("tail", F.substring("gram", 2, size - 1)).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("p_low")), "tail")
        lower = checkpointed(own.select("gram", ((F.col("n") - cut + F.col("left") * shorter) / F.col("total")).alias("p")))
        parts.append(lower)
    out = None
    for size in range(0, order + 1):
        gamma = gammas.get(size)
        base = trusted.sparkSession.createDataFrame([("", 1.0 / letters)], "gram string, p double") if size == 0 else parts[size - 1]
        part = base.join(gamma, "gram", "full").select("gram", "p", "gamma") if gamma is not None else base.select("gram", "p", F.lit(None).cast("double").alias("gamma"))
        out = part if out is None else out.unionByName(part)
    return checkpointed(out)


class Table:
    """Vectorised hash table from 64-bit keys to float32 values (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        keys, values, slot = keys.copy(), values.copy(), self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether the key is known)."""
        slot = self._slot(keys)
        there = self.keys[slot]
        known = there == keys
        values = np.where(known, self.values[slot], np.float32(0))
        open_ = np.flatnonzero(~known & (there != 0))
        while len(open_):
            slot_ = (slot[open_] + np.uint64(1)) & self.mask
            slot[open_] = slot_
            there = self.keys[slot_]
            hit = there == keys[open_]
            values[open_[hit]], known[open_[hit]] = self.values[slot_[hit]], True
            open_ = open_[~hit & (there != 0)]
        return values, known


def _gram_keys(grams: list[str], size: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _keys(codes, size)[size - 1::size] if size else np.zeros(len(grams), np.uint64)


class Model:
    """What a task needs: log probabilities and log context weights by order, of the highest order one shard only."""

    def __init__(self, low: dict[int, tuple[Table, Table]], top: Table, order: int, unseen: float, shard: int, shards: int):
        self.low, self.top, self.order, self.unseen, self.shard, self.shards = low, top, order, unseen, shard, shards

    def log_sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities of this shard's positions, and number of characters, per text."""
        codes, starts = _codes(texts)
        place = _offsets(starts, len(codes))
        keys = {size: _keys(codes, size) for size in range(1, self.order + 1)}
        out = np.zeros(len(codes))
        mine = place > 0
        if self.shards > 1:  # the first characters of a text have no full gram: shard 0 answers them
            mine &= np.where(place >= self.order - 1, keys[self.order] % np.uint64(self.shards), 0) == self.shard
        full = np.flatnonzero(mine & (place >= self.order - 1))
        values, known = self.top.find(keys[self.order][full])
        out[full] = values
        open_ = full[~known]
        for size in range(self.order - 1, 0, -1):
            probabilities, weights = self.low[size]
            if len(open_):  # the context of the longer gram hands down its weight
                out[open_] += weights.find(keys[size][open_ - 1])[0]
            open_ = np.concatenate([open_, np.flatnonzero(mine & (place == size - 1))]) if size > 1 else open_
            values, known = probabilities.find(keys[size][open_])
            out[open_] += values
            open_ = open_[~known]
        out[open_] += self.unseen
        lengths = np.diff(np.append(starts, len(codes))) - 1
        return np.add.reduceat(out, starts) if len(starts) else np.zeros(0), lengths


def _log(values) -> np.ndarray:
    return np.log(np.maximum(np.asarray(values, np.float64), 1e-300)).astype(np.float32)


class Shards:
    """A model's shards, one at a time: the driver never holds more than the lower orders and the shard it sends."""

    def __init__(self, top: DataFrame, low: dict[int, tuple[Table, Table]], order: int, unseen: float, count: int):
        self.top, self.low, self.order, self.unseen, self.count = top, low, order, unseen, count

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[Model]:
        for shard in range(self.count):
            found = self._grams(shard).toArrow()
            keys = _gram_keys(found.column("gram").to_pylist(), self.order)
            yield Model(self.low, Table(keys, _log(found.column("p"))), self.order, self.unseen, shard, self.count)

    def _grams(self, shard: int) -> DataFrame:
        order, count = self.order, self.count
        if count == 1:
            return self.top

        def own(batches):
            for batch in batches:
                keys = _gram_keys(batch.column(0).to_pylist(), order)
                yield batch.filter(pa.array(keys % np.uint64(count) == shard))

        return self.top.mapInArrow(own, "gram string, p double")


def load(model: DataFrame, order: int = ORDER, shard_size: int = SHARD) -> Shards:
    """The model in shards; lower orders (a small part of it) are in each."""
    rows = model.withColumn("size", F.length("gram"))
    low, unseen = {}, 0.0
    for size in range(order - 1, -1, -1):
        part = rows.where(F.col("size") == size).toArrow()
        grams = part.column("gram").to_pylist()
        keys, gamma, p = _gram_keys(grams, size), part.column("gamma").combine_chunks(), part.column("p").combine_chunks()
        context, seen = np.asarray(gamma.is_valid()), np.asarray(p.is_valid())
        if size:
            low[size] = (Table(keys[seen], _log(p.fill_null(1.0))[seen]), Table(keys[context], _log(gamma.fill_null(1.0))[context]))
        else:
            unseen = float(_log(p)[0] + _log(gamma.fill_null(1.0))[0])
    top = rows.where(F.col("size") == order).select("gram", "p")
    return Shards(top, low, order, unseen, max(1, -(-top.count() // shard_size)))


def perplexities(df: DataFrame, models: Shards, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_hash, the columns ``keep``, and perplexity of every whole text (null texts score as empty)."""
    text = col(text_column).cast("string")
    narrow = df.select(col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), *[col(c) for c in keep], text.alias("text"))
    names = [*narrow.columns[:-1], "logs", "chars"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    parts = []
    for model in models:
        sent = df.sparkSession.sparkContext.broadcast(model)

        def score(batches, sent=sent):
            for batch in slices(batches, "text", 1_500_000):
                logs, chars = sent.value.log_sums(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logs), pa.array(chars, pa.int64())], names)

        parts.append(narrow.mapInArrow(score, f"{kinds}, logs double, chars bigint"))
    own = names[:-2]
    if len(parts) == 1:
        return parts[0].select(*own, F.exp(-F.col("logs") / F.col("chars")).alias("perplexity"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    # Repeated rows meet in one group with equal sums; each stands once per shard.
    summed = whole.groupBy(*own).agg((F.sum("logs") / F.count(F.lit(1)) * len(parts)).alias("logs"), F.max("chars").alias("chars"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"))
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*own, F.exp(-F.col("logs") / F.col("chars")).alias("perplexity"))


def judged(df: DataFrame, trusted_ids: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER,
           quantile: float = QUANTILE, margin: float = MARGIN, shard_size: int = SHARD) -> DataFrame:
    """doc_id, text_hash, lang, perplexity, threshold, keep: one row per row of ``df``.

    ``trusted_ids`` (one column: ids) names the documents the model is fitted on, all of them. threshold is ``margin`` times the
    ``quantile`` of trusted perplexities in the document's language (null is a language of its own), over all languages where none of
    its documents is trusted, and null (everything stays) where nothing is trusted. Empty texts are scored by their two line ends.
    """
    ids = small_side(trusted_ids.select(F.col(trusted_ids.columns[0]).cast("bigint").alias("t_id")).where("t_id is not null").distinct())
    trusted = df.select(col(id_column).cast("bigint").alias("t_id"), col(text_column).alias("text")).join(ids, "t_id", "left_semi")
    models = load(fit(trusted.select("text"), order=order), order, shard_size)
    rows = perplexities(df.select(col(id_column).alias("doc_id"), col(text_column).alias("text"), col(lang_column).cast("string").alias("lang")), models, keep=("lang",))
    marked = checkpointed(rows.join(ids.withColumn("trusted", F.lit(True)), F.col("doc_id") == F.col("t_id"), "left").drop("t_id"))
    exact = F.percentile_approx("perplexity", quantile, 10_000) * margin
    known = marked.where("trusted")
    by_lang = known.groupBy("lang").agg(exact.alias("own")).select(F.col("lang").alias("t_lang"), "own")
    overall = known.agg(exact.alias("all")).first()["all"]
    joined = marked.join(by_lang, F.col("lang").eqNullSafe(F.col("t_lang")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return joined.select("doc_id", "text_hash", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"))


def keep_good(df: DataFrame, trusted_ids: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose perplexity is within their language's threshold; columns unchanged."""
    b_id, b_hash, own_id, own_hash = unused(df, "b_id", "b_hash", "own_id", "own_hash")
    bad = judged(df, trusted_ids, id_column=id_column, text_column=text_column, **options).where("not keep").select(F.col("doc_id").alias(b_id), F.col("text_hash").alias(b_hash)).distinct()
    keyed = df.select(*others(df), col(id_column).cast("bigint").alias(own_id), F.xxhash64(col(text_column).cast("string")).alias(own_hash))
    return keyed.join(small_side(bad), F.col(own_id).eqNullSafe(F.col(b_id)) & (F.col(own_hash) == F.col(b_hash)), "left_anti").select(*others(df))
