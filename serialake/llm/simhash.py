"""SimHash near-duplicates: BK-trees over fingerprints, dealt to shards whose members alone can be neighbours.

Two 64-bit fingerprints within 3 bits agree on one of four 16-bit blocks, and on one of four 12-bit pieces of the other 48 bits.
So every distinct fingerprint is dealt to 16 shards, each named by 28 of its bits, and every link lies inside a shard. A
shard holds a BK-tree: the first member is the root, a child hangs below its parent by its integer Hamming distance, and a search
follows only edges whose distance is within the radius of the distance to the node.

The trees are dealt by a shuffle, not broadcast: a broadcast of all trees would take the fingerprints of all documents through the
driver. Copies collapse before the deal (distinct fingerprints), so a hot group of copies is one member. A shard reports
its links as stars, member to the smallest member it reaches inside the shard, never as pairs. The stars are joined to
components by label propagation with pointer jumping, cut by checkpoints.

``near_duplicates`` follows another rule: two texts are near copies if their sets of five-word shingles overlap by 0.8 (Jaccard) or more.
Such texts differ in about 10 of 64 bits, too far for shards of 28 equal bits, so candidates come from a SimHash of 512 bits: each of many
tables deals the texts to buckets by some of the bits, a BK-tree over the first 128 bits finds near members of a bucket, and a bucket
reports them as stars. Bits of a bucket grow with log2 of the number of texts (chance neighbours stay few) and tables grow with them, so
that ``RECALL`` of the pairs at 0.8 meet, and more of those above. Stars join to candidate groups, whose shingle sets are compared
exactly, block against block: a set travels once per block and not once per pair, and only stars of true links leave a block.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from serialake.llm.common import checkpointed, col, others, slices, small_side, unused

RADIUS = 3
BLOCKS, BLOCK_BITS, PIECES, PIECE_BITS = 4, 16, 4, 12
SEED = 42

SIMILARITY, WIDTH = 0.8, 5    # the general rule for near copies
RECALL = 0.99                 # share of pairs at SIMILARITY that meet in a bucket
LANES = 8                     # 64-bit words of a wide fingerprint
NEAR = 32                     # of its first 128 bits; pairs at 0.8 differ in 19 on average, one in 1,500 in more than 32
LEADERS = 3                   # members of a bucket whose neighbours are joined before any tree is searched
BLOCK, BLOCK_SHINGLES = 500, 500_000  # members and shingles of a block, on average
REDEALS = 2                   # times the members of a group of several blocks are dealt anew
PART_ROWS, PART_SHINGLES = 200_000, 4_000_000  # rows of ids, and shingles, of a partition of the tables that are written between steps
LAST_LINKS = 1_000_000        # links that one task joins at the end of a contraction (16 MB of ids)

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# -- fingerprints ----------------------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle in order; empty without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included: XXH64 with seed 42, a bit set if set in over half of them.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer words than a shingle: their whole sequence; none: 0.
    """
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, b], minlength=256) @ _BYTE_BITS for b in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (bigint, the 64 bits as signed) of every row."""
    def run(batches):
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = col(text_column).cast("string")
    narrow = df.select(col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


# -- BK-trees --------------------------------------------------------------------------------------------------------

def _mask(block: int, piece: int) -> int:
    """The 28 bits that name a shard: a block, and a piece of the other 48 bits."""
    rest = [b for b in range(64) if b // BLOCK_BITS != block]
    bits = list(range(block * BLOCK_BITS, (block + 1) * BLOCK_BITS)) + rest[piece * PIECE_BITS:(piece + 1) * PIECE_BITS]
    return sum(1 << b for b in bits)


MASKS = [_mask(b, p) for b in range(BLOCKS) for p in range(PIECES)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; those of several 64-bit words have a second axis."""
    differ = np.bitwise_count(a ^ b).astype(np.int64)
    return differ if differ.ndim == 1 else differ.sum(axis=1)


class Forest:
    """A BK-tree for each run of equal ``shards`` (sorted), built and searched for all shards at once."""

    def __init__(self, shards: np.ndarray, fps: np.ndarray):
        n = len(fps)
        self.fps = fps
        self.most = 64 * (fps.shape[1] if fps.ndim > 1 else 1)
        self.root = np.searchsorted(shards, shards)
        at, open_ = self.root.copy(), np.flatnonzero(self.root != np.arange(n))
        edges, children = [], []
        while len(open_):
            distance = _distance(fps[open_], fps[at[open_]])
            edge = at[open_] * (self.most + 1) + distance
            names, first, back = np.unique(edge, return_index=True, return_inverse=True)
            child = open_[first]  # the earliest that comes along an edge hangs there
            edges.append(names)
            children.append(child)
            at[open_] = child[back]
            open_ = np.delete(open_, first)
        key, node = (np.concatenate(edges), np.concatenate(children)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(key)
        self.edge, self.child = key[order], node[order]

    def search(self, members: np.ndarray, radius: int = RADIUS):
        """Yield (member, neighbour) arrays: all nodes of the member's tree within ``radius``, itself included."""
        who, node = members, self.root[members]
        while len(who):
            distance = _distance(self.fps[who], self.fps[node])
            near = distance <= radius
            yield who[near], node[near]
            low = np.searchsorted(self.edge, node * (self.most + 1) + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edge, node * (self.most + 1) + np.minimum(distance + radius, self.most), side="right")
            count = high - low
            ends = np.cumsum(count)
            at = np.repeat(low - (ends - count), count) + np.arange(ends[-1])
            who, node = np.repeat(who, count), self.child[at]


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _hook(parent: np.ndarray, who: np.ndarray, node: np.ndarray) -> np.ndarray:
    """``parent`` with the links joined: the larger root hangs below the smaller until both ends of every link meet."""
    while len(who):
        parent = _find(parent)
        a, b = parent[who], parent[node]
        open_ = a != b
        who, node, a, b = who[open_], node[open_], a[open_], b[open_]
        if len(who):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    return parent


def shard_stars(shards: np.ndarray, fps: np.ndarray, frontier: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole shards (sorted by shard, fp) as (member, smallest member reached) without loops."""
    starts = np.searchsorted(shards, shards)
    n = len(fps)
    sizes = np.bincount(starts, minlength=n)[starts]
    busy = np.flatnonzero(sizes > 1)
    if not len(busy):
        return fps[:0], fps[:0]
    shards, fps, sizes = shards[busy], fps[busy], sizes[busy]
    forest, parent = Forest(shards, fps), np.arange(len(fps))
    # Members are searched in slices whose frontier stays bounded: a node meets at most its shard's members.
    cost = np.cumsum(sizes)
    begin = 0
    while begin < len(fps):
        end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + frontier)))
        for who, node in forest.search(np.arange(begin, end)):
            parent = _hook(parent, who, node)
        begin = end
    root = _find(parent)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def star_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct ``fp`` values as stars per shard, without repeats."""
    kinds = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("kind"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(MASKS)])
    dealt = distinct.select("fp", F.explode(kinds).alias("s")).select("s.kind", "s.bits", "fp")
    sorted_ = dealt.repartition(F.col("kind"), F.col("bits")).sortWithinPartitions("kind", "bits", "fp")

    def link(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(np.asarray(batch.column(i), dtype=np.int64) for i in range(3)))
            kind, bits, fps = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((kind != kind[-1]) | (bits != bits[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on in the next batch
            held = [(kind[cut:], bits[cut:], fps[cut:])]
            if cut:
                yield made(kind[:cut], bits[:cut], fps[:cut])
        if held:
            yield made(*held[0])

    def made(kind, bits, fps):
        change = np.concatenate([[True], (kind[1:] != kind[:-1]) | (bits[1:] != bits[:-1])])
        a, b = shard_stars(np.cumsum(change), fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return sorted_.mapInArrow(link, "a bigint, b bigint").distinct()


# -- components ------------------------------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every linked value: the smallest value of its component. ``links`` (a, b) is read several times."""
    both = checkpointed(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root")))
    while True:
        seen = label.select(F.col("fp").alias("b"), F.col("root").alias("other"))
        least = both.join(seen, "b").groupBy("a").agg(F.min("other").alias("other"))
        hooked = label.join(least, label["fp"] == least["a"], "left").select("fp", "root", F.least("root", "other").alias("next"))
        up = label.select(F.col("fp").alias("u"), F.col("root").alias("over"))
        jumped = checkpointed(hooked.join(up, F.col("next") == F.col("u"), "left").select("fp", "root", F.coalesce(F.least("next", "over"), "next").alias("next")))
        changed = jumped.where("next < root").limit(1).count()
        label = jumped.select("fp", F.col("next").alias("root"))
        if not changed:
            return label


def bit_duplicates(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (bigint), root (smallest fp of the component) and component_id (smallest doc_id reachable over links
    of at most 3 differing bits), one row per row.

    Null and blank texts have fingerprint zero and link like any other; texts shorter than a shingle are one shingle. Rows are
    documents: an id given twice appears twice. Null ids are kept and never name a component that has another id. An
    empty table gives an empty result; other columns are not read.
    """
    rows = checkpointed(fingerprints(df, id_column=id_column, text_column=text_column, width=width))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(checkpointed(star_links(distinct)))
    rooted = distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    return rows.join(ids, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def _written(df: DataFrame, rows: int, most: int = PART_ROWS) -> DataFrame:
    """``df``, which has about ``rows`` rows, checkpointed in partitions of about ``most`` rows: a table that shrinks from step to step
    must not keep a file and a shuffle block for each of the session's partitions."""
    return checkpointed(df.coalesce(max(1, math.ceil(rows / most))))


def _ends(batches):
    """(fp, root) for every linked value like ``components``, of links that one task holds."""
    held = [np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(2)]) for batch in batches if batch.num_rows]
    if held:
        values, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        root = _find(_hook(np.arange(len(values)), *place.reshape(2, -1)))
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(values[root])], ["fp", "root"])


def contracted(links: DataFrame) -> DataFrame:
    """(fp, root) for every linked value like ``components``, for many links between few values.

    Each round hangs every value below its smallest neighbour, doubles these steps until they end, and replaces both ends of the links by
    where they end. Only values smaller than all their neighbours are left; links whose ends have met and repeated links go. Every round
    is dozens of jobs, whose plans, threads and statuses the driver holds for a while. So rounds end as soon as no more than
    ``LAST_LINKS`` links are left, however many there were: one task joins these.
    """
    edges = checkpointed(links.where("a <> b").select("a", "b"))
    left, label, values = edges.count(), None, 0
    edges = edges.coalesce(max(1, math.ceil(left / PART_ROWS)))
    while left > LAST_LINKS:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = _written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), 2 * left)
        moved = True
        while moved:
            over = hung.select(F.col("v").alias("root"), F.col("root").alias("next"))
            jumped = _written(hung.join(over, "root").select("v", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")), 2 * left)
            hung, moved = jumped.select("v", "root"), not jumped.where("moved").isEmpty()
        if label is None:
            label, values = hung.select(F.col("v").alias("fp"), "root"), hung.count()
        else:
            label = _further(label, hung.withColumnRenamed("v", "fp"), values)
        one = hung.select(F.col("v").alias("a"), F.col("root").alias("x"))
        other = hung.select(F.col("v").alias("b"), F.col("root").alias("y"))
        met = edges.join(one, "a").select("x", "b").where("x <> b").join(other, "b").where("x <> y")
        edges = _written(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), left)
        left = edges.count()
    if label is not None and not left:
        return label
    ends = checkpointed(edges.coalesce(1).mapInArrow(_ends, "fp bigint, root bigint"))
    return ends if label is None else _further(label, ends, values)


def _further(label: DataFrame, ends: DataFrame, values: int) -> DataFrame:
    """``label`` (fp, root; ``values`` rows) with roots replaced by where ``ends`` (fp, root) says that they end."""
    over = ends.select(F.col("fp").alias("root"), F.col("root").alias("next"))
    return _written(label.join(over, "root", "left").select("fp", F.coalesce("next", "root").alias("root")), values)


# -- near copies by overlap ------------------------------------------------------------------------------------------

def wide_fingerprint(distinct: np.ndarray) -> bytes:
    """SimHash of 64 x ``LANES`` bits of a set of shingle hashes: each hash is mixed into one 64-bit word per lane."""
    counts = np.zeros((8 * LANES, 256))
    for begin in range(0, len(distinct), 20_000):
        mixed = distinct[begin:begin + 20_000, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        lanes = (mixed ^ (mixed >> np.uint64(31))).view(np.uint8) + np.arange(8 * LANES) * 256
        counts += np.bincount(lanes.ravel(), minlength=counts.size).reshape(counts.shape)
    return np.packbits(counts @ _BYTE_BITS * 2 > len(distinct), bitorder="little").tobytes()


def tables(texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> np.ndarray:
    """(table, bit) positions that name a bucket: log2 of the texts as bits, and as many tables as ``recall`` at ``similarity`` takes."""
    bits = max(8, math.ceil(math.log2(max(2, texts))))
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi  # sets of one size; others of this overlap agree in more bits
    count = math.ceil(math.log(1 - recall) / math.log(1 - same ** bits))
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(64 * LANES, bits, replace=False) for _ in range(count)])


def _shingle_sets(df: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """doc_id, text_hash, set_hash of every row, and bits: the wide fingerprint (null without words)."""
    def run(batches):
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(2).to_pylist()]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            bits = pa.array([wide_fingerprint(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests.view(np.int64)), bits], ["doc_id", "text_hash", "set_hash", "bits"])

    text = col(text_column).cast("string")
    narrow = df.select(col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, text_hash bigint, set_hash bigint, bits binary")


def _whole_keys(batches, keys: int):
    """Tables that end where a key ends; rows come sorted by the first ``keys`` columns. A key's batches are put together once."""
    held: list[pa.RecordBatch] = []
    ends = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(keys)])
        before = np.flatnonzero((names != names[:, -1:]).any(axis=0))
        cut = int(before[-1]) + 1 if len(before) else 0  # the last key may go on in the next batch
        if cut:
            held.append(batch.slice(0, cut))
        if held and (cut or (ends != names[:, -1]).any()):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
        ends = names[:, -1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bucket_stars(buckets: np.ndarray, fps: np.ndarray, radius: int = NEAR, frontier: int = 200_000) -> np.ndarray:
    """For each row (sorted by bucket) the first row of its component: rows of one bucket within ``radius`` bits are linked.

    A few leaders per bucket join their neighbours first. Two rows of the largest component found so need no comparison, so only the
    rows outside it search the bucket's BK-tree, and a bucket full of near texts costs a few steps per member.
    """
    rows = np.arange(len(buckets))
    start = np.searchsorted(buckets, buckets)
    parent, leader = rows.copy(), start
    alone, led = np.ones(len(rows), bool), np.zeros(len(rows), bool)
    for _ in range(LEADERS):
        led[leader] = True
        near = _distance(fps, fps[leader]) <= radius
        parent = _hook(parent, rows[near], leader[near])
        alone &= ~near
        left = rows[alone]
        if not len(left):
            break
        names, first = np.unique(start[left], return_index=True)
        following = rows.copy()
        following[names] = left[first]  # a bucket without a row left keeps its first row as leader
        leader = following[start]
    root = _find(parent)
    roots, sizes = np.unique(root, return_counts=True)
    order = np.lexsort((roots, -sizes, start[roots]))
    names, first = np.unique(start[roots][order], return_index=True)
    largest = rows.copy()
    largest[names] = roots[order][first]
    searching = (root != largest[start]) & ~led
    if searching.any():
        asked = np.zeros(len(rows), bool)
        asked[start[searching]] = True
        inside = np.flatnonzero(asked[start])
        forest, who = Forest(start[inside], fps[inside]), np.flatnonzero(searching[inside])
        cost = np.cumsum(np.bincount(start[inside], minlength=len(rows))[start[inside][who]])
        begin = 0
        while begin < len(who):
            end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + frontier)))
            for a, b in forest.search(who[begin:end], radius):
                parent = _hook(parent, inside[a], inside[b])
            begin = end
        root = _find(parent)
    return root


def _candidates(members: DataFrame, places: np.ndarray) -> DataFrame:
    """(a, b): near members (set_hash, bits) of a bucket, as stars to one member of what they reach inside the bucket."""
    weights = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)

    def deal(batches):
        for batch in slices(batches, "bits", 32_000):
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits, first = np.unpackbits(raw, axis=1, bitorder="little"), raw[:, :16].copy().view(np.int64)
            for table, at in enumerate(places):
                keys = (bits[:, at] @ weights) * len(places) + table
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), pa.array(first[:, 0]), pa.array(first[:, 1])], ["bucket", "a", "x", "y"])

    def meet(batches):
        for table in _whole_keys(batches, 1):
            bucket, a, x, y = (c.to_numpy() for c in table.columns)
            same = bucket[1:] == bucket[:-1]
            busy = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if busy.any():
                bucket, a, fps = bucket[busy], a[busy], np.stack([x[busy], y[busy]], axis=1).view(np.uint64)
                root = bucket_stars(bucket, fps)
                linked = root != np.arange(len(root))
                yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(a[root[linked]])], ["a", "b"])

    dealt = members.select("set_hash", "bits").where("bits is not null").mapInArrow(deal, "bucket bigint, a bigint, x bigint, y bigint")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "a").mapInArrow(meet, "a bigint, b bigint").distinct()


def _sets(groups: DataFrame, members: DataFrame, df: DataFrame, text_column: str, width: int) -> DataFrame:
    """set_hash and shingles (array of distinct hashes) of every member of a candidate group."""
    asked = _written(members.join(groups, "set_hash", "left_semi").select(F.col("text_hash").alias("t_hash")).distinct(), groups.count())

    def spell(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(0).to_pylist()]
            own = {xxhash.xxh64_intdigest(s.tobytes(), SEED): s for s in sets}
            new = [h for h in own if h not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(new, np.uint64).view(np.int64)), pa.array([own[h].view(np.int64) for h in new], pa.list_(pa.int64()))], ["set_hash", "shingles"])

    text = col(text_column).cast("string")
    texts = df.select(text.alias("text")).join(small_side(asked), F.xxhash64("text") == F.col("t_hash"), "left_semi")
    return checkpointed(texts.mapInArrow(spell, "set_hash bigint, shingles array<bigint>").groupBy("set_hash").agg(F.first("shingles").alias("shingles")))


def overlap_links(values: np.ndarray, counts: np.ndarray, asked: np.ndarray, similarity: float, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): sets whose overlap is ``similarity`` or more, i among ``asked`` (row numbers). Set i holds ``counts[i]`` distinct values.

    Only values of two or more sets matter; a chunk of them at a time becomes a 0/1 matrix whose product counts common values.
    """
    order = np.argsort(values, kind="stable")
    row, sorted_ = np.repeat(np.arange(len(counts)), counts)[order], values[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[:len(sorted_)]
    code = np.cumsum(new) - 1
    shared = np.bincount(code, minlength=1)[code] > 1
    row, code = row[shared], np.cumsum(new[shared]) - 1
    both = np.zeros((len(asked), len(counts)))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, chunk):
        begin, end = np.searchsorted(code, [low, low + chunk])
        holds = np.zeros((len(counts), min(chunk, int(code[end - 1]) - low + 1)), np.float32)
        holds[row[begin:end], code[begin:end] - low] = 1
        both += holds[asked] @ holds.T
    i, j = np.nonzero(both >= similarity * (counts[asked][:, None] + counts[None, :] - both) - 1e-9)
    return asked[i], j


def _block_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b): true links inside the blocks of ``dealt`` (group, block, other, asked, set_hash, shingles) as stars; every row is compared with the asked ones."""
    def verify(batches):
        for table in _whole_keys(batches, 3):
            names = np.stack([table.column(i).to_numpy() for i in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)]))
            asked, ids, lists = table.column(3).to_numpy().astype(bool), table.column(4).to_numpy(), table.column(5).combine_chunks()
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            low, high = [], []
            for begin, end in zip(starts, [*starts[1:], len(ids)]):
                if end - begin > 1 and asked[begin:end].any():
                    i, j = overlap_links(values[offsets[begin]:offsets[end]], np.diff(offsets[begin:end + 1]), np.flatnonzero(asked[begin:end]), similarity)
                    root = _find(_hook(np.arange(end - begin), i, j))
                    linked = np.flatnonzero(root != np.arange(end - begin))
                    low.append(ids[begin + root[linked]])
                    high.append(ids[begin + linked])
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(high)), pa.array(np.concatenate(low))], ["a", "b"])

    key = [F.col(c) for c in ("group", "block", "other")]
    narrow = dealt.select(*key, F.col("asked").cast("int").alias("asked"), "set_hash", "shingles")
    return narrow.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "a bigint, b bigint").where("a <> b").distinct()


def _parts(count: str, shingles: str):
    """Blocks that so many members with so many shingles take."""
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1))


def _rooted(placed: DataFrame, links: DataFrame) -> DataFrame:
    found = contracted(links).select(F.col("fp").alias("set_hash"), F.col("root").alias("r"))
    return placed.join(found, "set_hash", "left").withColumn("root", F.coalesce("r", "set_hash")).drop("r")


def _true_links(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): stars whose components are those of all overlaps of ``similarity`` or more inside the candidate groups (set_hash, group).

    A group of one block is settled by one comparison. The members of others are dealt to blocks anew a few times, which joins most
    of what belongs together; then what is outside the group's largest component is compared with all of the group, block against block.
    """
    rows = groups.count()
    narrow = _written(groups.join(sets.select("set_hash", F.size("shingles").alias("m")), "set_hash"), rows)
    sizes = narrow.groupBy("group").agg(F.count("*").alias("n"), F.sum("m").alias("s")).select("group", _parts("n", "s").alias("parts"))
    placed = _written(narrow.join(sizes, "group"), rows)

    def block(salt: int, parts):
        return F.pmod(F.xxhash64("set_hash", F.lit(salt)), parts)

    def inside(members: DataFrame, salt: int) -> DataFrame:
        own = members.select("set_hash", "group", block(salt, F.col("parts")).alias("block"), F.lit(0).alias("other"), F.lit(1).alias("asked"))
        return checkpointed(_block_links(sets.join(own, "set_hash"), similarity))

    links = inside(placed, 0)
    large = _written(placed.where("parts > 1"), rows)
    if large.isEmpty():
        return links
    for salt in range(1, REDEALS + 1):
        links = links.unionAll(inside(large, salt))
    rooted = _written(_rooted(large, links), rows)
    by_root = rooted.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum("m").alias("s"))
    summary = by_root.groupBy("group").agg(F.max(F.struct("n", "root")).alias("top"), F.max_by("s", F.struct("n", "root")).alias("of_top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    summary = summary.select("group", F.col("top.root").alias("main"), (F.col("n") - F.col("top.n")).alias("n"), (F.col("s") - F.col("of_top")).alias("s"))
    open_ = _written(rooted.join(summary.where("n > 0").select("group", "main", _parts("n", "s").alias("outside")), "group"), rows)
    mine, theirs = block(0, F.col("outside")), block(0, F.col("parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asking = open_.where("root <> main").select("set_hash", "group", mine.alias("block"), numbers("parts").alias("other"), F.lit(1).alias("asked"))
    against = open_.select("set_hash", "group", numbers("outside").alias("block"), theirs.alias("other"), F.lit(0).alias("asked"))
    return links.unionAll(checkpointed(_block_links(sets.join(asking.unionAll(against), "set_hash"), similarity)))


def near_duplicates(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, root and component_id (smallest doc_id reachable over pairs whose sets of ``width``-word shingles overlap by
    ``similarity`` or more), one row per row.

    Every link is checked by its exact overlap; of the pairs at ``similarity`` about ``RECALL`` are found, of those above more. Texts with
    equal sets are one member, null and blank texts among themselves too. Sets are compared block against block, so no row stands for a pair.
    """
    rows = checkpointed(_shingle_sets(df, id_column, text_column, width))
    distinct = checkpointed(rows.groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("bits").alias("bits")))
    stars = checkpointed(_candidates(distinct, tables(distinct.count(), similarity)))
    groups = contracted(stars).select(F.col("fp").alias("set_hash"), F.col("root").alias("group"))
    links = _true_links(groups, _sets(groups, distinct, df, text_column, width), similarity)
    members = _rooted(distinct.select("set_hash", "least"), links)
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = members.select("set_hash", "root").join(named, "root")
    return rows.join(ids, "set_hash").select("doc_id", "text_hash", "root", "component_id")


def keep_one(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component one row, that with the smallest id (null ids last; of rows
    with one id the smallest text hash; of rows equal in both any one, they differ in other columns at most). All columns are kept."""
    found = near_duplicates(df, id_column=id_column, text_column=text_column, width=width, similarity=similarity)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    k_id, k_hash, own_id, own_hash, place = unused(df, "k_id", "k_hash", "own_id", "own_hash", "place")
    keepers = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.k_id").alias(k_id), F.col("k.k_hash").alias(k_hash))
    own = [F.col(own_id).eqNullSafe(F.col(k_id)), F.col(own_hash) == F.col(k_hash)]
    keyed = df.select(*others(df), col(id_column).cast("bigint").alias(own_id), F.xxhash64(col(text_column).cast("string")).alias(own_hash))
    first = F.row_number().over(W.partitionBy(own_id, own_hash).orderBy(own_hash))
    return keyed.join(keepers, own, "left_semi").withColumn(place, first).where(F.col(place) == 1).select(*others(df))
