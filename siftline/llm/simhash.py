"""SimHash near-duplicates, found with BK-trees.

Two fingerprints within ``radius`` bits agree on two of ``radius + 2`` blocks
of bits at least. So fingerprints are dealt into shards by every pair of
blocks, a shard's fingerprints go into a BK-tree (children keyed by their
distance to the parent), and a search follows only edges within the radius.
Trees reach the tasks by the shuffle that deals the shards, as their number
grows with the corpus: nothing is broadcast. A shard with many fingerprints
is dealt as several trees, each searched with each part of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import slices, store
from siftline.llm.components import components
from siftline.llm.words import WordRuns, least_labels
from siftline.operators.lookup import fits_broadcast

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one tree, and pairs of query and node that a search holds at a time.
TREE_ROWS = 1024
HELD_PAIRS = 1 << 21


def text_fingerprints(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints; text without words has zero."""
    words = WordRuns([t.lower() for t in texts])  # bytes: lowers A-Z only
    letters, bounds = words.letters.tobytes(), words.bounds
    counts = np.diff(words.first)
    starts = words.run_starts(shingle)
    digest = xxhash.xxh64_intdigest
    first = bounds[starts].tolist()
    last = (bounds[starts + shingle] - 1).tolist()
    hashes = np.fromiter((digest(letters[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first))
    out = np.zeros(len(texts), np.uint64)
    long_ = np.flatnonzero(counts >= shingle)
    if len(long_):
        n = counts[long_] - shingle + 1
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[long_] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8")[:, 0]
    for t in np.flatnonzero((counts > 0) & (counts < shingle)):
        a, b = bounds[words.first[t]], bounds[words.first[t + 1]] - 1
        out[t] = digest(letters[a:b], seed)  # one shingle: its hash is the majority
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, text`` to ``doc_id, bits`` (the fingerprint as a signed long); null text is empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                bits = text_fingerprints(texts, shingle, seed).view(np.int64)
                ids = batch.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(bits)], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, bits long")


def block_masks(radius: int, width: int = 64) -> list[int]:
    """Masks of all pairs of ``radius + 2`` blocks, as signed longs."""
    edges = [round(i * width / (radius + 2)) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BkForest:
    """BK-trees over ``values``, one for each run of equal ``groups``; the first value is the root."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        start = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(start, len(values)))
        self.roots = start
        parent = np.repeat(start, self.sizes)
        waiting = np.setdiff1d(np.arange(len(values)), start, assume_unique=True)
        nodes, keys = [], []
        while len(waiting):
            at = parent[waiting]
            key = at * 65 + np.bitwise_count(values[waiting] ^ values[at])
            found, first, of = np.unique(key, return_index=True, return_inverse=True)
            nodes.append(waiting[first])
            keys.append(found)
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            parent[waiting] = waiting[first][of]
            waiting = waiting[rest]
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(key, kind="stable")
        self.edges, self.children = key[order], np.concatenate([np.zeros(0, np.int64), *nodes])[order]

    def search(self, queries: np.ndarray, trees: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of query, index of value) within ``radius``; ``trees`` is each query's tree."""
        hits = [np.zeros((2, 0), np.int64)]
        query, node = np.arange(len(queries)), self.roots[trees]
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            hits.append(np.stack([query[near], node[near]]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            many = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right") - low
            ends = np.cumsum(many)
            follow = np.repeat(low - (ends - many), many) + np.arange(ends[-1])
            query, node = np.repeat(query, many), self.children[follow]
        return tuple(np.concatenate(hits, axis=1))


def _search_shards(group: np.ndarray, bits: np.ndarray, tree: np.ndarray, asks: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of whole shards: every value with the least of those it is connected with here."""
    inside, outside = np.flatnonzero(tree), np.flatnonzero(asks)
    forest = BkForest(bits[inside], group[inside])
    names = group[inside][forest.roots] if len(inside) else group[:0]
    spot = np.searchsorted(names, group[outside])
    known = spot < len(names)
    known[known] = names[spot[known]] == group[outside][known]
    outside, spot = outside[known], spot[known]
    cost = np.cumsum(forest.sizes[spot])
    a, b = [], []
    begin = 0
    while begin < len(outside):
        done = cost[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(cost, done + HELD_PAIRS, "right")))
        query, node = forest.search(bits[outside[begin:end]], spot[begin:end], radius)
        x, y = outside[begin + query], inside[node]
        other = bits[x] != bits[y]
        a.append(x[other])
        b.append(y[other])
        begin = end
    a = np.concatenate([np.zeros(0, np.int64), *a])
    b = np.concatenate([np.zeros(0, np.int64), *b])
    label = least_labels(len(bits), a, b)
    moved = np.flatnonzero(label != np.arange(len(bits)))
    signed = bits.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])


def near_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``bits`` to links ``a, b`` that connect all values within ``radius`` bits.

    The links of a shard are thinned to what connects it, so a group of
    mutual neighbours gives as many links as it has values, not pairs.
    """
    routes = F.array(*[F.struct(F.lit(i).alias("route"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(radius))])
    routed = values.select("bits", F.explode(routes).alias("_r")).select("bits", "_r.route", "_r.key")
    shards = (
        routed.groupBy("route", "key").agg(F.count("*").alias("n")).where("n > 1")
        .withColumn("parts", F.ceil(F.col("n") / TREE_ROWS).cast("int"))
    )
    part = F.pmod(F.xxhash64("bits", "route"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = (
        routed.join(shards.select("route", "key", "parts"), ["route", "key"])
        .withColumn("part", part)
        .withColumn("other", F.explode(others))
        .select("route", "key", "bits", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    group = ["route", "key", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            group_no, last = _numbers(rows)
            if last:
                yield solved(rows.slice(0, last), group_no[:last])
            kept = rows.slice(last)
        if kept is not None and len(kept):
            yield solved(kept, _numbers(kept)[0])

    def solved(rows: pa.Table, group_no: np.ndarray) -> pa.RecordBatch:
        bits = rows["bits"].to_numpy().view(np.uint64)
        mine, i, j = (rows[c].to_numpy() for c in ("part", "i", "j"))
        return _search_shards(group_no, bits, mine == i, mine == j, radius)

    def _numbers(rows: pa.Table) -> tuple[np.ndarray, int]:
        """Group number of each row, and where the last group begins."""
        change = np.zeros(len(rows), bool)
        for c in group:
            column = rows[c].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        numbers = np.cumsum(change)
        return numbers, int(np.searchsorted(numbers, numbers[-1])) if len(rows) else 0

    ordered = dealt.repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInArrow(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """``doc_id, text`` to ``doc_id, fingerprint, component_id``.

    Fingerprints within ``radius`` bits are linked, equal ones included, as
    are documents without words (all zero). ``component_id`` is the smallest
    doc_id that links lead to, or null if none there has an id. Each row
    counts as a document; an empty table gives no rows; other columns are
    ignored. The texts are read once.
    """
    marked = store(fingerprints(docs, shingle, seed), "fingerprints")
    values = store(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "values")
    joined = components(near_links(values.select("bits"), radius))
    rooted = values.join(joined.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first_id", F.coalesce("component", "bits").alias("root")
    )
    # Stored, so that both sides of the joins are plain shuffles, which Spark splits where skewed.
    rooted = store(rooted, "rooted")
    least = store(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    by_bits = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(by_bits, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def distinct_documents(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id.

    Rows without doc_id stay; rows that share one are one document. Only ids
    of dropped documents are joined with the texts.
    """
    found = near_duplicates(docs, shingle, radius, seed)
    dropped = store(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return without(docs, dropped)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the stored ids of ``dropped``; broadcast only if they are proven few."""
    small = F.broadcast(dropped) if fits_broadcast(dropped) else dropped
    return docs.join(small, "doc_id", "left_anti").select(docs.columns)
