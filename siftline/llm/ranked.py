"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

Items are the queries, documents the collection. Items are taken in blocks
whose words are of a checked size; a block goes over all documents:

1. Every text is read once. What stays of a document is its length in terms
   and, for the terms of the block, how often it holds them (its postings).
2. Counts of the whole collection give each term its weight.
3. Every task turns postings, batch by batch, from documents to terms, and
   evaluates an item's terms rarest first. A document gets an accumulator when
   a term first finds it, but only as long as a document that has none could
   still reach the k-th best partial score with all terms that are left;
   afterwards terms only update the accumulators there are. So no document of
   the result is missed and every score is exact.
4. The best of all tasks are ranked per item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftline.llm.common import slices, store

TOP = 20
#: Parameters of the score: saturation and the share of the length.
SATURATION = 12
LENGTH_PERCENT = 25
#: Bytes of item texts that one pass over the documents serves.
BLOCK_BYTES = 4 << 20
#: Terms are runs of ASCII letters and digits and of anything beyond ASCII: in UTF-8, of these bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
HITS = "item int, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Terms in order, with repeats; only A-Z is lowered."""
    return TERM.findall(text.lower())


@dataclass(frozen=True)
class Item:
    """An item's terms, as numbers in the block's vocabulary, with their repeats."""

    terms: tuple[int, ...]
    repeats: tuple[int, ...]


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """``items`` in parts whose texts have ``limit`` bytes at most, or that are one row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // limit))
    while True:
        part = F.pmod(F.xxhash64("_row"), F.lit(parts))
        sizes = items.groupBy(part.alias("part")).agg(F.sum(size).alias("size"), F.count("*").alias("n"))
        if sizes.where((F.col("size") > limit) & (F.col("n") > 1)).isEmpty():
            return [items.where(part == p) for p in range(parts)]
        parts *= 2


def block_postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Length and postings of every document that holds a term at all; ``terms`` rise."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        width = max(1, len(number))
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                found = [terms_of(t) for t in texts]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                at = np.fromiter(map(number.get, chain.from_iterable(found), repeat(-1)), np.int64, int(sizes.sum()))
                doc = np.repeat(np.arange(len(found)), sizes)
                held, counts = np.unique(doc[at >= 0] * width + at[at >= 0], return_counts=True)
                full = np.flatnonzero(sizes)
                offsets = np.searchsorted(held, np.append(full, len(found)) * width).astype(np.int32)
                offsets[-1] = len(held)
                terms, often = pa.array((held % width).astype(np.int32)), pa.array(counts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)).take(pa.array(full)),
                        pa.array(sizes[full]),
                        pa.ListArray.from_arrays(pa.array(offsets), terms),
                        pa.ListArray.from_arrays(pa.array(offsets), often),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, POSTINGS)


def term_weights(held: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in held], np.int64)


def length_norms(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Hundredths by which a document's length counts; wider numbers where 64 bits would overflow."""
    factor = LENGTH_PERCENT * documents
    if len(lengths) and int(lengths.max()) * factor >= 1 << 63:
        return np.array([100 - LENGTH_PERCENT + factor * int(n) // total for n in lengths], np.int64)
    return 100 - LENGTH_PERCENT + lengths * factor // max(total, 1)


class TermLists:
    """Postings of some documents by term: documents and score parts, and the greatest part."""

    def __init__(self, terms: np.ndarray, doc: np.ndarray, parts: np.ndarray, vocabulary: int):
        order = np.argsort(terms, kind="stable")
        self.doc, self.parts = doc[order], parts[order]
        self.first = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.bound = np.zeros(vocabulary, np.int64)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            self.bound[full] = np.maximum.reduceat(self.parts, self.first[full])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[term], self.first[term + 1]
        return self.doc[a:b], self.parts[a:b]


def evaluate(lists: TermLists, item: Item, documents: int, top: int, reached: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the ``top`` of the item, and their scores.

    ``item.terms`` come rarest first. ``reached`` is a score that ``top``
    documents elsewhere have: who stays below it is of no use.
    """
    bounds = [int(lists.bound[t]) * r for t, r in zip(item.terms, item.repeats)]
    left = sum(bounds)
    score = np.zeros(documents, np.int64)
    has = np.zeros(documents, bool)
    creating, found = True, 0
    for term, repeats, bound in zip(item.terms, item.repeats, bounds):
        if creating:
            kth = reached
            if found >= top:
                kth = max(kth, int(np.partition(score[has], found - top)[found - top]))
            creating = left >= max(kth, 1)
        left -= bound
        doc, parts = lists.of(term)
        if creating:
            score[doc] += parts * repeats
            has[doc] = True
            found = int(np.count_nonzero(has))
        elif found:
            old = has[doc]
            score[doc[old]] += parts[old] * repeats
        else:
            break
    doc = np.flatnonzero(has)
    doc = doc[score[doc] >= max(reached, 1)]
    return doc, score[doc]


class Best:
    """The ``top`` documents so far: highest score, then smallest id, null ids last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc_id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def reached(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 0

    def take(self, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        score, doc_id, null = (
            np.concatenate(pair) for pair in ((self.score, score), (self.doc_id, doc_id), (self.null, null))
        )
        order = np.lexsort((doc_id, null, -score))[: self.top]
        self.score, self.doc_id, self.null = score[order], doc_id[order], null[order]


def _block_hits(postings: DataFrame, items: list[Item], weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    spark = postings.sparkSession
    shared = spark.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value
        best = [Best(top) for _ in wanted]
        for batch in batches:
            ids = batch.column("doc_id")
            null = np.asarray(ids.is_null())
            doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)
            lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy()
            doc = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            terms = lists.flatten().to_numpy()
            norms = length_norms(batch.column("n").to_numpy(), documents, total)
            often = counts.astype(np.int64)
            parts = weight[terms] * (1_000_000_000 * often // (1000 * often + SATURATION * norms[doc]))
            by_term = TermLists(terms, doc, parts, len(weight))
            for item, kept in zip(wanted, best):
                rows, score = evaluate(by_term, item, len(batch), top, kept.reached())
                kept.take(score, doc_id[rows], null[rows])
        for number, kept in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(kept.score), number, np.int32)),
                    pa.array(kept.doc_id, mask=kept.null),
                    pa.array(kept.score),
                ],
                names=["item", "doc_id", "score"],
            )

    return postings.mapInArrow(search, HITS)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item with a score above 0.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; other columns
    are ignored. Null or termless texts find nothing and are not found. Rows
    that share an id stay rows of their own: repeated documents take a rank
    each, repeated items are answered each. Equal scores go by ``doc_id``, nulls
    last. Empty tables give no rows.
    """
    spark = docs.sparkSession
    numbered = items.select(F.col("item_id").cast("long"), "text").withColumn("_row", F.monotonically_increasing_id())
    found = []
    for block in item_blocks(store(numbered, "items")):
        rows = block.select("item_id", "text").collect()  # of a checked size
        counted = [Counter(terms_of((r.text or "").encode())) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(counted))))}
        if not vocabulary:
            continue
        postings = store(block_postings(docs, vocabulary), "postings")
        documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = np.zeros(len(vocabulary), np.int64)
        # One number per term of the block.
        for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            held[term] = n
        wanted = []
        for terms in counted:
            rarest = sorted(((int(held[vocabulary[t]]), vocabulary[t], r) for t, r in terms.items()))
            wanted.append(Item(tuple(t for _, t, _ in rarest), tuple(r for _, _, r in rarest)))
        hits = _block_hits(postings, wanted, term_weights(held, documents), documents, total, top)
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        found.append(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], RESULT)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
