"""Document fingerprints by consistent weighted sampling.

A document is its words with how often each occurs. For every sample k a word
w has two gamma numbers r, c and a uniform one b, made from the hash of (w, k)
alone; with weight s

    t = floor(ln s / r + b),   ln a = ln c - r (t - b) - r

and the word of least a, with its t, is the sample. Two documents agree on a
sample with a probability of sum(min(s, s')) / sum(max(s, s')), the
generalised Jaccard similarity. Samples are kept as 16 bits of their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import slices, store
from siftline.llm.words import WordDigests, WordRuns, mixed

SAMPLES = 64
SEED = 11
#: Bytes of text that are sampled together.
HELD_BYTES = 3 << 20


def _sample_keys(samples: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, (samples, 3), dtype=np.uint64)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """32-bit numbers to floats between 0 and 1, neither included."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32) * np.float32(1 - 2.0**-23)


def word_weights(texts: list[bytes], digests: WordDigests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' hashes; then, text by text, each word's number and count; and where texts begin."""
    words = WordRuns(texts)
    vocabulary, number = np.unique(digests.of(words)[0], return_inverse=True)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    pairs, counts = np.unique(text * max(1, len(vocabulary)) + number, return_counts=True)
    first = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(vocabulary)))
    return vocabulary, pairs % max(1, len(vocabulary)), counts, first


def signatures(
    texts: list[bytes], samples: int = SAMPLES, seed: int = SEED, digests: WordDigests | None = None
) -> np.ndarray:
    """A row of ``samples`` 16-bit numbers per text; texts without words have zeros.

    ``digests`` keeps the hashes of words from call to call.
    """
    vocabulary, word, counts, first = word_weights(texts, WordDigests() if digests is None else digests)
    out = np.zeros((len(texts), samples), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    begins = first[:-1][full]
    sizes = np.diff(first)[full]
    several = np.flatnonzero(counts > 1)
    logs = np.log(counts[several]).astype(np.float32)
    one = np.float32(1)
    for k, keys in enumerate(_sample_keys(samples, seed)):
        x, y, z = (mixed(vocabulary ^ key) for key in keys)
        low = np.uint64(0xFFFFFFFF)
        r = -np.log(_uniform(x & low) * _uniform(x >> np.uint64(32)))
        log_c = np.log(-np.log(_uniform(y & low) * _uniform(y >> np.uint64(32))))
        b = _uniform(z & low)
        # A word that occurs once: ln s = 0, so t = 0.
        value = (log_c + r * (b - one))[word]
        at = word[several]
        t = np.floor(logs / r[at] + b[at])
        value[several] = log_c[at] - r[at] * (t - b[at] + one)
        least = np.minimum.reduceat(value, begins)
        hits = np.flatnonzero(value == np.repeat(least, sizes))
        # Of equal values the first in the order of hashes counts.
        won = hits[np.searchsorted(hits, begins)]
        step = np.zeros(len(won), np.uint64)
        place = np.searchsorted(several, won)
        known = place < len(several)
        known[known] = several[place[known]] == won[known]
        step[known] = t[place[known]].astype(np.int64).astype(np.uint64)
        with np.errstate(over="ignore"):
            code = mixed(vocabulary[word[won]] + step * np.uint64(0x9E3779B97F4A7C15))
        out[full, k] = code >> np.uint64(48)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """``doc_id, text`` to ``doc_id, fingerprint`` (four hex digits a sample); null text is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                found = pa.array([shown(s) for s in signatures(texts, samples, seed, digests)])
                ids = batch.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, found], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_FIELDS = [part.split()[0] for part in _RESULT.split(", ")]


def _compared(ids: list, texts: list[str], samples: int, seed: int, digests: WordDigests) -> list[tuple]:
    """Results for all but the last of some documents in order; each is edited with the next."""
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    signs = signatures([t.encode() for t in texts] + changed, samples, seed, digests)
    own, next_, new = signs[: len(changed)], signs[1 : len(texts)], signs[len(texts) :]
    near, far = likeness(own, new), likeness(own, next_)
    return [
        (ids[i], len(texts[i]), hashlib.sha256(changed[i]).hexdigest(), shown(own[i]), shown(new[i]), float(near[i]), float(far[i]))
        for i in range(len(changed))
    ]


def compare_edits(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and their likenesses.

    Documents stand in descending order of doc_id (nulls last, equal ids by
    text), the first again after the last. The table is sorted by ranges, so a
    document's neighbour is the next row of its task; only the last row of a
    task waits for the first of the next. ``docs`` of one row is its own next;
    an empty table gives no rows; other columns are ignored.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    spread = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = spread.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    kinds = [*_RESULT.split(", "), "part long", "head string", "tail string"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                piece = batch.slice(at, 64)
                yield from zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        digests = WordDigests()
        ids, texts, held = [], [], 0
        first = True
        for doc_id, text in rows_of(batches):
            if first:
                first = False
                yield batch_of([(None,) * len(_FIELDS) + (part, text, None)])
            ids.append(doc_id)
            texts.append(text)
            held += 2 * len(text)
            if held > HELD_BYTES and len(ids) > 1:
                yield batch_of([r + (None, None, None) for r in _compared(ids, texts, samples, seed, digests)])
                ids, texts, held = ids[-1:], texts[-1:], 2 * len(text)
        if ids:
            rows = _compared(ids, texts, samples, seed, digests)
            waiting = (ids[-1],) + (None,) * (len(_FIELDS) - 1) + (part, None, texts[-1])
            yield batch_of([r + (None, None, None) for r in rows] + [waiting])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        columns = [pa.array(list(c), types[k.split()[1]]) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[k.split()[0] for k in kinds])

    walked = store(ordered.mapInArrow(walk, ", ".join(kinds)), "fingerprints")
    done = walked.where("part IS NULL").select(*_FIELDS)
    heads = walked.where("head IS NOT NULL").select(F.col("part").alias("next"), "head")
    # One number per task: which is the next that has rows; the last goes on with the first.
    parts = heads.select(F.col("next").alias("part"))
    everywhere = Window.orderBy("part")
    follows = parts.select(
        "part",
        F.coalesce(
            F.lead("part").over(everywhere),
            F.min("part").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("next"),
    )
    waiting = walked.where("tail IS NOT NULL").select("part", "doc_id", "tail").join(follows, "part").join(heads, "next")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            for doc_id, tail, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "head"))):
                rows = _compared([doc_id, None], [tail, head], samples, seed, digests)
                yield batch_of([r + (None, None, None) for r in rows]).select(_FIELDS)

    return done.unionByName(waiting.select("doc_id", "tail", "head").mapInArrow(settle, _RESULT))
