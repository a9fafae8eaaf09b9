"""Product codes of vectors: codebooks trained in whole numbers, parts looked up by grid cell.

A vector's components become whole numbers; it is cut into parts, and every
part position has a codebook of a few entries. To find a part's nearest entry
its coarse grid cell is hashed. The first part that falls into a cell has the
cell's box compared with all entries: an entry whose least distance to the box
is above the greatest distance of another one cannot be nearest for anything
in the box. The entries that are left are kept with the cell, and only those
are measured exactly, for this part and all later ones of the cell.

Training keeps no state on the executors: a round is one pass in which every
batch adds up its parts by entry, and only those sums (of a size that depends
on the codebooks alone) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import store
from siftline.operators.lookup import lookup_join

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Width of a grid cell, and cells a task keeps per part position before it starts anew.
CELL = 1024
KEPT_CELLS = 1 << 16
#: Components beyond this would overflow 64 bits when squared and added up.
MOST = 1 << 26


def nearest_entries(cells: np.ndarray, width: int, entries: np.ndarray) -> np.ndarray:
    """Per cell (its corner in units of ``width``) which entries may be nearest to a point of its box."""
    low = cells[:, None, :] * width
    high = low + width - 1
    below, above = low - entries, entries - high
    outside = np.maximum(np.maximum(below, above), 0)
    least = (outside * outside).sum(axis=2)
    farther = np.maximum(np.abs(below), np.abs(above))
    most = (farther * farther).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


class CellMemory:
    """The entries that matter, cell by cell, for one codebook."""

    def __init__(self, entries: np.ndarray, width: int = CELL):
        self.entries, self.width = entries, width
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.masks = np.zeros((0, len(self.entries)), bool)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """A mask of entries per point."""
        if len(self.number) > KEPT_CELLS:
            self._clear()
        cells, which = np.unique(points // self.width, axis=0, return_inverse=True)
        keys = [c.tobytes() for c in np.ascontiguousarray(cells)]
        new = [i for i, k in enumerate(keys) if k not in self.number]
        for i in new:
            self.number[keys[i]] = len(self.number)
        if new:
            self.masks = np.concatenate([self.masks, nearest_entries(cells[new], self.width, self.entries)])
        return self.masks[np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))][which.reshape(-1)]

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries (of equal distances the lower) and squared distances."""
        code = np.zeros(len(points), np.int64)
        distance = np.full(len(points), np.iinfo(np.int64).max)
        masks = self.candidates(points)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks[:, e])
            gap = points[rows] - entry
            squared = np.einsum("ij,ij->i", gap, gap)
            closer = squared < distance[rows]
            code[rows[closer]], distance[rows[closer]] = e, squared[closer]
        return code, distance


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Stored ``vec_id, label, x``: components as whole numbers; vectors that are not whole and finite go."""
    component = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    finite = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    kept = vectors.where(F.col("embedding").isNotNull()).where(finite)
    return store(kept.select(F.col("vec_id").cast("long"), "label", component.alias("x")), "whole-vectors")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(len(batch), -1)


def _assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int):
    """Batches with their parts, codes and distances per part position."""
    memories = [CellMemory(b, width) for b in books]
    for batch in batches:
        if not len(batch):
            continue
        parts = np.split(_matrix(batch), len(books), axis=1)
        found = [m.assign(p) for m, p in zip(memories, parts)]
        yield batch, parts, [f[0] for f in found], [f[1] for f in found]


def _round(vectors: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Every entry replaced by the floor of the mean of its parts; unused ones stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        sums, counts = [np.zeros_like(b) for b in now], [np.zeros(len(b), np.int64) for b in now]
        for _, parts, codes, _ in _assigned(batches, now, width):
            for s, c, part, code in zip(sums, counts, parts, codes):
                np.add.at(s, code, part)
                c += np.bincount(code, minlength=len(c))
        used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in used], pa.int32()),
                pa.array([int(e) for _, e in used], pa.int32()),
                pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
                pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    partial = vectors.select("x").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    each = F.posexplode("sums").alias("place", "value")
    totals = partial.select("part", "entry", "n", each).groupBy("part", "entry", "place")
    out = [b.copy() for b in books]
    # As many rows as the codebooks have components.
    for r in totals.agg(F.sum("n").alias("n"), F.sum("value").alias("total")).collect():
        out[r.part][r.entry][r.place] = r.total // r.n
    return out


def train_codebooks(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = CELL
) -> list[np.ndarray]:
    """Codebooks of stored ``vec_id, x``, from the parts of the smallest ids; fewer vectors give fewer entries.

    Vectors that share an id are ordered by their components. All vectors must
    have one length, a multiple of ``parts``; components must stay within
    ``MOST``. An empty table has no codebooks.
    """
    least, most, largest = vectors.agg(
        F.min(F.size("x")), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))
    ).first()
    if least is None:
        return []
    if least != most or least % parts or not least:
        raise ValueError(f"vectors must have one length that {parts} divides: {least} to {most}")
    if largest >= MOST:
        raise ValueError(f"components reach {largest}; {MOST} is the limit")
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    books = [np.ascontiguousarray(b) for b in np.split(np.array([r.x for r in first], np.int64), parts, axis=1)]
    for _ in range(rounds):
        books = _round(vectors, books, width)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], width: int = CELL) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits a part, and the squared distance to the entries."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, distances in _assigned(batches, shared.value, width):
            shown = np.stack(codes, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([row.tobytes().hex() for row in shown], pa.string()),
                    pa.array(np.sum(distances, axis=0)),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "x").mapInArrow(assign, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector ``vec_id, code, error, label_error, codebooks_sha256``.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored.
    Vectors that are null or hold null or non-finite components are left out.
    ``label_error`` adds up the errors of equal labels, nulls together. Repeated
    rows are vectors of their own. An empty table gives no rows.
    """
    whole = whole_vectors(vectors)
    books = train_codebooks(whole, parts, entries, rounds)
    if not books:
        return whole.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        )
    # A label may be null, and a key may not.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_label")
    coded = store(encode(whole, books).select("vec_id", key, "code", "error"), "codes")
    by_label = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    joined = lookup_join(coded, store(by_label, "label-errors"), key="_label", spread="vec_id")
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
