"""Embedding near-duplicates by int8 tile products, exact at the threshold.

Vectors of a label are ordered by a few fixed projections and cut into tiles.
Unit vectors with a cosine of t or more are no further apart than sqrt(2 - 2t),
so tiles whose projections lie further apart than that are not compared. For
the rest, a tile pair is one product of int8 codes. Every vector carries the
exact length of what quantising lost, which bounds the error of each product;
pairs whose bound reaches the threshold are computed again in double precision.

Equal vectors are compared once, with their count. A tile pair reports counts
per vector and what connects its vectors, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import store
from siftline.llm.components import components
from siftline.llm.words import least_labels

THRESHOLD = 0.98
TILE_ROWS = 1024
#: Projections that order vectors, and those that bound tiles.
ORDERING, BOUNDING = 4, 8
#: More than float arithmetic on the codes can lose.
SLACK = 1e-5


def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _directions(width: int) -> np.ndarray:
    """Fixed orthonormal directions, as rows."""
    random = np.random.default_rng(width).standard_normal((width, min(width, BOUNDING)))
    return np.linalg.qr(random)[0].T


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to int8 codes, a scale per row, and the length of what is lost per row."""
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, lost


def near_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two tiles with a cosine of ``threshold`` or more.

    A tile is (unit rows in double precision, codes, scales, losses).
    |u.v - û.v̂| <= |û| loss(v) + loss(u), as |v| is 1.
    """
    (unit_a, code_a, scale_a, lost_a), (unit_b, code_b, scale_b, lost_b) = a, b
    kind = np.float32 if code_a.shape[1] <= 1040 else np.float64  # whole numbers below 2**24 are exact
    about = (code_a.astype(kind) @ code_b.astype(kind).T).astype(np.float64)
    about *= scale_a[:, None]
    about *= scale_b
    about += (1 + lost_a)[:, None] * lost_b + (lost_a + SLACK)[:, None]
    x, y = np.nonzero(about >= threshold)
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 16):
        part = slice(at, at + (1 << 16))
        keep[part] = np.einsum("ij,ij->i", unit_a[x[part]], unit_b[y[part]]) >= threshold
    return x[keep], y[keep]


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _coded(distinct: DataFrame, threshold: float) -> DataFrame:
    """``node, label, copies, embedding`` to codes, projections and the cell they fall in."""
    step = float(np.sqrt(max(2 - 2 * threshold, 1e-6)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                plain = np.array([vectors[i] for i in own], np.float64)
                unit = _unit(plain)
                codes, scale, lost = quantise(unit)
                spots = np.zeros((len(own), BOUNDING))
                directions = _directions(int(width))
                spots[:, : len(directions)] = unit @ directions.T
                cells = np.floor(spots[:, :ORDERING] / step).astype(np.int32)
                rows = batch.select(["node", "label", "copies"]).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array(np.full(len(own), width, np.int32)),
                        pa.array([r.tobytes() for r in plain], pa.binary()),
                        pa.array([r.tobytes() for r in codes], pa.binary()),
                        pa.array(scale),
                        pa.array(lost),
                        pa.array(list(spots), pa.list_(pa.float64())),
                        pa.array(list(cells), pa.list_(pa.int32())),
                    ],
                    names=["node", "label", "copies", "width", "vector", "codes", "scale", "lost", "spots", "cells"],
                )

    label = distinct.schema["label"].dataType.simpleString()
    return distinct.select("node", "label", "copies", "embedding").mapInArrow(
        code,
        f"node long, label {label}, copies long, width int, vector binary, codes binary, scale double, "
        "lost double, spots array<double>, cells array<int>",
    )


def _tiled(coded: DataFrame) -> DataFrame:
    """Rows with ``tile``: neighbours in the order, ``TILE_ROWS`` at most, of one label and width."""
    order = ["label", "width", "cells", "node"]
    kept = [c for c in coded.columns if c != "cells"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        now, held, tile = None, 0, -1
        for batch in batches:
            keys = zip(batch.column("label").to_pylist(), batch.column("width").to_pylist())
            tiles = np.empty(len(batch), np.int64)
            for i, key in enumerate(keys):
                if key != now or held == TILE_ROWS:
                    now, held, tile = key, 0, tile + 1
                held += 1
                tiles[i] = base + tile
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, pa.array(tiles)], names=[*kept, "tile"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields if f.name != "cells")
    cells = [F.col("cells")[i] for i in range(ORDERING)]
    spread = coded.repartitionByRange("label", "width", *cells, "node").sortWithinPartitions(
        "label", "width", *cells, "node"
    )
    return spread.mapInArrow(cut, f"{fields}, tile long")


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """``tile, side, pair``: tiles to compare, side 0 and 1, or 2 for a tile with itself."""
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-6
    boxes = tiles.groupBy("tile", "label", "width").agg(
        *[F.min(F.col("spots")[k]).alias(f"lo{k}") for k in range(BOUNDING)],
        *[F.max(F.col("spots")[k]).alias(f"hi{k}") for k in range(BOUNDING)],
    )
    a, b = boxes.alias("a"), boxes.alias("b")
    near = (F.col("a.label") == F.col("b.label")) & (F.col("a.width") == F.col("b.width")) & (F.col("a.tile") < F.col("b.tile"))
    for k in range(BOUNDING):
        near &= (F.col(f"a.lo{k}") - F.col(f"b.hi{k}") <= reach) & (F.col(f"b.lo{k}") - F.col(f"a.hi{k}") <= reach)
    pair = F.struct(F.col("a.tile").alias("first"), F.col("b.tile").alias("second"))
    sides = F.array(
        F.struct(F.col("a.tile").alias("tile"), F.lit(0).alias("side")),
        F.struct(F.col("b.tile").alias("tile"), F.lit(1).alias("side")),
    )
    two = a.join(b, near).select(pair.alias("pair"), F.explode(sides).alias("s")).select("s.tile", "s.side", "pair.*")
    own = boxes.select("tile", F.lit(2).alias("side"), F.col("tile").alias("first"), F.col("tile").alias("second"))
    return two.unionByName(own)


def vector_links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node, label, copies, embedding`` to ``node, links, root``, a row per tile pair with links.

    ``links`` counts the linked vectors of other nodes, copies included;
    ``root`` is a node that links lead to within the pair.
    """
    tiles = store(_tiled(_coded(distinct, threshold)), "tiles")
    pairs = _tile_pairs(tiles, threshold)
    rows = tiles.drop("spots", "label").join(pairs, "tile")
    key = ["first", "second"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            first, second = (table[c].to_numpy() for c in key)
            cuts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
            for a, b in zip(cuts, cuts[1:]):
                yield product(table.slice(a, b - a))
            kept = table.slice(cuts[-1]).combine_chunks()
        if kept is not None:
            yield product(kept)

    def product(table: pa.Table) -> pa.RecordBatch:
        node, copies, side = (table[c].to_numpy() for c in ("node", "copies", "side"))
        width = table["width"][0].as_py()
        unit = _unit(np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(-1, width))
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int8).reshape(-1, width)
        scale, lost = table["scale"].to_numpy(), table["lost"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        tile = lambda rows: (unit[rows], codes[rows], scale[rows], lost[rows])
        x, y = near_pairs(tile(left), tile(right), threshold)
        x, y = left[x], right[y]
        x, y = x[x != y], y[x != y]
        links = np.bincount(x, copies[y], len(node))
        if (side != 2).any():
            links += np.bincount(y, copies[x], len(node))
        root = least_labels(len(node), x, y)
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[linked]), pa.array(links[linked].astype(np.int64)), pa.array(node[root[linked]])],
            names=["node", "links", "root"],
        )

    ordered = rows.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(multiply, "node long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, embedding, label`` to ``vec_id, n_links, component_id, kept``.

    Vectors of one label (not null) link when their cosine is ``threshold`` or
    more, copies included. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do vectors of another width.
    ``component_id`` is the smallest vec_id that links lead to (null if none
    there has an id), ``kept`` marks it. Repeated rows are vectors of their own;
    an empty table gives no rows; other columns are ignored.
    """
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    fit = F.coalesce(_usable(F.col("embedding")), F.lit(False)) & F.col("label").isNotNull()
    alone = vectors.where(~fit).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    good = vectors.where(fit)
    distinct = store(
        good.groupBy("label", "embedding")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    found = store(vector_links(distinct, threshold), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = (
        distinct.join(counts, "node", "left")
        .join(joined, "node", "left")
        .withColumn("root", F.coalesce("component", "node"))
        .withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        .select("label", "embedding", "first_id", "root", "n_links")
    )
    rooted = store(rooted, "rooted")
    # Stored, so that both sides of the join are plain shuffles, which Spark splits where skewed.
    least = store(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    known = rooted.join(least, "root").select("label", "embedding", "n_links", "component_id")
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
