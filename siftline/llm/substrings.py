"""Exact removal of passages that occur more than once, anywhere in the corpus.

A window is ``length`` consecutive words. A Count-min sketch first bounds how
often each can occur; only windows with a bound of two or more are grouped
exactly. The sketch counts anchors instead of windows: the 18-word run with
the least hash inside a window. Equal windows have equal anchors at equal
places, so the count of an anchor is never below that of its windows, and
there are ten times fewer anchors than windows.

1. Every task sketches the anchors of its rows; sketches are merged by range
   of cells, and one bit per cell (two or more) is all that leaves them.
2. Texts are read again. Windows whose anchor may repeat are shuffled by
   anchor, in runs of neighbours; windows that repeat within a part of a
   batch are settled there, and one of them goes on to tell the others.
   Anchors that many different windows share are counted first; theirs are
   shuffled window by window, as only equal ones have to meet.
3. Groups of equal windows (128-bit hashes made of the digests of their words)
   of two or more give word ranges, which join the texts by document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import packed, slices, store, unpacked
from siftline.llm.words import WordDigests, WordRuns, run_hashes, sliding_min
from siftline.operators.lookup import lookup_join

LENGTH = 35
#: Rows of the sketch, its cells per byte of text, and the bound on its cells (bits of memory per task).
SKETCH_ROWS = 2
CELLS_PER_BYTE = 1 / 8
MOST_CELLS = 1 << 29
#: Bytes of text whose hashes a task holds at a time, and suspect windows that it groups before the shuffle.
HELD_BYTES = 1 << 20
HELD_WINDOWS = 1 << 18
#: Suspect windows of one anchor that a task groups; of anchors above it there are at most all windows over this.
ANCHOR_WINDOWS = 1 << 18
#: Cells that one merging step holds.
SHARD_BITS = 18

_ROW_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _anchor_words(length: int) -> int:
    return length // 2 + 1


def _anchors(words: WordRuns, runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, the places of their anchors, and the hash (one of ``runs``) at every place.

    Of equal hashes in a window the first counts, so equal windows agree.
    """
    size = _anchor_words(length)
    starts = words.run_starts(length)
    hashes = np.zeros(len(words), np.uint64)
    hashes[: len(runs)] = runs
    if not len(starts):
        return starts, starts, hashes
    place = np.arange(len(words), dtype=np.uint64)
    ranked = (hashes >> np.uint64(32) << np.uint64(32)) | place
    least = sliding_min(ranked, length - size + 1)[starts]
    return starts, (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * _ROW_FACTORS[row]) >> np.uint64(64 - bits)


def repeat_sketch(texts: DataFrame, length: int = LENGTH) -> np.ndarray | None:
    """Bits per cell and row: set where anchors of ``texts`` count two or more; null if none does.

    The width follows the bytes of text up to ``MOST_CELLS``; beyond that more
    windows pass, and the exact step sorts them out.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(1 << 20, int(size * CELLS_PER_BYTE)))
    bits = (cells // SKETCH_ROWS).bit_length() - 1
    shard = min(bits, SHARD_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, memory = [np.zeros(0, np.uint64)], WordDigests()
        for batch in batches:
            for _, held in slices(batch.column("text"), HELD_BYTES):
                words = WordRuns(held)
                (runs,) = run_hashes(memory.of(words)[0], _anchor_words(length))
                _, places, hashes = _anchors(words, runs, length)
                parts.append(hashes[places[np.diff(places, prepend=-1) != 0]])
        hashes = np.concatenate(parts)
        for row in range(SKETCH_ROWS):
            found, times = np.unique(_cells(hashes, row, bits), return_counts=True)
            which = (found >> np.uint64(shard)).astype(np.int64)
            local = (found & np.uint64((1 << shard) - 1)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(which, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(which))):
                delta = np.diff(local[a:b], prepend=np.uint32(0)).astype("<u4")
                planes = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 4).T).tobytes()
                data = zlib.compress(planes + np.packbits(times[a:b] > 1).tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int32()), pa.array([which[a]], pa.int64()), pa.array([b - a], pa.int32()), pa.array([data], pa.binary())],
                    names=["row", "shard", "n", "data"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            data = np.packbits(twice).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([data], pa.binary())],
                names=["row", "shard", "data"],
            )

        for batch in batches:
            for row, which, n, data in zip(*(batch.column(c).to_pylist() for c in ("row", "shard", "n", "data"))):
                if now != (row, which):
                    if now is not None:
                        yield done()
                    now, once, twice = (row, which), np.zeros(1 << shard, bool), np.zeros(1 << shard, bool)
                plain = zlib.decompress(data)
                delta = np.ascontiguousarray(np.frombuffer(plain, np.uint8, 4 * n).reshape(4, n).T).view("<u4")[:, 0]
                local = np.cumsum(delta)
                several = np.unpackbits(np.frombuffer(plain, np.uint8, offset=4 * n), count=n).astype(bool)
                twice[local] |= several | once[local]
                once[local] = True
        if now is not None:
            yield done()

    partial = texts.select("text").mapInArrow(count, "row int, shard long, n int, data binary")
    merged = partial.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(
        merge, "row int, shard long, data binary"
    )
    sketch = np.zeros((SKETCH_ROWS, 1 << max(bits - 3, 0)), np.uint8)
    step = (1 << shard) // 8
    # Of a fixed size: one bit per cell, at most MOST_CELLS.
    for row, which, data in merged.toLocalIterator():
        sketch[row, which * step : which * step + len(data)] = np.frombuffer(data, np.uint8)
    return sketch if sketch.any() else None


def _suspects(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = sketch.shape[1].bit_length() + 2
    out = np.ones(len(hashes), bool)
    for row in range(SKETCH_ROWS):
        cell = _cells(hashes, row, bits)
        byte = sketch[row][(cell >> np.uint64(3)).astype(np.int64)]
        out &= (byte >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return out


WINDOWS = "anchor long, doc_id long, ref long, start int, sure boolean, n int, hashes binary"
RANGES = "doc_id long, ref long, start int, n int"
SINGLE = "window1 long, window2 long, doc_id long, ref long, start int, sure boolean"


def _same(window: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each row's group of equal windows, and whether the row is its group's first."""
    order = np.lexsort((window[:, 1], window[:, 0]))
    w = window[order]
    new = np.ones(len(order), bool)
    new[1:] = (w[1:] != w[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    total = np.empty(len(order), np.int64)
    total[order] = np.bincount(group, weight[order], minlength=group[-1] + 1 if len(group) else 0)[group]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    return total, first


def _joined_runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs begin: rows at which a column that should stay changes (the last one should rise by one)."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = columns[-1][1:] != columns[-1][:-1] + 1
        for c in columns[:-1]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _suspect_windows(keyed: DataFrame, sketch: np.ndarray, length: int) -> DataFrame:
    shared = keyed.sparkSession.sparkContext.broadcast(sketch)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordDigests()
        for batch in batches:
            parts, n = [], 0
            for first, held in slices(batch.column("text"), HELD_BYTES):
                words = WordRuns(held)
                digests = memory.of(words)
                runs, window = run_hashes(digests[0], _anchor_words(length), length)
                starts, places, hashes = _anchors(words, runs, length)
                anchors = np.flatnonzero(np.diff(places, prepend=-1))
                passes = np.repeat(
                    _suspects(shared.value, hashes[places[anchors]]), np.diff(np.append(anchors, len(places)))
                )
                starts, places = starts[passes], places[passes]
                window = np.stack([window[starts], run_hashes(digests[1], length)[0][starts]], axis=1)
                text = np.searchsorted(words.first, starts, "right") - 1
                parts.append((text + first, starts - words.first[text], places - starts, hashes[places], window))
                n += len(starts)
                if n > HELD_WINDOWS:
                    yield emitted(batch, *map(np.concatenate, zip(*parts)))
                    parts, n = [], 0
            if n:
                yield emitted(batch, *map(np.concatenate, zip(*parts)))

    def emitted(batch, text, start, place, anchor, window) -> pa.RecordBatch:
        total, first = _same(window, np.ones(len(text), np.int64))
        settled = total > 1
        ranges = np.flatnonzero(settled)
        begins = _joined_runs(text[ranges], start[ranges])
        ends = np.append(begins[1:], len(ranges))
        kept = np.flatnonzero(~settled | first)
        runs = _joined_runs(text[kept], settled[kept], anchor[kept], (start + place)[kept], start[kept])
        offsets = np.append(runs, len(kept)) * 16
        ids, refs = batch.column("doc_id"), batch.column("ref")
        a, b = ranges[begins], kept[runs]
        rows = pa.array(np.concatenate([text[a], text[b]]))
        data = pa.Array.from_buffers(
            pa.binary(), len(runs), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(window[kept]))]
        )
        # Settled ranges travel along under any key.
        key = np.concatenate([refs.to_numpy(zero_copy_only=False)[text[a]], anchor[b].view(np.int64)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key),
                ids.take(rows),
                refs.take(rows),
                pa.array(np.concatenate([start[a], start[b]]).astype(np.int32)),
                pa.array(np.concatenate([np.ones(len(a), bool), settled[b]])),
                pa.array(np.concatenate([ends - begins, np.diff(offsets) // 16]).astype(np.int32)),
                pa.concat_arrays([pa.nulls(len(a), pa.binary()), data]),
            ],
            names=["anchor", "doc_id", "ref", "start", "sure", "n", "hashes"],
        )

    return keyed.mapInArrow(find, WINDOWS)


def repeated_ranges(keyed: DataFrame, length: int = LENGTH) -> DataFrame | None:
    """``doc_id, ref, text`` to runs of ``n`` repeated windows from word ``start``; null if there are none.

    A run may come in parts, and parts may overlap.
    """
    sketch = repeat_sketch(keyed, length)
    if sketch is None:
        return None
    suspects = _suspect_windows(keyed, sketch, length)
    crowded = crowded_anchors(suspects)
    if crowded.isEmpty():
        return _by_anchor(suspects)
    marked = lookup_join(suspects, crowded.withColumn("_crowded", F.lit(True)), "left", key="anchor", spread="ref")
    apart = F.col("_crowded").isNotNull() & F.col("hashes").isNotNull()
    few, many = marked.where(~apart).select(suspects.columns), marked.where(apart).select(suspects.columns)
    return _by_anchor(few).unionByName(_by_window(many))


def crowded_anchors(suspects: DataFrame) -> DataFrame:
    """Anchors of more than ``ANCHOR_WINDOWS`` suspect windows, stored."""
    counts = suspects.where("hashes IS NOT NULL").groupBy("anchor").agg(F.sum("n").alias("windows"))
    return store(counts.where(F.col("windows") > ANCHOR_WINDOWS).select("anchor"), "crowded")


def _by_window(suspects: DataFrame) -> DataFrame:
    """Repeated windows, each a range of its own; counts are added up before they are shuffled."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(n)), n)
            of = pa.array(row)
            window = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(window[:, 0])),
                    pa.array(np.ascontiguousarray(window[:, 1])),
                    batch.column("doc_id").take(of),
                    batch.column("ref").take(of),
                    pa.array((batch.column("start").to_numpy()[row] + within).astype(np.int32)),
                    batch.column("sure").take(of),
                ],
                names=["window1", "window2", "doc_id", "ref", "start", "sure"],
            )

    group = F.struct("window1", "window2").alias("group")
    windows = store(suspects.mapInArrow(expand, SINGLE).select(group, "doc_id", "ref", "start", "sure"), "windows")
    weight = F.sum(F.lit(1) + F.col("sure").cast("int"))
    repeated = store(windows.groupBy("group").agg(weight.alias("weight")).where("weight > 1").select("group"), "repeated")
    found = lookup_join(windows.where("NOT sure"), repeated, key="group", spread="ref")
    return found.select("doc_id", "ref", "start", F.lit(1).alias("n"))


def _by_anchor(suspects: DataFrame) -> DataFrame:
    """Runs of repeated windows; the windows of an anchor meet in one task."""
    ordered = suspects.repartition("anchor").sortWithinPartitions("anchor")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            anchor = rows["anchor"].to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            yield from solved(rows.slice(0, last))
            kept = rows.slice(last).combine_chunks()
        if kept is not None:
            yield from solved(kept)

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        passed = rows.filter(pa.compute.is_null(rows["hashes"])).select(["doc_id", "ref", "start", "n"])
        yield from passed.to_batches()
        rows = rows.filter(pa.compute.is_valid(rows["hashes"]))
        if not len(rows):
            return
        n = rows["n"].to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        row = np.repeat(np.arange(len(n)), n)
        window = np.frombuffer(b"".join(rows["hashes"].to_pylist()), np.uint64).reshape(-1, 2)
        sure = rows["sure"].to_numpy(zero_copy_only=False)[row]
        total, _ = _same(window, 1 + sure)
        found = np.flatnonzero((total > 1) & ~sure)
        begins = _joined_runs(row[found], within[found])
        sizes = np.diff(np.append(begins, len(found)))
        a = found[begins]
        of = pa.array(row[a])
        yield pa.RecordBatch.from_arrays(
            [
                rows["doc_id"].take(of).combine_chunks(),
                rows["ref"].take(of).combine_chunks(),
                pa.array((rows["start"].to_numpy()[row[a]] + within[a]).astype(np.int32)),
                pa.array(sizes.astype(np.int32)),
            ],
            names=["doc_id", "ref", "start", "n"],
        )

    return ordered.mapInArrow(settle, RANGES)


def with_reference(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ref``: together with doc_id it names a row, or rows that are equal."""
    return docs.withColumn("ref", F.xxhash64("doc_id", "text"))


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with ``ref`` and ``ranges``: arrays of (start, n), null where nothing repeats."""
    keyed = with_reference(docs)
    ranges = repeated_ranges(keyed.select(F.col("doc_id").cast("long"), "ref", "text"), length)
    if ranges is None:
        return keyed.withColumn("ranges", F.lit(None).cast("array<struct<start:int,n:int>>"))
    # A set: equal rows say the same, and a document has few ranges for each of its words.
    by_doc = ranges.groupBy(F.col("doc_id").alias("_doc"), F.col("ref").alias("_ref")).agg(
        F.collect_set(F.struct("start", "n")).alias("ranges")
    )
    same = F.col("ref").eqNullSafe(F.col("_ref")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    return keyed.join(by_doc, same, "left").drop("_doc", "_ref")


def _kept_mask(n_words: int, ranges: list[dict] | None, length: int) -> np.ndarray:
    cover = np.zeros(n_words + 1, np.int64)
    for r in ranges or ():
        cover[r["start"]] += 1
        cover[r["start"] + r["n"] + length - 1] -= 1
    return np.cumsum(cover[:-1]) == 0


def _rewritten(batches: Iterator[pa.RecordBatch], length: int):
    """Batches with first row, and per row: text, words, mask of kept words, kept words."""
    for batch in batches:
        ranges = batch.column("ranges").to_pylist()
        for first, texts in slices(batch.column("text"), HELD_BYTES):
            words = WordRuns(texts)
            counts = np.diff(words.first)
            rows = []
            for t, n in enumerate(counts.tolist()):
                a, b = words.first[t], words.first[t + 1]
                letters = words.letters[words.bounds[a] : words.bounds[b]]
                found = ranges[first + t]
                kept = _kept_mask(n, found, length)
                if found:
                    sizes = np.diff(words.bounds[a : b + 1])
                    letters = letters[np.repeat(kept, sizes)]
                rows.append((n, int(n - kept.sum()), letters[:-1].tobytes()))
            yield batch, first, rows


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``.

    Null text has no words. The digest is of the kept words joined by one
    blank. Repeated rows repeat each other. An empty table gives no rows;
    other columns are ignored.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, rows in _rewritten(batches, length):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(rows)),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = _with_ranges(docs.select(F.col("doc_id").cast("long"), "text"), length)
    return joined.select("doc_id", "text", "ranges").mapInArrow(
        report, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the words that repeated windows cover; columns unchanged.

    Documents that lose nothing keep their text as it is; others hold the kept
    words joined by blanks (and ``n_chars``, if there is one, to match);
    documents that lose all their words go.
    """
    own = ("doc_id", "text", "n_chars")
    held = packed(docs, *own)
    joined = _with_ranges(held, length).select(*held.columns, "ranges")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, rows in _rewritten(batches, length):
            part = batch.slice(first, len(rows))
            old = part.column("text").to_pylist()
            columns = {n: part.column(n) for n in part.schema.names if n != "ranges"}
            texts = [kept.decode() if gone else text for text, (_, gone, kept) in zip(old, rows)]
            columns["text"] = pa.array(texts, part.column("text").type)
            if "n_chars" in columns:
                sizes = zip(columns["n_chars"].to_pylist(), texts, rows)
                columns["n_chars"] = pa.array([len(t) if r[1] else n for n, t, r in sizes], columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array([not r[1] or r[1] < r[0] for r in rows]))

    return joined.mapInArrow(rewrite, held.schema).select(unpacked(docs.columns, own))
