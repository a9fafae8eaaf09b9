"""Byte-level BPE of whole texts, with tree concatenation where a text has no split.

The vocabulary splits a text before it merges bytes: nothing is merged across
the start of white space that follows something else. Text between two such
places (a stretch) is encoded once per task and remembered. A stretch without
any split may be long: a line of one letter, or a script without blanks.

1. Unsplit text above ``LEAF`` bytes is halved until it is short enough, and
   the halves are encoded on their own.
2. Two neighbours are joined by encoding a window around the joint again: some
   tokens of the left one's end and of the right one's beginning. The window
   grows until its first token is the left one's and its last the right one's.
   A sequence of tokens is the encoding of its bytes if every two neighbours
   in it are that of theirs; with a token shared on both sides every pair of
   the joined sequence stands in one that was encoded as a whole.
3. Texts above ``LONG`` bytes are dealt out: their stretches and leaves become
   rows, each encoded by any task, and leaves are joined in a tree, several
   levels to a round. What remains in order for a text is its digests, which
   go row by row over the sorted pieces.

Decoding turns ids into bytes by table, and bytes that are no UTF-8 into U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import store

#: Bytes of unsplit text that are encoded as one leaf; of a text that stays in one task; of a dealt row.
LEAF = 4096
LONG = 1 << 16
SEGMENT = 1 << 16
#: Tokens on each side of a joint that the first window takes.
WINDOW = 8
#: Neighbours that a round of the tree joins at a time.
FAN = 16
#: Characters that are split at a time to find where unsplit text ends.
SPLIT_CHARS = 1 << 14
#: Distinct stretches whose ids a task keeps, and how many are encoded in one call.
KEPT = 1 << 17
JOINED = 256
#: Characters of text that a task holds as stretches at a time.
HELD_CHARS = 1 << 20

#: White space as the vocabulary's splitting knows it.
SPACE = "\t-\r \x85\xa0  -     　"
STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BLANK = re.compile(f"[{SPACE}]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in such a vocabulary: itself if it can be seen, else from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """A byte-level tokenizer: ids of texts, of unsplit bytes, joins of neighbours, and bytes of ids."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.leaf = leaf
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        steps = json.loads(self.tokenizer.to_str())
        split, model = steps["pre_tokenizer"] or {}, steps["model"]
        plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if not plain or steps["normalizer"] or model["type"] != "BPE" or model["dropout"] or model["ignore_merges"]:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        added = steps["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or BLANK.search(t["content"]) for t in added):
            raise ValueError(f"special tokens that look at their neighbours: {path}")
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.letters = _byte_letters()
        of_letter = {ord(c): b for b, c in enumerate(self.letters)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = token not in self.special and all(ord(c) in of_letter for c in token)
            self.bytes[i] = bytes(of_letter[ord(c)] for c in token) if known else token.encode()
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self._shown = dict(enumerate(self.letters))
        self._clear()

    # --- Ids of bytes without a split

    def merged(self, data: bytes) -> np.ndarray:
        """Ids of bytes that are one unsplit piece, by the merges alone."""
        tokens = self.tokenizer.model.tokenize(data.decode("latin-1").translate(self._shown))
        return np.fromiter((t.id for t in tokens), np.uint32, len(tokens))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the bytes of both, given the ids of each."""
        width = WINDOW
        while True:
            a, b = left[-width:], right[:width]
            middle = self.merged(self.bytes_of(a) + self.bytes_of(b))
            if (len(a) == len(left) or middle[0] == a[0]) and (len(b) == len(right) or middle[-1] == b[-1]):
                return np.concatenate([left[: len(left) - len(a)], middle, right[len(b) :]])
            width *= 2

    def joined_all(self, parts: list[np.ndarray]) -> np.ndarray:
        """Ids of neighbours joined as a balanced tree."""
        while len(parts) > 1:
            pairs = [self.joined(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0]

    def unsplit(self, data: bytes) -> np.ndarray:
        """Ids of one unsplit piece of any length: halves first, then the joint."""
        if len(data) <= self.leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.unsplit(data[:half]), self.unsplit(data[half:]))

    # --- Where a text is split

    def pieces(self, text: str) -> Iterator[tuple[int, int]]:
        """Bounds of the unsplit pieces of a text without special tokens.

        Pieces are found within a part of the text; one whose end the part's own
        end may have moved (it looks two characters ahead at most) waits for the next.
        """
        at = 0
        while at < len(text):
            size = SPLIT_CHARS
            while True:
                part = text[at : at + size]
                ends = [stop for _, (_, stop) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
                if at + size < len(text):
                    ends = [e for e in ends if e + 2 <= len(part)]
                if ends:
                    break
                size *= 2
            first = at
            for e in ends:
                yield first, at + e
                first = at + e
            at = first

    def portions(self, text: str, limit: int) -> Iterator[tuple[str, str | int]]:
        """A text as ``(kind, content)``: special tokens' ids, texts of at most ``limit`` bytes that
        may be encoded apart, and single pieces."""
        done = 0
        for hit in [*self.cut.finditer(text), None]:
            part = text[done : hit.start() if hit else len(text)]
            waiting, size = [], 0
            for a, b in self._runs(part, limit):
                n = len(part[a:b].encode())
                if size and size + n > limit:
                    yield from self._closed(part, waiting)
                    waiting, size = [], 0
                if n > limit:
                    yield "piece", part[a:b]
                else:
                    waiting.append((a, b))
                    size += n
            yield from self._closed(part, waiting)
            if hit:
                yield "special", self.special[hit.group()]
                done = hit.end()

    def _closed(self, part: str, runs: list[tuple[int, int]]) -> Iterator[tuple[str, str]]:
        """Neighbours as one text, which must not end in white space: two pieces of it would become one."""
        last = len(runs)
        while last and BLANK.match(part[runs[last - 1][1] - 1]):
            last -= 1
        if last:
            yield "text", part[runs[0][0] : runs[last - 1][1]]
        for a, b in runs[last:]:
            yield "piece", part[a:b]

    def _runs(self, text: str, limit: int) -> Iterator[tuple[int, int]]:
        """Bounds of stretches; of the pieces of those that are above ``limit`` bytes."""
        for stretch in STRETCH.finditer(text):
            a, b = stretch.span()
            if 4 * (b - a) <= limit or len(stretch.group().encode()) <= limit:
                yield a, b
            else:
                yield from ((a + c, a + d) for c, d in self.pieces(stretch.group()))

    # --- Ids of texts

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Stretches' ids. Those that begin with white space and do not end with it are encoded in rows."""
        found: list[np.ndarray] = [None] * len(new)
        alone, rows = [], []
        for i, s in enumerate(new):
            if 4 * len(s) > self.leaf and len(s.encode()) > self.leaf:
                found[i] = self._long(s)
            elif BLANK.match(s) and not BLANK.match(s[-1]):
                rows.append(i)
            else:
                alone.append(i)
        groups = [rows[i : i + JOINED] for i in range(0, len(rows), JOINED)] + [[i] for i in alone]
        encoded = self.tokenizer.encode_batch_fast(
            ["".join([new[i] for i in g]) for g in groups], add_special_tokens=False
        )
        for group, each in zip(groups, encoded):
            ids = np.array(each.ids, np.uint32)
            ends = np.cumsum([len(new[i].encode()) for i in group])
            stops = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right").tolist()
            for i, a, b in zip(group, [0, *stops], stops):
                found[i] = ids[a:b]
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *found])

    def _long(self, stretch: str) -> np.ndarray:
        parts = [np.zeros(0, np.uint32)]
        for kind, content in self.portions(stretch, self.leaf):
            if kind == "special":
                parts.append(np.array([content], np.uint32))
            elif kind == "piece":
                parts.append(self.unsplit(content.encode()))
            else:
                parts.append(np.array(self.tokenizer.encode(content, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if len(self.number) > KEPT:
            self._clear()
        cut = [STRETCH.findall(t) for t in texts]
        sizes = [len(c) for c in cut]
        known = len(self.number)
        number = self.number
        at = np.fromiter((number.setdefault(s, len(number)) for s in chain.from_iterable(cut)), np.int64, sum(sizes))
        if len(number) > known:
            self._learn(list(number)[known:])
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *sizes])]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, special tokens kept, in UTF-8."""
        return self.bytes_of(ids).decode("utf-8", "replace").encode()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_NAMES)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some rows at a time; null text is empty."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for at in range(len(batch)):
            text = batch.column("text")[at].as_py() or ""
            if texts and size + len(text) > HELD_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(batch.column("doc_id")[at].as_py())
            texts.append(text)
            size += len(text)
        if texts:
            yield ids, texts


def short_reports(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """Round trips of texts that one task encodes whole: ``RESULT``."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, leaf)
        for ids, texts in _held(batches):
            rows = []
            for doc_id, found in zip(ids, bpe.encode(texts)):
                digest = hashlib.sha256(found.astype("<u4").tobytes()).hexdigest()
                rows.append((doc_id, len(found), digest, hashlib.sha256(bpe.decode(found)).hexdigest()))
            yield _rows(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(report, RESULT)


PORTIONS = "doc_id long, row long, place long, leaf int, leaves int, special int, data string, bytes binary"
ENCODED = "doc_id long, row long, place long, leaf int, leaves int, ids binary"
_ORDER = ["row", "place", "leaf"]


def portions(docs: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Rows of a text each: ``place`` counts portions that are encoded apart, ``leaf`` those that are not."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in batches:
            for doc_id, row, text in zip(*(batch.column(c) for c in ("doc_id", "row", "text"))):
                for place, (kind, content) in enumerate(bpe.portions(text.as_py(), segment)):
                    special = content if kind == "special" else None
                    data = content if kind == "text" else None
                    piece = content.encode() if kind == "piece" else None
                    leaves = [piece[i : i + segment] for i in range(0, len(piece), segment)] if piece else [None]
                    for leaf, each in enumerate(leaves):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([doc_id.as_py()], pa.int64()),
                                "row": pa.array([row.as_py()], pa.int64()),
                                "place": pa.array([place], pa.int64()),
                                "leaf": pa.array([leaf], pa.int32()),
                                "leaves": pa.array([len(leaves)], pa.int32()),
                                "special": pa.array([special], pa.int32()),
                                "data": pa.array([data], pa.string()),
                                "bytes": pa.array([each], pa.binary()),
                            }
                        )

    numbered = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return numbered.select("doc_id", "row", "text").mapInArrow(cut, PORTIONS)


def _encoded(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, leaf)
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                special, data, piece = (row.column(c)[0].as_py() for c in ("special", "data", "bytes"))
                if special is not None:
                    ids = np.array([special], np.uint32)
                else:
                    ids = bpe.unsplit(piece) if piece is not None else bpe.encode([data])[0]
                kept = [row.column(c) for c in ("doc_id", "row", "place", "leaf", "leaves")]
                kept.append(pa.array([ids.astype("<u4").tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(kept, names=["doc_id", *_ORDER, "leaves", "ids"])

    return rows.repartition("row", "place", "leaf").mapInArrow(encode, ENCODED)


def _joined_leaves(leaves: DataFrame, path: str) -> DataFrame:
    """One level of the tree: ``FAN`` neighbours become one row."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        now, head, parts = None, None, []

        def done() -> pa.RecordBatch:
            ids = bpe.joined_all(parts).astype("<u4").tobytes()
            values = [*head, now[2], -(-head[3] // FAN)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([head[0]], pa.int64()),
                    pa.array([now[0]], pa.int64()),
                    pa.array([now[1]], pa.int64()),
                    pa.array([now[2]], pa.int32()),
                    pa.array([values[-1]], pa.int32()),
                    pa.array([ids], pa.binary()),
                ],
                names=["doc_id", *_ORDER, "leaves", "ids"],
            )

        for batch in batches:
            for at in range(len(batch)):
                doc_id, row, place, leaf, leaves_, ids = (
                    batch.column(c)[at].as_py() for c in ("doc_id", *_ORDER, "leaves", "ids")
                )
                key = (row, place, leaf // FAN)
                if key != now:
                    if parts:
                        yield done()
                    now, head, parts = key, (doc_id, row, place, leaves_), []
                parts.append(np.frombuffer(ids, "<u4"))
        if parts:
            yield done()

    node = F.floor(F.col("leaf") / FAN)
    together = leaves.repartition("row", "place", node).sortWithinPartitions(*_ORDER)
    return together.mapInArrow(join, ENCODED)


def _digests(pieces: DataFrame, path: str) -> DataFrame:
    """Ids of a text in order, piece by piece, to its digests: ``row`` and ``RESULT``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        now, doc_id, n, ids_digest, text_digest, decoder = None, None, 0, None, None, None

        def done() -> pa.RecordBatch:
            text_digest.update(decoder.decode(b"", True).encode())
            return _rows([(doc_id, n, ids_digest.hexdigest(), text_digest.hexdigest())])

        for batch in batches:
            for at in range(len(batch)):
                row = batch.column("row")[at].as_py()
                if row != now:
                    if now is not None:
                        yield done()
                    now, doc_id, n = row, batch.column("doc_id")[at].as_py(), 0
                    ids_digest, text_digest = hashlib.sha256(), hashlib.sha256()
                    decoder = codecs.getincrementaldecoder("utf-8")("replace")
                ids = np.frombuffer(batch.column("ids")[at].as_py(), "<u4")
                n += len(ids)
                ids_digest.update(ids.tobytes())
                text_digest.update(decoder.decode(bpe.bytes_of(ids)).encode())
        if now is not None:
            yield done()

    ordered = pieces.repartition("row").sortWithinPartitions(*_ORDER)
    return ordered.select("doc_id", "row", "ids").mapInArrow(digest, RESULT)


def long_reports(docs: DataFrame, path: str, segment: int = SEGMENT, leaf: int = LEAF) -> DataFrame:
    """Round trips of texts that are dealt out in portions: ``RESULT``."""
    cut = store(portions(docs, path, segment), "portions")
    most = cut.agg(F.max("leaves")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    encoded = store(_encoded(cut, path, leaf), "encoded")
    whole, leaves = encoded.where("leaves = 1"), encoded.where("leaves > 1")
    while most > 1:
        leaves = store(_joined_leaves(leaves, path), "joined")
        most = -(-most // FAN)
    return _digests(whole.unionByName(leaves), path)


def round_trips(
    docs: DataFrame, path: str, long: int = LONG, segment: int = SEGMENT, leaf: int = LEAF
) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null text is empty. Repeated rows and rows without id are documents of their
    own; an empty table gives no rows; other columns are ignored. A task holds
    one text at a time; ids of one unsplit piece must fit a cell (2 GB).
    """
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    return short_reports(docs.where(~is_long), path, leaf).unionByName(
        long_reports(docs.where(is_long), path, segment, leaf)
    )
