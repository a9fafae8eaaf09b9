"""Best-fit packing of tokenised documents into sequences of a fixed length.

Only the lengths matter for a packing, and there are at most ``capacity`` of
them. So pieces are counted by length, the few thousand counts are packed on
the driver, and each piece finds its place by its rank among the pieces of its
length. Nothing but counts leaves the executors, whatever the corpus holds.

The plan: pieces above a third of the capacity go two to a sequence at most,
each with the longest partner that still fits; shorter ones, longest first,
go to the sequence with the smallest gap that takes them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftline.llm.common import slices, store

CAPACITY = 2048
END_ID = 0
#: Distinct words whose ids a task keeps; beyond it the memory starts anew.
KEPT_WORDS = 400_000
#: Pieces of one length that are ranked in one group.
GROUP_ROWS = 256

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
)


#: The steps by which a word vocabulary of this kind cuts a text into pre-tokens.
WORD_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words, each with a line end, that such steps cut in two at most: small Latin letters, then ASCII marks.
#: (In UTF-8 no byte of the class but the first of a letter's two can precede its second.)
CUT = re.compile(rb"([a-z\xc3\x9f-\xb6\xb8-\xbf]+)([!-&(-/:-@\[-`{-~]*)\n|([^\n]*)\n")
#: Small letters whose capital, 0x20 below in the last byte, is no small letter: all but sharp s and y with two dots.
ENDINGS = frozenset([*range(0x61, 0x7B), *range(0xA0, 0xB7), *range(0xB8, 0xBF)])


class LetterMerges:
    """Ids of words of small Latin letters, very many in one call, by the vocabulary's own merges.

    Such a vocabulary knows a word's last byte as a symbol of its own. Words
    here hold no capitals, so the capital of the last letter stands for that
    symbol, and a rank of merges over bytes gives the same ids: rank and id
    rise alike, and every entry is the encoding of itself.
    """

    def __init__(self, vocabulary: dict[str, int], suffix: str):
        import tiktoken

        plain, of_letter = frozenset([*range(0x61, 0x7B), 0xC3, *range(0x9F, 0xC0)]), _byte_letters()
        ranks = {}
        for token, number in vocabulary.items():
            ended = token.endswith(suffix)
            letters = token.removesuffix(suffix) if ended else token
            data = bytearray(of_letter.get(c, 0) for c in letters)
            if not data or not plain.issuperset(data) or (ended and data[-1] not in ENDINGS):
                continue
            if ended:
                data[-1] -= 0x20
            ranks[bytes(data)] = number
        self.encoding = tiktoken.Encoding("letters", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words one after another; each must end in one of ``ENDINGS``."""
        data = bytearray(b"\n".join([*words, b""]))
        view = np.frombuffer(data, np.uint8)
        view[np.flatnonzero(view == 0x0A) - 1] -= 0x20
        return np.array(self.encoding.encode_ordinary(data.decode()), np.int64)


def _byte_letters() -> dict[str, int]:
    """Bytes by the letter that stands for each: itself if it can be seen, else from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {chr(b) if b in seen else chr(next(hidden)): b for b in range(256)}


class WordIds:
    """Token ids of whole texts; with a word vocabulary each distinct word is tokenised once.

    A word vocabulary drops white space and never joins characters across it,
    nor a letter with a mark, and marks the end of each run; ASCII letters may
    be lowered first unless a special token is spelled out. Other tokenizers
    get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        cuts = [
            [step["type"] for step in (steps[part] or {}).get(inner, ())]
            for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
        ]
        split = steps["pre_tokenizer"]["pretokenizers"][0] if cuts[1] else {}
        suffix = steps["model"].get("end_of_word_suffix")
        self.by_word = (
            cuts == list(WORD_STEPS) and split["pattern"] == {"Regex": WORD_PATTERN} and bool(suffix)
        )
        if self.by_word:
            vocabulary = steps["model"]["vocab"]
            merged = [m if isinstance(m, str) else " ".join(m) for m in steps["model"]["merges"]]
            numbers = [vocabulary[m.replace(" ", "")] for m in merged]
            rising = all(a < b for a, b in zip(numbers, numbers[1:]))
            self.letters = LetterMerges(vocabulary, suffix) if rising else None
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self._clear()

    def _clear(self) -> None:
        # Words are one or two parts; parts have their ids one after another. Part 0 is empty.
        self.index: dict[bytes, int] = {}
        self.halves = np.zeros((0, 2), np.int64)
        self.parts: dict[bytes, int] = {b"": 0}
        self.ids = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        self.count = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep_parts(self, parts: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self, words: list[bytes]) -> None:
        cut = CUT.findall(b"\n".join([*words, b""]))
        first = [a or other for a, _, other in cut]
        second = [b for _, b, _ in cut]
        fresh = {a for a, _, _ in cut if a and a[-1] in ENDINGS} if self.letters else set()
        letters = list(fresh.difference(self.parts))
        if letters:
            ids = self.letters.ids(letters)
            self._keep_parts(letters, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        others = list({*first, *second}.difference(self.parts))
        if others:
            found = self._whole([o.decode() for o in others])
            count = np.fromiter(map(len, found), np.int64, len(found))
            self._keep_parts(others, np.fromiter(chain.from_iterable(found), np.int64, count.sum()), count)
        number = self.parts.__getitem__
        halves = [np.fromiter(map(number, half), np.int64, len(cut)) for half in (first, second)]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.halves = np.concatenate([self.halves, np.stack(halves, axis=1)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(ids, np.uint32) for ids in self._whole([t.decode() for t in texts])]
        if len(self.index) > KEPT_WORDS:
            self._clear()
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        sizes = [len(each) for each in words]
        flat = list(chain.from_iterable(words))
        number = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new = [flat[i] for i in missing.tolist()]
            self._learn(list(set(new)))
            number[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        parts = self.halves[number].reshape(-1)
        count = self.count[parts]
        ends = np.cumsum(count)
        taken = np.repeat(self.begin[parts] - (ends - count), count)
        ids = self.ids[taken + np.arange(len(taken))].astype(np.uint32)
        bounds = np.concatenate([[0], ends[1::2]])[np.cumsum([0, *sizes])]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, text`` to pieces of at most ``capacity`` tokens, ``end_id`` closing each document.

    Null text is empty: one piece that holds ``end_id`` alone. ``ids`` is null
    unless asked for.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch.column("text")):
                rows = []
                for row, ids in enumerate(encoder.encode(texts), first):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        kept = part.astype(np.int32) if with_ids else None
                        crc = zlib.crc32(part.tobytes())
                        rows.append((doc_ids[row], piece, start, len(part), crc, kept))
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names)
    )


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Counts by length to runs ``length, first_rank, sequence, per_sequence, offset``.

    Ranks ``first_rank`` and up of a length go ``per_sequence`` to a sequence,
    from ``sequence`` on, at ``offset`` and behind one another. The number of
    runs depends on ``capacity`` only. Lengths outside 1..capacity are an error.
    """
    if any(not 0 < size <= capacity for size in counts):
        raise ValueError(f"lengths must be in 1..{capacity}")
    # A sequence pattern: how many sequences look like it, its gap, and its content as a
    # chain (content before, length, how often).
    open_: dict[int, list[tuple[int, tuple | None]]] = {}

    def put(gap: int, times: int, content: tuple | None) -> None:
        if times:
            open_.setdefault(gap, []).append((times, content))

    left = {s: n for s, n in counts.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect_right(large, capacity - size) - 1  # the longest that fits beside it
        if at >= 0 and large[at] == size and left[size] == 1:
            at -= 1
        if at < 0:
            put(capacity - size, left[large.pop()], (None, size, 1))
            continue
        other = large[at]
        pairs = left[size] // 2 if other == size else min(left[size], left[other])
        put(capacity - size - other, pairs, ((None, size, 1), other, 1))
        left[size] -= pairs
        left[other] -= pairs
        large = [s for s in large if s not in (size, other) or left[s]]
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        need = left[size]
        for gap in sorted(g for g in open_ if g >= size):
            fit, patterns = gap // size, open_.pop(gap)
            for times, content in patterns:
                full = min(times, need // fit)
                put(gap - fit * size, full, (content, size, fit))
                need -= full * fit
                part = need if full < times else 0
                if part:
                    put(gap - part * size, 1, (content, size, part))
                    need = 0
                put(gap, times - full - bool(part), content)
            if not need:
                break
        if need:
            fit = capacity // size
            put(capacity - fit * size, need // fit, (None, size, fit))
            if need % fit:
                put(capacity - need % fit * size, 1, (None, size, need % fit))
    runs, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    for patterns in open_.values():
        for times, content in patterns:
            parts = []
            while content:
                content, size, often = content
                parts.append((size, often))
            offset = 0
            for size, often in reversed(parts):
                runs.append((size, ranks[size], sequence, often, offset))
                ranks[size] += times * often
                offset += size * often
            sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored ``pieces`` with ``sequence_id`` and ``offset``; other columns stay.

    Pieces of a length are ranked in groups by a hash, with the groups' sizes
    summed up first, so a length that a third of all pieces have is no single
    group. Equal rows may trade places, which changes nothing.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packing(counts, capacity)
    groups = max(1, -(-max(counts.values(), default=0) // GROUP_ROWS))
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    key = ["length", "_group"]
    earlier = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        salted.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    )
    within = Window.partitionBy(key).orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_row", F.row_number().over(within))
        .join(firsts, key)
        .withColumn("_rank", F.col("_first") + F.col("_row") - 1)
        .select(*pieces.columns, "_rank")
    )
    begin = np.searchsorted(plan[:, 0], np.arange(capacity + 2))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            run = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                firsts_of = plan[begin[s] : begin[s + 1], 1]
                run[own] = begin[s] + np.searchsorted(firsts_of, rank[own], "right") - 1
            since, per = rank - plan[run, 1], plan[run, 3]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_rank"}
            columns["sequence_id"] = pa.array(plan[run, 2] + since // per)
            columns["offset"] = pa.array(plan[run, 4] + since % per * size)
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(find, f"{fields}, sequence_id long, `offset` long")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Documents to placed pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    An empty table gives no rows; columns of ``docs`` other than ``doc_id`` and
    ``text`` are ignored; a repeated row is packed as often as it occurs.
    Tokenising runs once: its result is stored before it is counted.
    """
    cut = token_pieces(docs, tokenizer_path, capacity, end_id, with_ids)
    return place(store(cut if with_ids else cut.drop("ids"), "pieces"), capacity)
