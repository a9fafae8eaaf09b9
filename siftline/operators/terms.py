"""Many terms searched in many texts at once, with one automaton per task.

The terms of a lexicon go into an automaton that walks a text once and reports
every term it meets, so the cost of a text does not depend on how many terms
there are. A lexicon may be a table; what reaches the tasks is of a checked
size, and a larger one is walked part by part.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.operators.lexicon import Term
from siftline.operators.lookup import BroadcastBound

#: Groups of one lexicon: their flags share a long.
MOST_GROUPS = 60
BAR = "|"

#: Beside letters and digits, these belong to a word; those end a segment.
WORD_MARKS = "+#"
SEGMENT_ENDS = "\n,;•|"


class Segmenter:
    """Texts as words with one blank between them and a bar between segments, in their own case.

    A word is letters, digits and ``WORD_MARKS``. A bar is no word character, so
    no term spans two segments. ASCII goes by one table; what else a text holds
    that is no letter is looked up once per character and task.
    """

    def __init__(self) -> None:
        table = bytearray(range(256))
        for code in range(128):
            if not (chr(code).isalnum() or chr(code) in WORD_MARKS):
                table[code] = ord(BAR) if chr(code) in SEGMENT_ENDS else ord(" ")
        self._ascii = bytes(table)
        self._known: dict[str, str | None] = {}

    def _stands_for(self, char: str) -> str | None:
        """What replaces a character beyond ASCII: nothing if it belongs to a word."""
        if char not in self._known:
            word = char < "\x80" or unicodedata.category(char)[0] in "LN"
            self._known[char] = None if word else BAR if char in SEGMENT_ENDS else " "
        return self._known[char]

    def __call__(self, text: str) -> str:
        if not text.isascii():
            for char in set(text):
                if other := self._stands_for(char):
                    text = text.replace(char, other)
        words = text.encode().translate(self._ascii).replace(b"|", b" | ").split()
        return f" {b' '.join(words).decode()} "


def needle(term: Term) -> str:
    """A term as it stands in segmented text: whole words, or the beginning of the last one."""
    text = term.text if term.case_sensitive else term.text.lower()
    return f" {text[:-1]}" if text.endswith("*") else f" {text} "


@dataclass(frozen=True)
class Lexicon:
    """Groups in the order of their flags, and needles with the flags of their groups."""

    groups: tuple[str, ...]
    own: dict[str, int]
    folded: dict[str, int]

    @classmethod
    def of(cls, terms: Iterable[Term], groups: Iterable[str] | None = None) -> Lexicon:
        terms = list(terms)
        names = tuple(dict.fromkeys(t.group for t in terms) if groups is None else groups)
        if len(names) > MOST_GROUPS:
            raise ValueError(f"{len(names)} groups; {MOST_GROUPS} is the limit")
        flags = {g: 1 << i for i, g in enumerate(names)}
        tables: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for term in terms:
            table = tables[not term.case_sensitive]
            table[needle(term)] = table.get(needle(term), 0) | flags[term.group]
        return cls(names, *tables)

    def mask(self, groups: Iterable[str]) -> int:
        """Flags of some groups; those the lexicon does not have count as never mentioned."""
        return sum(1 << self.groups.index(g) for g in groups if g in self.groups)


class Finder:
    """Flags of the groups that the segments of a text mention."""

    def __init__(self, lexicon: Lexicon):
        self.automata = _automaton(lexicon.own), _automaton(lexicon.folded)
        self.segmented = Segmenter()

    def texts(self, column: pa.Array) -> Iterator[tuple[str, str]]:
        """Texts of a column in segments, in their own case and folded; null is empty."""
        for text in column.to_pylist():
            own = self.segmented(text or "")
            yield own, own.lower()

    def segments(self, own: str, folded: str) -> dict[int, int]:
        """Flags by segment, for those that mention anything."""
        found: dict[int, int] = {}
        for automaton, text in zip(self.automata, (own, folded)):
            if automaton is None:
                continue
            at, stop = 0, text.find(BAR)
            for end, flags in automaton.iter(text):
                while -1 < stop < end:
                    at, stop = at + 1, text.find(BAR, stop + 1)
                found[at] = found.get(at, 0) | flags
        return found


def _automaton(needles: dict[str, int]):
    if not needles:
        return None
    automaton = ahocorasick.Automaton()
    for text, flags in needles.items():
        automaton.add_word(text, flags)
    automaton.make_automaton()
    return automaton


def lexicon_parts(
    table: DataFrame, groups: Iterable[str] | None = None, bound: BroadcastBound = BroadcastBound()
) -> list[Lexicon]:
    """A lexicon table (``group, text, case_sensitive``) in parts that each fit the bound; nulls are left out."""
    names = [F.col("group"), F.col("text"), F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive")]
    terms = table.select(*names).where("`group` IS NOT NULL AND trim(text) <> '' AND text <> '*'").distinct()
    size = terms.agg(F.sum(F.octet_length("text") + F.octet_length("group") + 64)).first()[0] or 0
    known = sorted(r[0] for r in terms.select("group").distinct().limit(MOST_GROUPS + 1).collect())
    parts = max(1, -(-size // bound.bytes))
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    return [
        Lexicon.of((Term(*r) for r in terms.where(part == p).collect()), known if groups is None else groups)
        for p in range(parts)
    ]


#: Segments that mention one of the first groups and none of the second.
Condition = tuple[tuple[str, ...], tuple[str, ...]]


def post_flags(
    posts: DataFrame,
    lexicon: Lexicon | list[Lexicon],
    conditions: tuple[Condition, ...] = (),
    extra: Callable[[str], tuple[str, ...]] | None = None,
) -> DataFrame:
    """``channel_id, msg_id, flags, held``: groups that a post mentions, and conditions a segment of it meets.

    ``posts`` has ``channel_id, msg_id, message``. ``extra`` names more groups for
    a text in lower case as a whole. A lexicon in several parts gives the same
    result; segments of a post then meet by a shuffle.
    """
    parts = [lexicon] if isinstance(lexicon, Lexicon) else lexicon
    mask = parts[0].mask
    wanted = [(mask(some), mask(none)) for some, none in conditions]
    texts = posts.select("channel_id", "msg_id", "message")
    kinds = dict(posts.dtypes)
    keys = f"channel_id {kinds['channel_id']}, msg_id {kinds['msg_id']}"
    if len(parts) > 1:
        return _from_parts(texts, parts, wanted, extra, keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(parts[0])
        for batch in batches:
            flags, held = [], []
            for text, low in finder.texts(batch.column("message")):
                found = set(finder.segments(text, low).values())
                all_, met = 0, 0
                for f in found:
                    all_ |= f
                for i, (some, none) in enumerate(wanted):
                    if any(f & some and not f & none for f in found):
                        met |= 1 << i
                flags.append(all_ | mask(extra(low)) if extra else all_)
                held.append(met)
            yield _batch(batch, flags, held)

    return texts.mapInArrow(find, f"{keys}, flags bigint, held bigint")


def _batch(batch: pa.RecordBatch, flags: list[int], held: list[int]) -> pa.RecordBatch:
    columns = [batch.column("channel_id"), batch.column("msg_id"), pa.array(flags, pa.int64()), pa.array(held, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["channel_id", "msg_id", "flags", "held"])


def _from_parts(texts: DataFrame, parts: list[Lexicon], wanted: list[tuple[int, int]], extra, keys: str) -> DataFrame:
    """One pass per part gives flags per segment; what belongs to no segment has the place -1."""

    def pass_(lexicon: Lexicon, more) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(lexicon)
            for batch in batches:
                rows, places, flags = [], [], []
                for row, (text, low) in enumerate(finder.texts(batch.column("message"))):
                    found = finder.segments(text, low)
                    found[-1] = lexicon.mask(more(low)) if more else 0
                    rows.extend([row] * len(found))
                    places.extend(found)
                    flags.extend(found.values())
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("channel_id").take(at), batch.column("msg_id").take(at), pa.array(places, pa.int32()), pa.array(flags, pa.int64())],
                    names=["channel_id", "msg_id", "place", "flags"],
                )

        return texts.mapInArrow(find, f"{keys}, place int, flags bigint")

    found = pass_(parts[0], extra)
    for lexicon in parts[1:]:
        found = found.unionAll(pass_(lexicon, None))
    segments = found.groupBy("channel_id", "msg_id", "place").agg(F.bit_or("flags").alias("flags"))
    flags, met = F.col("flags"), F.lit(0).cast("bigint")
    for i, (some, none) in enumerate(wanted):
        holds = (F.col("place") >= 0) & (flags.bitwiseAND(some) != 0) & (flags.bitwiseAND(none) == 0)
        met = met.bitwiseOR(F.when(holds, 1 << i).otherwise(0))
    return segments.groupBy("channel_id", "msg_id").agg(F.bit_or("flags").alias("flags"), F.bit_or(met).alias("held"))
