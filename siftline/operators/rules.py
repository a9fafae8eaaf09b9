"""The screening rules as a lexical job: features, first trigger and verdict.

A stand-in for the model, not its equal. All work is local to the post: posts
are cut into segments (lines and list items), each reduced to its words with
blanks around them, and one automaton finds all terms of the lexicon in one
walk over them. The lexicon is a list of terms or a table of any length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftline.operators import lexicon as L
from siftline.operators.lexicon import DEFAULT_LEXICON, Term
from siftline.operators.lookup import BroadcastBound
from siftline.operators.terms import Lexicon, lexicon_parts, post_flags

REJECTIONS = ("R-A", "R-B", "R-C", "R-D", "R-E", "R-F")
INCLUSIONS = ("I-1", "I-2", "I-3")

#: Segments that speak of an engineer and of no other role; that speak of Go and not as a bonus.
ENGINEER_SEGMENT = ((L.ROLE_ENGINEER, L.GO), (L.ROLE_OTHER,))
PLAIN_GO_SEGMENT = ((L.GO,), (L.BONUS,))


def years_asked() -> Callable[[str], tuple[str, ...]]:
    """Names the group of years for segmented text in lower case that asks for ``YEARS_FROM`` of them or more."""
    forms = [re.compile(form) for form in L.YEARS_FORMS]
    words, least, group = L.YEARS_WORDS, L.YEARS_FROM, (L.YEARS,)

    def asked(folded: str) -> tuple[str, ...]:
        if any(w in folded for w in words) and any(int(n) >= least for f in forms for n in f.findall(folded)):
            return group
        return ()

    return asked


def _lexicon(
    lexicon: Iterable[Term] | DataFrame, groups: Iterable[str] | None, bound: BroadcastBound
) -> Lexicon | list[Lexicon]:
    return lexicon_parts(lexicon, groups, bound) if isinstance(lexicon, DataFrame) else Lexicon.of(lexicon, groups)


def _mentions(lexicon: Lexicon | list[Lexicon], group: str) -> Column:
    one = lexicon if isinstance(lexicon, Lexicon) else lexicon[0]
    return F.col("flags").bitwiseAND(one.mask([group])) != 0


def rule_hits(
    posts: DataFrame, lexicon: Iterable[Term] | DataFrame, bound: BroadcastBound = BroadcastBound()
) -> DataFrame:
    """One row per post and lexicon group that the post mentions."""
    known = _lexicon(lexicon, None, bound)
    groups = (known if isinstance(known, Lexicon) else known[0]).groups
    flagged = post_flags(posts, known, extra=years_asked() if L.YEARS in groups else None)
    names = F.array_compact(F.array(*(F.when(_mentions(known, g), g) for g in groups)))
    return flagged.select("channel_id", "msg_id", F.explode(names.cast("array<string>")).alias("rule_id"))


def rule_screen(
    posts: DataFrame,
    lexicon: Iterable[Term] | DataFrame = DEFAULT_LEXICON,
    bound: BroadcastBound = BroadcastBound(),
) -> DataFrame:
    """Per post: ``first_trigger`` (null if none fired), the inclusion checks, ``match``.

    Roles and bonus phrases are judged per segment, so a post with several
    roles passes when one of them does; the rest looks at the whole post. The
    inclusion checks are null for rejected posts, since the rules do not reach
    them. Terms of other groups than the rules have are ignored.
    """
    if isinstance(lexicon, DataFrame):
        lexicon = lexicon.where(F.col("group").isin(*L.GROUPS))
    known = _lexicon(lexicon, L.GROUPS, bound)
    flagged = post_flags(posts, known, (ENGINEER_SEGMENT, PLAIN_GO_SEGMENT), years_asked())
    f = {g: _mentions(known, g) for g in L.GROUPS}
    engineer_segment, plain_go_segment = (F.col("held").bitwiseAND(1 << i) != 0 for i in (0, 1))
    bonus_only = f[L.BONUS] & f[L.OTHER_LANGUAGE] & f[L.GO] & ~plain_go_segment
    rejected = {
        "R-A": f[L.ROLE_OTHER] & ~engineer_segment,
        "R-B": ~f[L.GO],
        "R-C": bonus_only,
        "R-D": (f[L.SENIOR] & ~f[L.JUNIOR]) | f[L.YEARS],
        "R-E": f[L.OTHER_CITY] & ~f[L.ASTANA] & ~f[L.REMOTE],
        "R-F": f[L.NOT_VACANCY] & ~f[L.ROLE_ENGINEER],
    }
    included = {
        "I-1": f[L.JUNIOR] | ~f[L.SENIOR],
        "I-2": f[L.GO] & ~bonus_only,
        "I-3": f[L.REMOTE]
        | f[L.ASTANA]
        | (f[L.KAZAKHSTAN] & ~f[L.OTHER_CITY])
        | ~(f[L.KAZAKHSTAN] | f[L.OTHER_CITY]),
    }
    passed = F.col("first_trigger").isNull()
    names = [r.replace("-", "").lower() for r in INCLUSIONS]
    checks = [F.when(passed, included[r]).alias(n) for r, n in zip(INCLUSIONS, names)]
    judged = flagged.withColumn(
        "first_trigger", F.coalesce(*(F.when(rejected[r], r) for r in REJECTIONS))
    ).select("channel_id", "msg_id", "first_trigger", *checks)
    match = reduce(lambda a, b: a & b, (F.col(n) for n in names))
    return judged.withColumn("match", F.coalesce(match, F.lit(False)))
