"""Text helpers as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from siftline import constants as K


def utrim(text: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` strips blanks only)."""
    return F.btrim(text, F.lit(K.WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.ltrim(text, F.lit(K.WHITE_SPACE)) == "", F.lit(True))


def excerpt(text: Column, limit: int = K.EXCERPT_CHARS) -> Column:
    """First ``limit`` code points of the trimmed text, marked when shortened."""
    clean = utrim(text)
    return F.when(
        F.char_length(clean) > limit,
        F.concat(F.left(clean, F.lit(limit)), F.lit(K.ELLIPSIS)),
    ).otherwise(clean)


def diag_truncate(text: Column, limit: int = K.DIAGNOSTIC_BYTES) -> Column:
    """At most ``limit`` bytes, then a mark.

    The cut moves back to the last whole character (at most three bytes), so
    the result stays valid UTF-8.
    """
    raw = text.cast("binary")
    heads = [
        F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string"))
        for back in range(min(4, limit + 1))
    ]
    return F.when(
        F.octet_length(text) > limit, F.concat(F.coalesce(*heads), F.lit(K.ELLIPSIS))
    ).otherwise(text)


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))
