"""Scalar functions over ids, links, settings and destinations."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from siftline import constants as K
from siftline.functions.text import excerpt, is_blank, utrim


def normalize_channel_id(channel_id: Column) -> Column:
    """Marked form ``-100<digits>`` to the plain id; other negatives by sign.

    A bare ``-100`` has no digits left, so it only loses its sign.
    """
    digits = channel_id.cast("string")
    return F.when(
        digits.rlike(r"^-100[0-9]+$"), F.substr(digits, F.lit(5)).cast("bigint")
    ).otherwise(F.abs(channel_id))


def post_link(username: Column, channel_id: Column, msg_id: Column) -> Column:
    public = F.coalesce(username, F.lit("")) != ""
    return F.when(
        public, F.concat(F.lit(K.LINK_HOST), username, F.lit("/"), msg_id.cast("string"))
    ).otherwise(
        F.concat(
            F.lit(K.LINK_PRIVATE), channel_id.cast("string"), F.lit("/"), msg_id.cast("string")
        )
    )


def display_name(title: Column, username: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), username, F.lit(""))


def notification_text(
    title: Column, username: Column, reason: Column, message: Column, link: Column
) -> Column:
    """Header and channel, then reason and excerpt where not blank, then link."""
    excerpted = excerpt(message)
    return F.concat(
        F.lit(K.NOTE_HEADER),
        display_name(title, username),
        F.when(is_blank(reason), F.lit("")).otherwise(
            F.concat(F.lit(K.NOTE_REASON), utrim(reason))
        ),
        F.when(is_blank(message), F.lit("")).otherwise(
            F.concat(F.lit(K.NOTE_EXCERPT), excerpted)
        ),
        F.lit(K.NOTE_LINK),
        link,
    )


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def model_family(model: Column) -> Column:
    """``text`` for two-line models, ``json`` for every other name."""
    return F.when(F.lower(model).startswith(K.TEXT_FAMILY_PREFIX), "text").otherwise("json")


def parse_since(text: Column) -> Column:
    """Strict ``YYYY-MM-DD``. Blank is null (no sweep); anything else fails the job."""
    clean = utrim(text)
    day = F.when(
        clean.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(clean, "yyyy-MM-dd")
    )
    return F.when(is_blank(text), F.lit(None).cast("date")).otherwise(
        F.coalesce(
            day,
            F.raise_error(F.concat(F.lit("since must be YYYY-MM-DD: "), clean)).cast("date"),
        )
    )


def since_key(ts: Column) -> Column:
    """UTC day of a zone-less UTC timestamp, as text."""
    return ts.cast("date").cast("string")


def nonneg_int_or(text: Column, default: int) -> Column:
    """Whole number >= 0, else the default. Zero is kept: it means off."""
    clean = utrim(text)
    value = F.when(clean.rlike(r"\A[+-]?[0-9]+\z"), clean.try_cast("bigint"))
    return F.when(value >= 0, value).otherwise(F.lit(default).cast("bigint"))


def _invite_pattern() -> str:
    """Optional prefixes, once each and in list order, then the invite mark."""
    prefixes = (*K.DESTINATION_SCHEMES, K.DESTINATION_WWW, *K.DESTINATION_HOSTS)
    optional = "".join(rf"(?:{re.escape(p)})?+" for p in prefixes)
    return rf"(?s)\A{optional}(?:{re.escape(K.INVITE_PLUS)}|{re.escape(K.INVITE_JOIN)})(.+)\z"


def destination_class(text: Column) -> Column:
    """Struct ``(kind, value)``: self, invite with its hash, or username."""
    name = F.regexp_replace(utrim(text), r"\A@", "")
    code = F.regexp_extract(utrim(name), _invite_pattern(), 1)
    own = F.lower(name).isin(*K.SELF_DESTINATIONS)
    kind = F.when(own, "self").when(code != "", "invite").otherwise("username")
    value = F.when(own, "").when(code != "", code).otherwise(name)
    return F.struct(kind.alias("kind"), value.alias("value"))
