"""Model replies to typed verdicts, as native column expressions.

Patterns use possessive loops and line-bound prefixes, so one pass over a
reply of any length is linear. Flags: i and u for case-insensitive matching
of every script, m for line anchors, d so that only a line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from siftline import constants as K
from siftline.functions.scalars import model_family
from siftline.functions.text import is_blank, utrim

_WS = r"[\t\n\f\r ]"
_LEAD = r"(?iumd)^[\t\f\r >*\-]*+"
_ANSWERS = "|".join(K.YES_WORDS + K.NO_WORDS)
MATCH_LINE = rf'{_LEAD}MATCH{_WS}*+[:=]{_WS}*+"?+({_ANSWERS})'
REASON_LINE = rf"{_LEAD}REASON{_WS}*+[:=]{_WS}*+([^\n]*+)"
ECHO = (
    "(?iud)" + "|".join(K.ECHO_PHRASES) + r"|\A(?:" + "|".join(K.ECHO_WORDS) + r")\.?\z"
)

# One object without nested braces, starting at the first brace of the text.
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
FLAT_OBJECT = rf'(?s)\A[^{{]*+(\{{(?:[^{{}}"]++|{_QUOTED})*+\}})'
# Pieces of a text: quoted strings (the last may be open), braces, the rest.
PIECES = rf'(?s){_QUOTED}?|[{{}}]|[^{{}}"]++'

_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` for ``body``: evaluated once, however often it is used."""
    return F.transform(F.array(value), body).getItem(0)


def response_text(parts: Column) -> Column:
    """Struct ``(text, error)`` from the parts of the first candidate.

    Null parts mean no candidate, an empty list means no content.
    """
    joined = F.array_join(
        F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["text"]), ""
    )

    def checked(text: Column) -> Column:
        error = (
            F.when(parts.isNull(), K.ERR_EMPTY_RESPONSE)
            .when(F.size(parts) == 0, K.ERR_NO_CONTENT)
            .when(is_blank(text), K.ERR_NO_TEXT)
        )
        return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))

    return _let(joined, checked)


def has_echo(reason: Column) -> Column:
    """The reason repeats the prompt: ``<...>``, a prompt phrase or a filler word."""
    opened = F.instr(reason, "<")
    return (
        (opened > 0) & (F.locate(">", F.substr(reason, F.greatest(opened, F.lit(1)))) > 0)
    ) | reason.rlike(ECHO)


def two_line_verdict(raw: Column) -> Column:
    """Struct ``(match, reason, error)`` from ``MATCH:`` and ``REASON:`` lines."""
    found = F.struct(
        F.lower(F.regexp_extract(raw, MATCH_LINE, 1)).alias("answer"),
        F.btrim(utrim(F.regexp_extract(raw, REASON_LINE, 1)), F.lit(K.QUOTE_MARKS)).alias("reason"),
    )

    def judged(line: Column) -> Column:
        match = line["answer"].isin(*K.YES_WORDS)
        error = F.when(line["answer"] == "", K.ERR_NO_MATCH_LINE).when(
            match & has_echo(line["reason"]), K.ERR_TEMPLATE_ECHO
        )
        return _verdict(match, line["reason"], error)

    return _let(found, judged)


def _closing_piece(pieces: Column) -> Column:
    """Number of the piece that closes the first brace, 0 if none does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("closed"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        seen = acc["seen"] + F.lit(1)
        closes = (acc["closed"] == 0) & (piece == "}") & (depth == 0)
        closed = F.when(closes, seen).otherwise(acc["closed"])
        return F.struct(depth.alias("depth"), seen.alias("seen"), closed.alias("closed"))

    return F.aggregate(pieces, start, step, lambda acc: acc["closed"])


def _nested_object(text: Column) -> Column:
    rest = F.substr(text, F.greatest(F.instr(text, "{"), F.lit(1)))
    return _let(
        F.regexp_extract_all(rest, F.lit(PIECES), F.lit(0)),
        lambda pieces: _let(
            _closing_piece(pieces),
            lambda closed: F.when(closed > 0, F.array_join(F.slice(pieces, 1, closed), "")),
        ),
    )


def first_object(text: Column) -> Column:
    """Struct ``(span, error)``: the first balanced ``{...}`` of the text.

    Braces inside quoted strings do not count. Flat objects, the usual case,
    take one pattern match; nested ones sum the depth over the text's pieces.
    """
    flat = F.regexp_extract(text, FLAT_OBJECT, 1)
    found = _let(flat, lambda span: F.when(span != "", span).otherwise(_nested_object(text)))
    opened = F.instr(text, "{") > 0
    return _let(
        F.when(opened, found),
        lambda span: F.struct(
            span.alias("span"),
            F.when(span.isNotNull(), F.lit(None))
            .when(opened, K.ERR_UNBALANCED_JSON)
            .otherwise(K.ERR_NO_JSON_OBJECT)
            .alias("error"),
        ),
    )


def decode_object(span: Column) -> Column:
    """Struct ``(match, reason, error)`` from one JSON object.

    Keys match in any case and in document order: the last typed value wins,
    null leaves a field as it is, and one wrong type spoils the reply.
    """
    members = F.transform(
        F.map_entries(F.from_json(span, "MAP<STRING, VARIANT>", _JSON_OPTIONS)),
        lambda e: F.struct(
            F.when(e["key"].rlike(r"(?iu)\Amatch\z"), "match")
            .when(e["key"].rlike(r"(?iu)\Areason\z"), "reason")
            .alias("field"),
            F.schema_of_variant(e["value"]).alias("type"),
            F.try_variant_get(e["value"], "$", "string").alias("text"),
        ),
    )

    def wrong(e: Column) -> Column:
        return ((e["field"] == "match") & ~e["type"].isin("BOOLEAN", "VOID")) | (
            (e["field"] == "reason") & ~e["type"].isin("STRING", "VOID")
        )

    def decoded(entries: Column) -> Column:
        def last(field: str, kind: str) -> Column:
            typed = F.filter(entries, lambda e: (e["field"] == field) & (e["type"] == kind))
            return F.try_element_at(typed, F.lit(-1))["text"]

        error = F.when(entries.isNull() | F.exists(entries, wrong), K.ERR_DECODE)
        return _verdict(last("match", "BOOLEAN") == "true", last("reason", "STRING"), error)

    return _let(members, decoded)


def json_verdict(raw: Column) -> Column:
    return _let(
        first_object(raw),
        lambda found: F.when(found["span"].isNotNull(), decode_object(found["span"])).otherwise(
            _failed(found["error"])
        ),
    )


def reply_verdict(model: Column, raw: Column, call_error: Column) -> Column:
    """Verdict of one reply by model family; every failure becomes an error class."""
    return (
        F.when(call_error.isNotNull(), _failed(call_error))
        .when(raw.isNull(), _failed(F.lit(K.ERR_EMPTY_RESPONSE)))
        .when(is_blank(raw), _failed(F.lit(K.ERR_NO_TEXT)))
        .when(model_family(model) == "text", two_line_verdict(raw))
        .otherwise(json_verdict(raw))
    )


def parse_replies(replies: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Replies to ``match``, ``reason`` and ``error``; a bad row never fails the job.

    The raw reply and its call log are left out unless named in ``keep``.

    The verdict comes out of a one-element ``inline``. Filters on its fields
    stay above it, so each reply is parsed once, not again for every filter.
    """
    # A key repeated below the top level is not an error of the reply.
    replies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    call_error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    verdict = reply_verdict(F.col("model"), F.col("raw"), call_error)
    dropped = {"raw", "calls"} - set(keep) | {"error"}
    kept = [c for c in replies.columns if c not in dropped]
    return replies.select(*kept, F.inline(F.array(verdict)))


def _failed(error: Column) -> Column:
    return F.struct(
        F.lit(None).cast("boolean").alias("match"),
        F.lit(None).cast("string").alias("reason"),
        error.cast("string").alias("error"),
    )


def _verdict(match: Column, reason: Column, error: Column) -> Column:
    """Match and reason are null exactly where there is an error."""

    def fields(found: Column) -> Column:
        return F.when(found.isNotNull(), _failed(found)).otherwise(
            F.struct(
                F.coalesce(match, F.lit(False)).alias("match"),
                F.coalesce(reason, F.lit("")).alias("reason"),
                F.lit(None).cast("string").alias("error"),
            )
        )

    return _let(error.cast("string"), fields)
