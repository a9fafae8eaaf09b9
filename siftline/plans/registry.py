"""Every operator as a query over the given tables, with its SQL twin where one exists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftline import constants as K
from siftline.functions import prompts as P
from siftline.functions import replies as R
from siftline.functions import scalars as S
from siftline.functions.quota import is_quota_error, retry_wait_us
from siftline.functions.text import diag_truncate, excerpt, utrim
from siftline.operators import matches as M
from siftline.operators import reports as G
from siftline.operators import screen as C
from siftline.operators import verdicts as V
from siftline.operators.lexicon import Term
from siftline.operators.quota import MINUTE_US, quota_schedule, retry_plan
from siftline.operators.rules import rule_hits, rule_screen
from siftline.operators.scoring import CallFailed, CallPolicy, call_log, score_posts
from siftline.operators.terms import needle
from siftline.params import ScreeningParams, SinkPaths
from siftline.plans import tables as T
from siftline.plans.backfill import backfill, sweep_verdicts
from siftline.session import scratch_path
from siftline.sinks.tables import read_match_log, read_outbox, write_match_log, write_part
from siftline.sources.channels import read_channels, watch_ids
from siftline.sources.posts import (
    parse_posts,
    read_history,
    read_live,
    read_live_json,
    write_posts_by_day,
)
from siftline.sources.progress import SweepState
from siftline.streaming.live import live_posts, malformed_table, start_live
from siftline.streaming.retries import settle, start_retries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SINCE = dt.datetime(2024, 1, 2)
UNTIL = dt.datetime(2024, 1, 3)
LOG_TIME = "2024-02-01 00:00:00"
DESTINATION = "me"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- SQL pieces -----------------------------------------------------------

SPACE = quoted(K.WHITE_SPACE)
RANGE = "date >= TIMESTAMP '2024-01-02' AND date < TIMESTAMP '2024-01-03'"
RESOLVED_SQL = f"""SELECT c.* FROM ({T.CHANNELS_SQL}) AS c
  WHERE NOT "left" AND channel_id IN ({T.WATCH_SQL})"""
LINK = """CASE WHEN coalesce(username, '') <> ''
  THEN 'https://t.me/' || username || '/' || msg_id
  ELSE 'https://t.me/c/' || channel_id || '/' || msg_id END"""


def trimmed(text: str) -> str:
    return f"trim({text}, {SPACE})"


def excerpted(text: str, limit: int = K.EXCERPT_CHARS) -> str:
    clean = trimmed(text)
    return (
        f"CASE WHEN length({clean}) > {limit} THEN left({clean}, {limit}) || '…' ELSE {clean} END"
    )


def note(message: str) -> str:
    return f"""{quoted(K.NOTE_HEADER)} || coalesce(nullif(title, ''), username, '')
      || CASE WHEN {trimmed('reason')} = '' THEN '' ELSE {quoted(K.NOTE_REASON)} || {trimmed('reason')} END
      || CASE WHEN {trimmed(message)} = '' THEN ''
         ELSE {quoted(K.NOTE_EXCERPT)} || ({excerpted(message)}) END
      || {quoted(K.NOTE_LINK)} || ({LINK})"""


def spans(source: str, keys: str, text: str) -> str:
    """First balanced object of ``text`` per row of ``source``."""
    pieces = """regexp_extract_all(substr(body, greatest(instr(body, '{'), 1)),
      '"(?:[^"\\\\]|\\\\.)*"?|[{}]|[^{}"]+', 0, 's')"""
    return f"""SELECT * EXCLUDE (pieces, closed, rid),
        CASE WHEN instr(body, '{{') > 0 AND closed IS NOT NULL
          THEN array_to_string(pieces[1:closed], '') END AS span
      FROM (SELECT row_number() OVER (ORDER BY {keys}) AS rid, *, {text} AS body,
              {pieces.replace('body', text)} AS pieces FROM ({source}) AS s0) AS s1
      LEFT JOIN (
        SELECT rid, min(i) FILTER (WHERE piece = '}}' AND depth = 0) AS closed FROM (
          SELECT rid, i, piece, sum(CASE piece WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END)
              OVER (PARTITION BY rid ORDER BY i) AS depth
          FROM (SELECT rid, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
                FROM (SELECT row_number() OVER (ORDER BY {keys}) AS rid,
                        {pieces.replace('body', text)} AS pieces FROM ({source}) AS s2) AS s3
               ) AS s4) AS s5
        GROUP BY rid) AS s6 USING (rid)"""


_TWO_LINE = r"""
  SELECT channel_id, msg_id, model,
    lower(regexp_extract(raw, '(?im)^[\s>*\-]*MATCH\s*[:=]\s*"?(yes|no|true|false|да|нет)"?', 1)) AS answer,
    trim({reason_line}, '"''`') AS said
  FROM ({replies}) AS r WHERE {where}"""


def two_line_sql(where: str) -> str:
    reason_line = trimmed(
        r"regexp_extract(raw, '(?im)^[\s>*\-]*REASON\s*[:=]\s*(.+?)\s*$', 1)"
    )
    inner = _TWO_LINE.format(reason_line=reason_line, replies=T.REPLIES_SQL, where=where)
    return rf"""SELECT channel_id, msg_id, model,
      CASE WHEN error IS NULL THEN yes END AS "match",
      CASE WHEN error IS NULL THEN said END AS reason, error
    FROM (SELECT *, CASE WHEN answer = '' THEN 'no_match_line'
        WHEN yes AND regexp_matches(said, '(?i)<[^>]*>|short russian sentence|max 140 chars|short sentence in russian, 140 characters at most|with the actual reason|^(?:string|reason|placeholder|tbd|n/a)\.?$')
        THEN 'template_echo' END AS error
      FROM (SELECT *, answer IN ('yes', 'true', 'да') AS yes FROM ({inner}) AS a) AS b) AS c"""


JSON_WHERE = f"NOT starts_with(lower(model), 'gemma') AND error IS NULL AND {trimmed('raw')} <> ''"
TEXT_WHERE = f"starts_with(lower(model), 'gemma') AND error IS NULL AND {trimmed('raw')} <> ''"


def json_sql(where: str) -> str:
    source = f"SELECT channel_id, msg_id, model, raw FROM ({T.REPLIES_SQL}) AS r WHERE {where}"
    return f"""SELECT channel_id, msg_id, model,
      CASE WHEN error IS NULL THEN coalesce(m = 'true', false) END AS "match",
      CASE WHEN error IS NULL THEN coalesce(json_extract_string(span, '$.reason'),
        json_extract_string(span, '$.REASON'), '') END AS reason, error
    FROM (SELECT *, CASE WHEN instr(raw, '{{') = 0 THEN 'no_json_object'
        WHEN span IS NULL THEN 'unbalanced_json'
        WHEN NOT json_valid(span) OR coalesce(mt, 'NULL') NOT IN ('BOOLEAN', 'NULL')
          OR coalesce(rt, 'NULL') NOT IN ('VARCHAR', 'NULL') THEN 'decode_error' END AS error
      FROM (SELECT *, coalesce(json_extract_string(span, '$.match'), json_extract_string(span, '$.Match')) AS m,
          coalesce(json_type(span, '$.match'), json_type(span, '$.Match')) AS mt,
          coalesce(json_type(span, '$.reason'), json_type(span, '$.REASON')) AS rt
        FROM ({spans(source, 'channel_id, msg_id', 'raw')}) AS a) AS b) AS c"""


EARLY_SQL = f"""SELECT channel_id, msg_id, model, CAST(NULL AS BOOLEAN) AS "match",
    CAST(NULL AS VARCHAR) AS reason, CASE WHEN error IS NOT NULL THEN error
      WHEN raw IS NULL THEN 'empty_response' ELSE 'no_text' END AS error
  FROM ({T.REPLIES_SQL}) AS r
  WHERE error IS NOT NULL OR raw IS NULL OR {trimmed('raw')} = ''"""
VERDICTS_SQL = (
    f"{two_line_sql(TEXT_WHERE)} UNION ALL {json_sql(JSON_WHERE)} UNION ALL {EARLY_SQL}"
)


def log_sql(matched: str, source: str) -> str:
    """Log columns of rows with channel_id, msg_id, reason and resolved names."""
    return f"""SELECT TIMESTAMP '{LOG_TIME}' AS "time", channel_id, title AS channel, msg_id,
      reason, {LINK} AS link, '{source}' AS source FROM ({matched}) AS m"""


def as_text(frame: DataFrame, *columns: str) -> DataFrame:
    """Nullable flags and dates as text, which both engines print alike."""
    return frame.withColumns({c: F.col(c).cast("string") for c in columns})


def as_text_sql(sql: str, *columns: str) -> str:
    casts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS plain"


# --- Sources, watch list, filters -------------------------------------------


@query(
    """SELECT DISTINCT id AS channel_id FROM (
      SELECT unnest([o_custkey,
        CASE WHEN starts_with(CAST(o_orderkey AS VARCHAR), '100') AND o_orderkey >= 1000
          THEN CAST(substr(CAST(o_orderkey AS VARCHAR), 4) AS BIGINT) ELSE o_orderkey END]) AS id
      FROM orders) AS o"""
)
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comma list per order, with marked ids, blanks and repeats."""
    customer, order = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    csv = F.concat(
        F.lit(" -100"), customer, F.lit(",\t"), customer, F.lit(",, -"), order, F.lit("\n")
    )
    return watch_ids(T.table(spark, sf_dir, "orders").select(csv.alias("csv")))


@query(
    f"""SELECT channel_id, msg_id, kind, peer_kind FROM ({T.POSTS_SQL}) AS p
    WHERE kind = 'message' AND peer_kind = 'channel' AND channel_id IN ({T.WATCH_SQL})"""
)
def posts_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F3, J1."""
    kept = C.channel_peer_only(C.ordinary_only(T.narrow_posts(spark, sf_dir)))
    return C.watched_only(kept, T.watch(spark, sf_dir)).select(
        "channel_id", "msg_id", "kind", "peer_kind"
    )


@query(
    f"""SELECT page_id, {trimmed("chr(160) || ' ' || html || chr(8195) || chr(10)")} AS body
    FROM pages"""
)
def trimmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    padded = F.concat(F.lit("\xa0 "), F.col("html"), F.lit(" \n"))
    return T.table(spark, sf_dir, "pages").select("page_id", utrim(padded).alias("body"))


@query(
    f"""SELECT conv_id, turn, text FROM (
      SELECT conv_id, turn, CASE WHEN role = 'system' THEN chr(8195) || chr(10) ELSE text END AS text
      FROM conversations) AS c WHERE {trimmed('text')} <> ''"""
)
def non_blank_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns of the system role are blanked, then dropped."""
    text = F.when(F.col("role") == "system", " \n").otherwise(F.col("text"))
    turns = T.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.alias("message")
    )
    return C.non_blank(turns).withColumnRenamed("message", "text")


@query(
    f"""SELECT channel_id, msg_id, date, message FROM ({T.POSTS_SQL}) AS p
    WHERE kind = 'message' AND {RANGE}"""
)
def history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, F6."""
    kept = C.date_range(C.ordinary_only(T.updates(spark, sf_dir)), SINCE, UNTIL)
    return T.texts(spark, sf_dir).join(kept, "msg_id").select(
        "channel_id", "msg_id", "date", "message"
    )


@query(
    f"""SELECT channel_id, msg_id, date, message FROM ({T.POSTS_SQL}) AS p
    WHERE kind = 'message' AND {RANGE}"""
)
def history_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts stored by day, the range read back."""
    path = scratch_path(spark, "by-day")
    write_posts_by_day(T.posts(spark, sf_dir), path)
    kept = read_history(spark, path, SINCE, UNTIL)
    return kept.select("channel_id", "msg_id", "date", "message")


@query(
    f"""SELECT channel_id, msg_id, date FROM ({T.POSTS_SQL}) AS p
    WHERE date_trunc('second', date) >= TIMESTAMP '2024-01-02' - INTERVAL 900 SECOND"""
)
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age against a fixed processing time."""
    posts = T.narrow_posts(spark, sf_dir)
    return C.max_age(posts, C.ntz(SINCE), K.DEFAULT_MAX_AGE_S).select(
        "channel_id", "msg_id", "date"
    )


@query(
    f"""SELECT p.channel_id, p.msg_id FROM ({T.TEXTS_SQL}) AS p
    LEFT JOIN ({T.MARKS_SQL}) AS m ON p.channel_id = m.channel_id
    WHERE p.msg_id > coalesce(last_msg_id, 0)"""
)
def after_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    keys = T.texts(spark, sf_dir).select("channel_id", "msg_id")
    return C.after_high_water(keys, T.marks(spark, sf_dir))


@query(
    f"""SELECT 'history' AS side, channel_id, msg_id, date FROM ({T.POSTS_SQL}) AS p
    WHERE date < TIMESTAMP '2024-01-02'
    UNION ALL SELECT 'live', channel_id, msg_id, date FROM ({T.POSTS_SQL}) AS p
    WHERE date >= TIMESTAMP '2024-01-02'"""
)
def cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass, each post on exactly one side."""
    side = F.when(C.before_cutover(SINCE), "history").otherwise("live")
    return T.narrow_posts(spark, sf_dir).select(
        side.alias("side"), "channel_id", "msg_id", "date"
    )


@query(
    f"""SELECT channel_id, msg_id, row_number() OVER (PARTITION BY channel_id ORDER BY msg_id) AS place
    FROM ({T.TEXTS_SQL}) AS t"""
)
def oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: each post's place in its channel, from where the operator puts it."""
    return C.places(T.texts(spark, sf_dir))


# --- Channel dimension ---------------------------------------------------------


@query(f"SELECT * FROM ({T.CHANNELS_SQL}) AS c WHERE channel_id IN ({T.WATCH_SQL})")
def account_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the stored channels, those of the watch list."""
    path = scratch_path(spark, "channels")
    T.channels(spark, sf_dir).write.parquet(path)
    return read_channels(spark, path, T.watch(spark, sf_dir))


@query(RESOLVED_SQL)
def channels_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, J2, F9."""
    return C.resolve_channels(T.watch(spark, sf_dir), T.channels(spark, sf_dir))


@query(
    f"""SELECT channel_id FROM ({T.WATCH_SQL}) AS w
    WHERE channel_id NOT IN (SELECT channel_id FROM ({RESOLVED_SQL}) AS r)"""
)
def channels_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return C.missing_channels(T.watch(spark, sf_dir), T.channels(spark, sf_dir))


@query(
    f"""SELECT (SELECT count(*) FROM ({T.WATCH_SQL}) AS w) AS watched,
      (SELECT count(*) FROM ({T.WATCH_SQL}) AS w WHERE channel_id NOT IN
        (SELECT channel_id FROM ({RESOLVED_SQL}) AS r)) AS missing"""
)
def watch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    watch = T.watch(spark, sf_dir)
    return G.watch_coverage(watch, C.missing_channels(watch, T.channels(spark, sf_dir)))


@query(
    f"""SELECT channel_id, msg_id, title, username, date FROM ({T.POSTS_SQL}) AS p
    JOIN ({RESOLVED_SQL}) AS r USING (channel_id) WHERE kind = 'message' AND {RANGE}"""
)
def resolved_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    kept = C.date_range(C.ordinary_only(T.updates(spark, sf_dir)), SINCE, UNTIL)
    history = T.texts(spark, sf_dir).select("channel_id", "msg_id").join(kept, "msg_id")
    resolved = C.resolve_channels(T.watch(spark, sf_dir), T.channels(spark, sf_dir))
    return C.resolved_history(history, resolved).select(
        "channel_id", "msg_id", "title", "username", "date"
    )


@query(
    f"""SELECT channel_id, coalesce(nullif(title, ''), username, '') AS name
    FROM ({T.CHANNELS_SQL}) AS c"""
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    return T.channels(spark, sf_dir).select(
        "channel_id", S.display_name(F.col("title"), F.col("username")).alias("name")
    )


# --- Scalars --------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey AS marked, l_suppkey AS negated,
      l_orderkey AS plain FROM lineitem"""
)
def channel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked, negative and plain forms of three keys."""
    marked = F.concat(F.lit("-100"), F.col("l_partkey").cast("string")).cast("bigint")
    negative = -F.col("l_suppkey")
    return T.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        S.normalize_channel_id(marked).alias("marked"),
        S.normalize_channel_id(negative).alias("negated"),
        S.normalize_channel_id(F.col("l_orderkey")).alias("plain"),
    )


@query(
    f"""SELECT channel_id, msg_id, {LINK} AS link
    FROM ({T.TEXTS_SQL}) AS t JOIN ({T.CHANNELS_SQL}) AS c USING (channel_id)"""
)
def post_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2."""
    keys = T.texts(spark, sf_dir).select("channel_id", "msg_id")
    named = M.with_channel(keys, T.channels(spark, sf_dir))
    link = S.post_link(F.col("username"), F.col("channel_id"), F.col("msg_id"))
    return named.select("channel_id", "msg_id", link.alias("link"))


@query(f"SELECT doc_id, {excerpted('text')} AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", excerpt(F.col("text")).alias("excerpt")
    )


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", S.byte_length(F.col("text")).cast("bigint").alias("n_bytes")
    )


@query(
    """SELECT family, count(*) AS n FROM (
      SELECT unnest([CASE WHEN starts_with(lower(model), 'gemma') THEN 'text' ELSE 'json' END])
        AS family
      FROM (SELECT CASE event_type WHEN 'view' THEN 'Gemma-' || user_id
        WHEN 'click' THEN ' gemma' ELSE event_type || '-' || user_id END AS model
        FROM events) AS e) AS f GROUP BY family"""
)
def model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    model = (
        F.when(kind == "view", F.concat(F.lit("Gemma-"), user))
        .when(kind == "click", " gemma")
        .otherwise(F.concat(kind, F.lit("-"), user))
    )
    return (
        T.table(spark, sf_dir, "events")
        .select(S.model_family(model).alias("family"))
        .groupBy("family")
        .agg(F.count("*").alias("n"))
    )


@query(
    f"""SELECT channel_id, msg_id, 'gemma-4' AS model, CAST(NULL AS VARCHAR) AS system,
      {quoted(P.DEFAULT_RULES)} || chr(10) || chr(10) || {quoted(P.TEXT_OUTPUT)} || {quoted(K.POST_OPEN)}
        || {trimmed('message')} || {quoted(K.POST_CLOSE)} AS input
    FROM ({T.TEXTS_SQL}) AS t WHERE {trimmed('message')} <> ''
    UNION ALL SELECT channel_id, msg_id, 'json-1',
      {quoted(P.DEFAULT_RULES)} || chr(10) || chr(10) || {quoted(P.JSON_OUTPUT)}, {trimmed('message')}
    FROM ({T.TEXTS_SQL}) AS t WHERE {trimmed('message')} <> ''"""
)
def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the brief goes as system text where the model takes one, else around the post."""
    posts = T.texts(spark, sf_dir)
    return P.requests(posts, "gemma-4").unionByName(P.requests(posts, "json-1"))


@query(
    f"""SELECT doc_id, CASE WHEN strlen(text) <= {K.DIAGNOSTIC_BYTES} THEN text ELSE
      left(text, list_max(list_filter(range(0, {K.DIAGNOSTIC_BYTES + 1}),
        lambda n: strlen(left(text, n)) <= {K.DIAGNOSTIC_BYTES}))) || '…' END AS shown
    FROM documents"""
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", diag_truncate(F.col("text")).alias("shown")
    )


def _parts(text: str) -> F.Column:
    """Lines as parts, those with a comma as text; no candidate for one language, no parts for another."""
    lines = F.transform(
        F.split(F.col(text), "\n"),
        lambda s: F.struct(
            F.when(F.contains(s, F.lit(",")), "text").otherwise("data").alias("kind"),
            s.alias("text"),
        ),
    )
    return F.when(F.col("lang") == "fr", F.lit(None)).otherwise(
        F.when(F.col("lang") == "es", F.slice(lines, 1, 0)).otherwise(lines)
    )


@query(
    f"""SELECT doc_id, CASE WHEN error IS NULL THEN body END AS text, error FROM (
      SELECT *, CASE WHEN lang = 'fr' THEN 'empty_response' WHEN lang = 'es' THEN 'no_content'
        WHEN {trimmed('body')} = '' THEN 'no_text' END AS error
      FROM (SELECT doc_id, lang, array_to_string(list_filter(string_split(text, chr(10)),
        lambda s: contains(s, ',')), '') AS body FROM documents) AS a) AS b"""
)
def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    answer = R.response_text(_parts("text"))
    return T.table(spark, sf_dir, "documents").select("doc_id", answer.alias("r")).select(
        "doc_id", "r.text", "r.error"
    )


@query(
    as_text_sql(
        """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END
        AS since FROM orders""",
        "since",
    )
)
def since_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded dates; one status gives a blank setting."""
    text = F.concat(F.lit(" "), F.col("o_orderdate").cast("date").cast("string"), F.lit("\n"))
    setting = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(text)
    days = T.table(spark, sf_dir, "orders").select(
        "o_orderkey", S.parse_since(setting).alias("since")
    )
    return as_text(days, "since")


@query("SELECT strftime(ts, '%Y-%m-%d') AS since, count(*) AS n FROM events GROUP BY 1")
def since_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    return (
        T.table(spark, sf_dir, "events")
        .groupBy(S.since_key(F.col("ts")).alias("since"))
        .agg(F.count("*").alias("n"))
    )


@query(
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS padded,
      CASE WHEN p_size = 0 THEN 0 ELSE 25 END AS negative, CAST(25 AS BIGINT) AS word,
      CAST(0 AS BIGINT) AS zero FROM part"""
)
def setting_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    size = F.col("p_size").cast("string")

    def number(text: F.Column) -> F.Column:
        return S.nonneg_int_or(text, K.DEFAULT_RPM)

    return T.table(spark, sf_dir, "part").select(
        "p_partkey",
        number(F.concat(F.lit(" "), size, F.lit("\t"))).alias("padded"),
        number(F.concat(F.lit("-"), size)).cast("int").alias("negative"),
        number(F.col("p_name")).alias("word"),
        number(F.concat(F.lit("0"), F.substr(size, F.lit(1), F.lit(0)))).alias("zero"),
    )


_INVITE = (
    r"^(?:https://)?(?:http://)?(?:tg://)?(?:www\.)?"
    r"(?:t\.me/)?(?:telegram\.me/)?(?:telegram\.dog/)?(?:\+|joinchat/)(.+)$"
)


@query(
    f"""SELECT page_id, form, CASE WHEN own THEN 'self' WHEN code <> '' THEN 'invite'
        ELSE 'username' END AS kind,
      CASE WHEN own THEN '' WHEN code <> '' THEN code ELSE name END AS value
    FROM (SELECT *, lower(name) IN ('me', 'self') AS own,
        regexp_extract(name, '{_INVITE}', 1) AS code
      FROM (SELECT page_id, form, CASE form
          WHEN 1 THEN url WHEN 2 THEN 'https://t.me/+' || page_id
          WHEN 3 THEN 'www.telegram.me/joinchat/' || page_id WHEN 4 THEN 'user' || page_id
          WHEN 5 THEN 'ME' ELSE 'https://t.me/+' END AS name
        FROM pages, (SELECT unnest(range(1, 7)) AS form) AS f) AS a) AS b"""
)
def destination_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of each page and five other forms."""
    page = F.col("page_id").cast("string")
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("https://t.me/+"), page),
        F.concat(F.lit(" www.telegram.me/joinchat/"), page, F.lit("\n")),
        F.concat(F.lit("@user"), page),
        F.lit("ME"),
        F.lit("https://t.me/+"),
    )
    exploded = T.table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(forms).alias("pos", "raw")
    )
    return exploded.select(
        "page_id",
        (F.col("pos") + 1).cast("bigint").alias("form"),
        S.destination_class(F.col("raw")).alias("d"),
    ).select("page_id", "form", "d.kind", "d.value")


# --- Replies and verdicts ---------------------------------------------------------


def _family(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Replies of one family that hold some text."""
    replies = T.replies(spark, sf_dir).where(F.col("error").isNull())
    return replies.where(
        (S.model_family(F.col("model")) == family) & (utrim(F.col("raw")) != "")
    )


@query(as_text_sql(two_line_sql(TEXT_WHERE), "match"))
def two_line_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2, L3."""
    return as_text(R.parse_replies(_family(spark, sf_dir, "text")), "match")


@query(
    f"""SELECT page_id, span FROM ({spans('SELECT page_id, html FROM pages', 'page_id', 'html')}) AS p"""
)
def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 over whole web pages."""
    found = R.first_object(F.col("html"))
    return T.table(spark, sf_dir, "pages").select("page_id", found["span"].alias("span"))


@query(as_text_sql(json_sql(JSON_WHERE), "match"))
def json_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4, L5."""
    return as_text(R.parse_replies(_family(spark, sf_dir, "json")), "match")


@query(as_text_sql(VERDICTS_SQL, "match"))
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply, by family."""
    return as_text(R.parse_replies(T.replies(spark, sf_dir)), "match")


@query(
    f"""SELECT model, error, count(*) AS n FROM ({VERDICTS_SQL}) AS v
    WHERE error IS NOT NULL GROUP BY model, error"""
)
def reply_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return G.error_counts(R.parse_replies(T.replies(spark, sf_dir)))


LABELLED_SQL = f"""SELECT t.channel_id, t.msg_id,
    CASE WHEN quality IS NOT NULL THEN quality = 1 END AS "match",
    CASE WHEN quality IS NOT NULL THEN 'quality ' || quality || ', toxic ' || toxic END AS reason,
    CASE WHEN quality IS NULL THEN 'no_reply' END AS error
  FROM ({T.TEXTS_SQL}) AS t LEFT JOIN labels ON labels.doc_id = t.msg_id"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = T.texts(spark, sf_dir).select("channel_id", "msg_id")
    return V.with_verdicts(keys, T.label_replies(spark, sf_dir))


@query(as_text_sql(LABELLED_SQL, "match"))
def offline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies from the labels; posts without one get ``no_reply``."""
    columns = ["channel_id", "msg_id", "match", "reason", "error"]
    return as_text(_labelled(spark, sf_dir).select(*columns), "match")


@query(f"""SELECT channel_id, msg_id, reason FROM ({LABELLED_SQL}) AS v WHERE "match" """)
def matches_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    return V.matches_only(_labelled(spark, sf_dir)).select("channel_id", "msg_id", "reason")


# --- Reports ------------------------------------------------------------------------


@query(
    f"""SELECT p.channel_id, count(*) AS total,
      count(*) FILTER (WHERE msg_id > coalesce(last_msg_id, 0) AND {trimmed('message')} <> '')
        AS pending
    FROM ({T.POSTS_SQL}) AS p LEFT JOIN ({T.MARKS_SQL}) AS m ON p.channel_id = m.channel_id
    WHERE p.channel_id IN ({T.WATCH_SQL}) AND kind = 'message' AND {RANGE}
    GROUP BY p.channel_id"""
)
def backlog_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    kept = C.date_range(C.ordinary_only(T.narrow_posts(spark, sf_dir)), SINCE, UNTIL)
    watched = C.watched_only(kept, T.watch(spark, sf_dir))
    return G.backlog_by_channel(watched, T.marks(spark, sf_dir))


BY_CHANNEL_SQL = f"""SELECT channel_id, count(*) FILTER (WHERE error IS NULL) AS analysed,
    count(*) FILTER (WHERE "match") AS matched FROM ({LABELLED_SQL}) AS v GROUP BY channel_id"""


@query(BY_CHANNEL_SQL)
def run_summary_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return G.run_summary_by_channel(_labelled(spark, sf_dir))


@query(
    f"""SELECT CAST(sum(analysed) AS BIGINT) AS analysed, CAST(sum(matched) AS BIGINT) AS matched
    FROM ({BY_CHANNEL_SQL}) AS s"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    return G.run_summary(G.run_summary_by_channel(_labelled(spark, sf_dir)))


@query(
    f"""SELECT channel_id, max(last_msg_id) AS last_msg_id FROM (
      SELECT channel_id, msg_id AS last_msg_id FROM ({LABELLED_SQL}) AS v WHERE error IS NULL
      UNION ALL SELECT * FROM ({T.MARKS_SQL}) AS m) AS u GROUP BY channel_id"""
)
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    processed = _labelled(spark, sf_dir).withColumn("blank", F.lit(False))
    return G.high_water(processed, T.marks(spark, sf_dir))


# --- Matches and sinks -----------------------------------------------------------------

# A fifth of the channels is not in the dimension of the quarantine queries.
MATCHED_SQL = f"""SELECT channel_id, msg_id, reason, title, username, title IS NOT NULL AS found
  FROM (SELECT channel_id, msg_id, reason FROM ({VERDICTS_SQL}) AS v WHERE "match") AS m
  LEFT JOIN ({RESOLVED_SQL}) AS r USING (channel_id)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = V.matches_only(R.parse_replies(T.replies(spark, sf_dir)))
    resolved = C.resolve_channels(T.watch(spark, sf_dir), T.channels(spark, sf_dir))
    return M.with_channel(hits.select("channel_id", "msg_id", "reason"), resolved)


def _time() -> F.Column:
    return F.lit(LOG_TIME).cast("timestamp_ntz")


@query(log_sql(f"SELECT * FROM ({MATCHED_SQL}) AS x WHERE found", "backfill"))
def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, P7."""
    found = _matched(spark, sf_dir).where("channel_found")
    return M.match_records(found, K.SOURCE_BACKFILL, _time())


@query(
    f"""SELECT channel_id, msg_id, reason, 'live' AS source, 'channel_missing' AS cause
    FROM ({MATCHED_SQL}) AS x WHERE NOT found"""
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, the other side."""
    return M.quarantine(_matched(spark, sf_dir), K.SOURCE_LIVE)


ALL_MATCHES_SQL = (
    log_sql(f"SELECT * FROM ({MATCHED_SQL}) AS x WHERE found", "backfill")
    + " UNION ALL "
    + log_sql(
        f"""SELECT * FROM (SELECT channel_id, msg_id, reason FROM ({LABELLED_SQL}) AS v
        WHERE "match") AS y JOIN ({RESOLVED_SQL}) AS r USING (channel_id)""",
        "live",
    )
)


@query(ALL_MATCHES_SQL)
def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: matches of two reply sets in one log."""
    resolved = C.resolve_channels(T.watch(spark, sf_dir), T.channels(spark, sf_dir))
    hits = V.matches_only(R.parse_replies(T.label_replies(spark, sf_dir)))
    live = M.with_channel(hits, resolved).where("channel_found")
    history = _matched(spark, sf_dir).where("channel_found")
    return M.all_matches(
        M.match_records(live, K.SOURCE_LIVE, _time()),
        M.match_records(history, K.SOURCE_BACKFILL, _time()),
    )


NOTES_SQL = f"""SELECT channel_id, msg_id, {note('message')} AS text
  FROM (SELECT channel_id, msg_id, reason, title, username FROM ({MATCHED_SQL}) AS x WHERE found) AS m
  JOIN ({T.TEXTS_SQL}) AS t USING (channel_id, msg_id)"""


def _matched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = V.matched_posts(T.texts(spark, sf_dir), T.replies(spark, sf_dir))
    resolved = C.resolve_channels(T.watch(spark, sf_dir), T.channels(spark, sf_dir))
    return M.with_channel(hits, resolved).where("channel_found")


@query(NOTES_SQL)
def notification_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    link = S.post_link(F.col("username"), F.col("channel_id"), F.col("msg_id"))
    text = S.notification_text(
        F.col("title"), F.col("username"), F.col("reason"), F.col("message"), link
    )
    return _matched_texts(spark, sf_dir).select("channel_id", "msg_id", text.alias("text"))


@query(f"SELECT '{DESTINATION}' AS destination, text, CAST(1 AS BIGINT) AS with_its_id FROM ({NOTES_SQL}) AS n")
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, as written and read back; ids that a rerun repeats, each for one message."""
    path = scratch_path(spark, "outbox")
    messages = M.outbox_messages(_matched_texts(spark, sf_dir), DESTINATION)
    write_part(messages, path, "all")
    again = messages.select("dedup_id", F.lit(True).alias("same"))
    its_id = F.count("same").over(Window.partitionBy("dedup_id"))
    return read_outbox(spark, path).join(again, "dedup_id", "left").select(
        "destination", "text", its_id.alias("with_its_id")
    )


@query(log_sql(f"SELECT * FROM ({MATCHED_SQL}) AS x WHERE found", "backfill"))
def match_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, as written and read back."""
    path = scratch_path(spark, "match-log")
    found = _matched(spark, sf_dir).where("channel_found")
    write_match_log(M.match_records(found, K.SOURCE_BACKFILL, _utc_time()), path, "all")
    return _zoneless(read_match_log(spark, path))


def _utc_time() -> F.Column:
    """The log time as an instant, whatever the session zone is."""
    return F.from_utc_timestamp(_time().cast("timestamp"), F.current_timezone())


def _zoneless(log: DataFrame) -> DataFrame:
    time = F.to_utc_timestamp(F.col("time"), F.current_timezone()).cast("timestamp_ntz")
    return log.withColumn("time", time)


# --- Scoring, rules -------------------------------------------------------------------


def length_scorer(system: str):
    """A stand-in model: matches posts with a common word, fails on two others."""

    def reply(text: str) -> str:
        if " dans " in text and " qui " in text:
            raise CallFailed(503, "service unavailable")
        flag = "true" if " the " in text or " der " in text else "false"
        return f'{{"match": {flag}, "reason": "{len(text)} characters"}}'

    return reply


OFFLINE_MODEL = "json-local"
UNPACED = CallPolicy(rpm=0)


def scored_sql(posts: str) -> str:
    clean = trimmed("message")
    fails = f"(contains({clean}, ' dans ') AND contains({clean}, ' qui '))"
    return f"""SELECT channel_id, msg_id,
      CASE WHEN NOT {fails} THEN contains({clean}, ' the ') OR contains({clean}, ' der ') END
        AS "match",
      CASE WHEN NOT {fails} THEN length({clean}) || ' characters' END AS reason,
      CASE WHEN {fails} THEN 'call_failed' END AS error FROM ({posts}) AS p"""


@query(as_text_sql(scored_sql(T.TEXTS_SQL), "match"))
def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: a scorer called once per post inside the tasks."""
    scored = score_posts(T.texts(spark, sf_dir), length_scorer, OFFLINE_MODEL, UNPACED)
    return as_text(R.parse_replies(scored).drop("model"), "match")


def busy_scorer(system: str):
    """A stand-in model that is down for some posts and over its quota for others."""

    def reply(text: str) -> str:
        if " dans " in text:
            raise CallFailed(503, "service unavailable")
        if " und " in text:
            raise CallFailed(429, f"retry in {len(text)}s" if len(text) % 2 else "slow down")
        return "{}"

    return reply


@query(
    f"""SELECT channel_id, msg_id, attempt, code, CASE WHEN code = 503 THEN 'service unavailable'
        WHEN n % 2 = 1 THEN 'retry in ' || n || 's' ELSE 'slow down' END AS message,
      CAST(CASE WHEN code = 503 OR attempt = 3 THEN 0 WHEN n % 2 = 1 THEN (n + 1) * 1000000
        ELSE (10 * 2 ** attempt + 1) * 1000000 END AS BIGINT) AS wait_us
    FROM (SELECT channel_id, msg_id, n, code, unnest(CASE code WHEN 503 THEN [0] ELSE [0, 1, 2, 3] END) AS attempt
      FROM (SELECT channel_id, msg_id, length({trimmed('message')}) AS n,
          CASE WHEN contains({trimmed('message')}, ' dans ') THEN 503
            WHEN contains({trimmed('message')}, ' und ') THEN 429 END AS code FROM ({T.TEXTS_SQL}) AS t) AS c
      WHERE code IS NOT NULL) AS a"""
)
def failed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: failed calls of M1 as rows, with retries and their waits."""
    policy = CallPolicy(rpm=0, sleep=lambda seconds: None)
    return call_log(score_posts(T.texts(spark, sf_dir), busy_scorer, OFFLINE_MODEL, policy))


# Common words of the texts stand in for the terms of the brief.
STAND_IN = (
    Term("role_other", "the"), Term("role_other", "quell*"), Term("role_engineer", "and"),
    Term("role_engineer", "le"), Term("go", "was"), Term("go", "Et", True), Term("go", "en"),
    Term("other_language", "que"), Term("other_language", "that"), Term("bonus", "les"),
    Term("bonus", "of the"), Term("senior", "der"), Term("senior", "with"),
    Term("junior", "und"), Term("junior", "for"), Term("years", "die der"),
    Term("other_city", "from"), Term("other_city", "dans"), Term("astana", "un"),
    Term("remote", "by"), Term("kazakhstan", "pour"), Term("not_vacancy", "au"),
    Term("not_vacancy", "have*"),
)


def mentions_sql(own: str, terms: list[Term]) -> str:
    tests = [
        f"contains({own if t.case_sensitive else f'lower({own})'}, {quoted(needle(t))})"
        for t in terms
    ]
    return "(" + " OR ".join(tests) + ")"


def _group(name: str) -> list[Term]:
    return [t for t in STAND_IN if t.group == name]


SEGMENTS_SQL = rf"""SELECT channel_id, msg_id, list_transform(
    regexp_split_to_array({trimmed('message')}, '[\n,;•|]'),
    lambda s: ' ' || array_to_string(regexp_extract_all(s, '[\p{{L}}\p{{N}}+#]+'), ' ') || ' ')
    AS segs FROM ({T.TEXTS_SQL}) AS t"""
OWN_SQL = f"""SELECT channel_id, msg_id, segs, array_to_string(segs, '|') AS own
  FROM ({SEGMENTS_SQL}) AS s"""
GROUPS = tuple(dict.fromkeys(t.group for t in STAND_IN))


@query(
    " UNION ALL ".join(
        f"""SELECT channel_id, msg_id, '{g}' AS rule_id FROM ({OWN_SQL}) AS o
        WHERE {mentions_sql('own', _group(g))}"""
        for g in GROUPS
    )
)
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: which groups of the lexicon each post mentions."""
    return rule_hits(T.texts(spark, sf_dir), STAND_IN)


@query(
    f"""SELECT channel_id, msg_id, first_trigger, {", ".join(
        f"CASE WHEN first_trigger IS NULL THEN CAST(i{n} AS VARCHAR) END AS i{n}"
        for n in (1, 2, 3))},
      first_trigger IS NULL AND i1 AND i2 AND i3 AS "match" FROM (
      SELECT *, CASE WHEN role_other AND NOT engineer_seg THEN 'R-A' WHEN NOT go THEN 'R-B'
          WHEN rc THEN 'R-C' WHEN (senior AND NOT junior) OR years THEN 'R-D'
          WHEN other_city AND NOT astana AND NOT remote THEN 'R-E'
          WHEN not_vacancy AND NOT role_engineer THEN 'R-F' END AS first_trigger,
        junior OR NOT senior AS i1, go AND NOT rc AS i2,
        remote OR astana OR (kazakhstan AND NOT other_city)
          OR NOT (kazakhstan OR other_city) AS i3
      FROM (SELECT *, go AND bonus AND other_language AND NOT go_seg AS rc FROM (
        SELECT channel_id, msg_id,
          {", ".join(f"{mentions_sql('own', _group(g))} AS {g}" for g in GROUPS)},
          len(list_filter(segs, lambda x: ({mentions_sql('x', _group('role_engineer'))}
            OR {mentions_sql('x', _group('go'))})
            AND NOT {mentions_sql('x', _group('role_other'))})) > 0 AS engineer_seg,
          len(list_filter(segs, lambda x: {mentions_sql('x', _group('go'))}
            AND NOT {mentions_sql('x', _group('bonus'))})) > 0 AS go_seg
        FROM ({OWN_SQL}) AS o) AS a) AS b) AS c"""
)
def rule_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    return as_text(rule_screen(T.texts(spark, sf_dir), STAND_IN), "i1", "i2", "i3")


_WORDS_OF = r"regexp_extract_all(lower(s), '[\p{L}\p{N}+#]+')"


def phrases_sql(source: str, keys: str) -> str:
    """Words and pairs of neighbours within a segment, in lower case."""
    return rf"""SELECT DISTINCT {keys} term FROM (
      SELECT {keys} unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term
      FROM (SELECT {keys} {_WORDS_OF} AS ws FROM (
        SELECT {keys} unnest(regexp_split_to_array({trimmed('message')}, '[\n,;•|]')) AS s FROM ({source}) AS a) AS b) AS c) AS d"""


@query(
    f"""SELECT DISTINCT channel_id, msg_id, "group" AS rule_id
    FROM ({phrases_sql(T.TEXTS_SQL, 'channel_id, msg_id,')}) AS p
    JOIN (SELECT term, CASE WHEN contains(term, ' ') THEN 'pair' ELSE 'word' END || length(term) % 9 AS "group"
      FROM ({phrases_sql('SELECT text AS message FROM benchmark', '')}) AS b) AS t USING (term)"""
)
def lexicon_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 with a lexicon that is a table: every word and pair of words of the benchmark, in 18 groups."""
    segments = F.explode(F.split(utrim(F.col("text")), "[\n,;•|]")).alias("s")
    words = F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}\p{N}+#]+"), F.lit(0)).alias("ws")
    held = T.table(spark, sf_dir, "benchmark").select(segments).select(words)
    pairs = F.transform(
        F.filter(F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", 2, 1 << 30).alias("b")), lambda z: z["b"].isNotNull()),
        lambda z: F.concat_ws(" ", z["a"], z["b"]),
    )
    terms = held.select(F.explode(F.concat("ws", pairs)).alias("text")).distinct()
    kind = F.when(F.contains("text", F.lit(" ")), "pair").otherwise("word")
    group = F.concat(kind, (F.length("text") % 9).cast("string"))
    return rule_hits(T.texts(spark, sf_dir), terms.select(group.alias("group"), "text", F.lit(False).alias("case_sensitive")))


@query(
    """SELECT p_partkey, p_size >= 3 AND p_partkey % 5 <> 4 OR p_size - 1 >= 3 AND p_partkey % 5 = 4
      AS rejected FROM part"""
)
def experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: posts that ask for a number of years, with the default lexicon."""
    size = F.col("p_size")
    less = (size - 1).cast("string")
    n = size.cast("string")
    forms = (
        F.concat(n, F.lit("+ years")),
        F.concat(n, F.lit(" years of commercial experience")),
        F.concat(F.lit("от "), n, F.lit(" лет")),
        F.concat(F.lit("minimum "), n, F.lit(" years")),
        F.concat(less, F.lit("-"), n, F.lit(" years of experience")),
    )
    asked = F.get(F.array(*forms), F.pmod("p_partkey", F.lit(5)).cast("int"))
    posts = T.table(spark, sf_dir, "part").select(
        F.lit(1).cast("bigint").alias("channel_id"),
        F.col("p_partkey").cast("bigint").alias("msg_id"),
        F.concat(F.lit("Go developer, remote, "), asked).alias("message"),
    )
    return rule_screen(posts).select(
        F.col("msg_id").alias("p_partkey"),
        F.coalesce(F.col("first_trigger") == "R-D", F.lit(False)).alias("rejected"),
    )


class _Watch:
    """A clock that only sleeping moves on."""

    def __init__(self, now: float) -> None:
        self.now = now

    def read(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds


def _slot_scorer(watch: _Watch):
    """Replies with the second of the call."""
    return lambda system: lambda text: str(round(watch.read()))


@query(
    f"""SELECT v AS batch, count(*) AS calls, count(*) AS slots, min(1) AS least_gap,
      CAST(count(*) >= 4 AS INT) AS lanes_used FROM (SELECT CAST(msg_id % 3 AS INT) AS v
      FROM ({T.TEXTS_SQL}) AS t WHERE {trimmed('message')} <> '') AS b GROUP BY v"""
)
def paced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, Q1: three batches at 60 calls a minute in four tasks; no two calls share a second."""
    texts = C.non_blank(T.texts(spark, sf_dir))
    batches = []
    for number in range(3):
        watch = _Watch(number * 1e7)
        policy = CallPolicy(rpm=60, tasks=4, sleep=watch.sleep, clock=watch.read)
        batch = texts.where(F.col("msg_id") % 3 == number)
        scored = score_posts(batch, _slot_scorer(watch), OFFLINE_MODEL, policy)
        batches.append(
            scored.select(F.lit(number).alias("batch"), F.col("raw").cast("bigint").alias("slot"))
        )
    # Gaps within an hour's slots, then between the hours of a batch: no batch is one group.
    hour = F.floor(F.col("slot") / 3600).alias("hour")
    slots = reduce(DataFrame.unionByName, batches).groupBy("batch", hour, "slot").agg(F.count("*").alias("n"))
    before = F.lag("slot").over(Window.partitionBy("batch", "hour").orderBy("slot"))
    gap = F.when(F.col("n") > 1, F.lit(0).cast("bigint")).otherwise(F.col("slot") - before)
    hours = slots.withColumn("gap", gap).groupBy("batch", "hour").agg(
        F.sum("n").alias("calls"),
        F.count("*").alias("slots"),
        F.min("gap").alias("gap"),
        F.min("slot").alias("first"),
        F.max("slot").alias("last"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("slot") % 4).cast("int"))).alias("lanes"),
    )
    between = F.col("first") - F.lag("last").over(Window.partitionBy("batch").orderBy("hour"))
    return (
        hours.withColumn("between", between)
        .groupBy("batch")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("slots").alias("slots"),
            F.least(F.min("gap"), F.min("between")).cast("int").alias("least_gap"),
            (F.bit_or("lanes") == 15).cast("int").alias("lanes_used"),
        )
    )


# --- Quota -----------------------------------------------------------------------------


def schedule_sql(key: str, rpm: int) -> str:
    step = MINUTE_US // rpm
    return f"""SELECT quota_key, arrival, channel_id, msg_id,
      make_timestamp(start_us) AS start, start_us - epoch_us(arrival) AS wait_us
    FROM (SELECT *, k * {step} + max(epoch_us(arrival) - k * {step}) OVER (
        PARTITION BY quota_key ORDER BY arrival, channel_id, msg_id) AS start_us
      FROM (SELECT *, row_number() OVER (
          PARTITION BY quota_key ORDER BY arrival, channel_id, msg_id) - 1 AS k
        FROM (SELECT {key} AS quota_key, ts AS arrival, user_id AS channel_id,
          event_id AS msg_id FROM events) AS e) AS r) AS s"""


def _arrivals(spark: SparkSession, sf_dir: str, key: F.Column) -> DataFrame:
    return T.table(spark, sf_dir, "events").select(
        key.alias("quota_key"),
        F.col("ts").alias("arrival"),
        F.col("user_id").alias("channel_id"),
        F.col("event_id").alias("msg_id"),
    )


@query(schedule_sql("event_type", 1))
def quota_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: one limiter per event type."""
    return quota_schedule(_arrivals(spark, sf_dir, F.col("event_type")), rpm=1)


@query(schedule_sql("'shared'", 2))
def quota_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: one limiter for everything, the hottest key there is."""
    return quota_schedule(_arrivals(spark, sf_dir, F.lit("shared")), rpm=2, partitions=8)


QUOTA_SQL = """(code = 429 OR contains(coalesce(message, ''), 'Error 429')
  OR contains(coalesce(message, ''), 'RESOURCE_EXHAUSTED')
  OR contains(coalesce(message, ''), 'exceeded your current quota'))"""
WAIT_SQL = r"""(coalesce(CASE WHEN hint > 0
  THEN CAST(floor(trunc(hint * 1e9) / 1000) AS BIGINT) END,
  CAST(pow(2, attempt) AS BIGINT) * 10000000) + 1000000)"""
CALLS_SQL = f"""SELECT channel_id, msg_id, attempt, code, message, {QUOTA_SQL} AS quota,
    {WAIT_SQL} AS wait_us FROM (SELECT *, TRY_CAST(regexp_extract(coalesce(message, ''),
      'retry in ([0-9]+(?:\\.[0-9]+)?)s', 1) AS DOUBLE) AS hint FROM ({T.CALLS_SQL}) AS c0) AS c1
""".replace("\\\\", "\\")


@query(f"SELECT channel_id, msg_id, attempt, quota, wait_us FROM ({CALLS_SQL}) AS c")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, Q3."""
    return T.calls(spark, sf_dir).select(
        "channel_id",
        "msg_id",
        "attempt",
        is_quota_error(F.col("code"), F.col("message")).alias("quota"),
        retry_wait_us(F.col("attempt"), F.col("message")).alias("wait_us"),
    )


@query(
    f"""SELECT channel_id, msg_id, CAST(count(*) AS INT) AS calls,
      CAST(coalesce(sum(wait_us) FILTER (WHERE quota AND attempt < 3), 0) AS BIGINT) AS total_wait_us,
      CASE WHEN bool_or(NOT quota AND code = 0) THEN 'ok'
        WHEN bool_or(NOT quota) THEN 'call_failed' ELSE 'quota' END AS status
    FROM (SELECT *, coalesce(min(attempt) FILTER (WHERE NOT quota)
        OVER (PARTITION BY channel_id, msg_id), 99) AS stop FROM ({CALLS_SQL}) AS c) AS d
    WHERE attempt <= stop GROUP BY channel_id, msg_id"""
)
def retry_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4."""
    return retry_plan(T.calls(spark, sf_dir))


@query(
    f"""SELECT CASE WHEN ok THEN channel_id END AS channel_id, CASE WHEN ok THEN msg_id END AS msg_id,
      CASE WHEN ok THEN message END AS message,
      CASE WHEN NOT ok THEN CASE msg_id % 5 WHEN 0 THEN '{{' || message WHEN 1 THEN '{{}}' END END AS malformed
    FROM (SELECT *, msg_id % 5 > 1 AS ok FROM ({T.TEXTS_SQL}) AS t) AS p"""
)
def parsed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as a topic holds them, two fifths of them malformed."""
    texts = T.texts(spark, sf_dir)
    fifth = F.col("msg_id") % 5
    value = (
        F.when(fifth == 0, F.concat(F.lit("{"), F.col("message")))
        .when(fifth == 1, "{}")
        .otherwise(F.to_json(F.struct("channel_id", "msg_id", "message")))
    )
    return parse_posts(texts.select(value.alias("value"))).select(
        "channel_id", "msg_id", "message", "malformed"
    )


# --- Flows -----------------------------------------------------------------------------


def _sinks(spark: SparkSession, name: str) -> SinkPaths:
    root = scratch_path(spark, name)
    return SinkPaths(
        f"{root}/log", f"{root}/outbox", f"{root}/verdicts", f"{root}/quarantine", f"{root}/state"
    )


LIVE_POSTS_SQL = f"""SELECT * FROM ({T.POSTS_SQL}) AS p WHERE kind = 'message'
  AND peer_kind = 'channel' AND date >= TIMESTAMP '2024-01-02' AND {trimmed('message')} <> ''
  AND channel_id IN ({T.WATCH_SQL})"""
JOINED_SQL = f"""SELECT * FROM ({T.CHANNELS_SQL}) AS c0 WHERE NOT "left" """


def _live_params() -> ScreeningParams:
    return ScreeningParams(model=OFFLINE_MODEL, rpm=0, destination=DESTINATION)


@query(f"SELECT channel_id, msg_id, date FROM ({LIVE_POSTS_SQL}) AS l")
def live_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 to F5 and T3 as the live flow applies them, over a table."""
    kept = live_posts(
        T.posts(spark, sf_dir),
        T.watch(spark, sf_dir),
        _live_params(),
        as_of=C.ntz(UNTIL - dt.timedelta(days=1)),
        until=SINCE,
    )
    return kept.select("channel_id", "msg_id", "date")


@query(
    log_sql(
        f"""SELECT * FROM (SELECT channel_id, msg_id, reason
          FROM ({scored_sql(LIVE_POSTS_SQL)}) AS v WHERE "match") AS y
        JOIN ({JOINED_SQL}) AS r USING (channel_id)""",
        "live",
    )
)
def stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, drained; the match log read back."""
    sinks = _drained(spark, sf_dir, "live")
    return _zoneless(read_match_log(spark, sinks.match_log))


def _drained(spark: SparkSession, sf_dir: str, name: str, keep_failed: bool = False) -> SinkPaths:
    schema = "doc_id BIGINT, text STRING, source STRING"
    # A pattern, since a stream takes no single file as its folder.
    stream = read_live(spark, f"{sf_dir}/[d]ocuments.parquet", schema)
    posts = stream.select(
        F.substr("source", F.lit(4)).cast("bigint").alias("channel_id"),
        F.col("doc_id").alias("msg_id"),
        F.col("text").alias("message"),
    ).join(T.updates(spark, sf_dir), "msg_id")
    sinks = _sinks(spark, name)
    checkpoint = scratch_path(spark, f"{name}-checkpoint")
    _drain(spark, sf_dir, name, posts, sinks, checkpoint, keep_failed)
    return sinks


def _drain(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    posts: DataFrame,
    sinks: SinkPaths,
    checkpoint: str,
    keep_failed: bool = False,
    **options: int,
) -> None:
    """Run the live flow until nothing is left of the stream."""
    running = start_live(
        posts,
        C.joined_only(T.channels(spark, sf_dir)),
        T.watch(spark, sf_dir),
        _live_params(),
        sinks,
        length_scorer,
        checkpoint=checkpoint,
        name=name,
        trigger={"availableNow": True},
        as_of=C.ntz(SINCE),
        until=SINCE,
        time=_utc_time(),
        keep_failed=keep_failed,
        **options,
    )
    running.awaitTermination()


def _json_post() -> F.Column:
    return F.to_json(
        F.struct("channel_id", "msg_id", "kind", "peer_kind", "message", "date"),
        {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    )


def _json_lines(spark: SparkSession, sf_dir: str) -> SinkPaths:
    """The posts as JSON lines, a fifth of them cut off, in two loads; the flow is restarted for the second."""
    posts = T.posts(spark, sf_dir)
    whole = _json_post()
    cut = F.concat(F.lit('{"msg_id":'), "msg_id", F.lit(',"message":'))
    lines = posts.select(
        (F.col("msg_id") % 2).alias("load"), F.when(F.col("msg_id") % 5 == 0, cut).otherwise(whole).alias("value")
    )
    path, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "lines-checkpoint")
    sinks = _sinks(spark, "lines")
    for load in (0, 1):
        lines.where(F.col("load") == load).select("value").write.mode("append").text(path)
        _drain(spark, sf_dir, "lines", read_live_json(spark, path), sinks, checkpoint)
    return sinks


@query(
    log_sql(
        f"""SELECT * FROM (SELECT channel_id, msg_id, reason
          FROM ({scored_sql(LIVE_POSTS_SQL + " AND msg_id % 5 <> 0")}) AS v WHERE "match") AS y
        JOIN ({JOINED_SQL}) AS r USING (channel_id)""",
        "live",
    )
)
def json_stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches among JSON lines that came in two loads, the flow restarted between them."""
    return _zoneless(read_match_log(spark, _json_lines(spark, sf_dir).match_log))


@query(
    f"""SELECT '{{"msg_id":' || msg_id || ',"message":' AS malformed
    FROM ({T.POSTS_SQL}) AS p WHERE msg_id % 5 = 0"""
)
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the same stream that are no posts, each kept once."""
    reader = spark.read.schema("malformed STRING").option("recursiveFileLookup", "true")
    return reader.parquet(malformed_table(_json_lines(spark, sf_dir)))


COMPACTED_SQL = f"""SELECT * FROM (SELECT channel_id, msg_id, reason
  FROM ({scored_sql(LIVE_POSTS_SQL)}) AS v WHERE "match") AS y
  JOIN ({JOINED_SQL}) AS r USING (channel_id)"""


@query(log_sql(COMPACTED_SQL, "live"))
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: the log of a stream of six batches, packed after every second one, two packs at a time."""
    path, checkpoint = scratch_path(spark, "files"), scratch_path(spark, "files-checkpoint")
    lines = T.posts(spark, sf_dir).select("msg_id", _json_post().alias("value")).repartition(6, "msg_id")
    lines.select("value").write.text(path)
    sinks = _sinks(spark, "packed")
    stream = read_live_json(spark, path, files_per_trigger=1)
    _drain(spark, sf_dir, "packed", stream, sinks, checkpoint, compact_every=2, fan=2)
    return _zoneless(read_match_log(spark, sinks.match_log))


def _half_mended_scorer(system: str):
    """The stand-in model, up again but for every seventh length."""

    def reply(text: str) -> str:
        if len(text) % 7 == 0:
            raise CallFailed(503, "service unavailable")
        return f'{{"match": true, "reason": "later, {len(text)} characters"}}'

    return reply


LIVE_SCORED_SQL = f"""SELECT v.*, length({trimmed('message')}) AS n FROM ({scored_sql(LIVE_POSTS_SQL)}) AS v
  JOIN ({T.TEXTS_SQL}) AS t USING (channel_id, msg_id)"""


@query(
    log_sql(
        f"""SELECT * FROM (SELECT channel_id, msg_id, coalesce(reason, 'later, ' || n || ' characters') AS reason
          FROM ({LIVE_SCORED_SQL}) AS w WHERE "match" OR (error IS NOT NULL AND n % 7 <> 0)) AS y
        JOIN ({JOINED_SQL}) AS r USING (channel_id)""",
        "live",
    )
)
def retried_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed posts of the live flow wait in keyed state, are tried again, and are logged once."""
    sinks = _drained(spark, sf_dir, "retried-live", keep_failed=True)
    running = start_retries(
        spark,
        C.joined_only(T.channels(spark, sf_dir)),
        _live_params(),
        sinks,
        _half_mended_scorer,
        checkpoint=scratch_path(spark, "retries-checkpoint"),
        name="retries",
        trigger={"processingTime": "200 milliseconds"},
        time=_utc_time(),
        attempts=2,
        wait_scale=0.01,
    )
    if not settle(running, 600):
        raise RuntimeError("posts are still waiting")
    return _zoneless(read_match_log(spark, sinks.match_log))


# A channel without a mark starts at 0, so only ids above 0 are taken.
HISTORY_SQL = f"""SELECT p.* FROM ({T.POSTS_SQL}) AS p JOIN ({RESOLVED_SQL}) AS r USING (channel_id)
  WHERE kind = 'message' AND msg_id > 0"""


def _sweep(spark: SparkSession, sf_dir: str, name: str, *runs: dict):
    """A sweep over the whole month of the tables, in two slices and one run or several."""
    sinks = _sinks(spark, name)
    params = ScreeningParams(
        model=OFFLINE_MODEL, rpm=0, destination=DESTINATION, since=dt.date(2024, 1, 1)
    )
    for options in runs or ({},):
        sweep = backfill(
            spark,
            T.posts(spark, sf_dir),
            T.channels(spark, sf_dir),
            params,
            sinks,
            options.pop("make_scorer", length_scorer),
            now=dt.datetime(2024, 2, 1),
            slice_days=16,
            time=_utc_time(),
            watch=T.watch(spark, sf_dir),
            **options,
        )
    return sinks, sweep


@query(
    log_sql(
        f"""SELECT * FROM (SELECT channel_id, msg_id, reason
          FROM ({scored_sql(HISTORY_SQL)}) AS v WHERE "match") AS y
        JOIN ({RESOLVED_SQL}) AS r USING (channel_id)""",
        "backfill",
    )
)
def backfill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a sweep over all posts; the match log read back."""
    sinks, _ = _sweep(spark, sf_dir, "backfill")
    return _zoneless(read_match_log(spark, sinks.match_log))


@query(
    f"""SELECT channel_id, max(msg_id) AS last_msg_id FROM ({scored_sql(HISTORY_SQL)}) AS v
    WHERE error IS NULL GROUP BY channel_id"""
)
def progress_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks the sweep left, as a resumed run would read them."""
    sinks, sweep = _sweep(spark, sf_dir, "progress")
    return SweepState(spark, sinks.state).marks(sweep)


@query(
    f"""SELECT channel_id, count(*) FILTER (WHERE error IS NULL) AS analysed,
      count(*) FILTER (WHERE "match") AS matched FROM ({scored_sql(HISTORY_SQL)}) AS v
    GROUP BY channel_id"""
)
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 over the replies a sweep stored."""
    sinks, sweep = _sweep(spark, sf_dir, "summary")
    return G.run_summary_by_channel(sweep_verdicts(spark, sinks, sweep))


@query(
    f"""SELECT channel_id, count(*) FILTER (WHERE error IS NULL) AS analysed,
      count(*) FILTER (WHERE "match") AS matched FROM ({scored_sql(HISTORY_SQL)}) AS v
    GROUP BY channel_id"""
)
def sweep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep's totals from what its rounds added up, without reading verdicts again."""
    posts = T.updates(spark, sf_dir).count()
    sinks, sweep = _sweep(spark, sf_dir, "totals", {"round_posts": max(1, posts // 4)})
    return SweepState(spark, sinks.state).totals(sweep)


@query(
    as_text_sql(
        f"""SELECT channel_id, msg_id, "match", error, CAST(1 AS BIGINT) AS times, 'later' AS ended
        FROM ({scored_sql(HISTORY_SQL)}) AS v""",
        "match",
    )
)
def resumed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, T4: a sweep that ends after a third of its posts and is resumed; each post is scored once."""
    third = max(1, T.updates(spark, sf_dir).count() // 3)
    first = {"round_posts": third, "most_rounds": 1}
    sinks, sweep = _sweep(spark, sf_dir, "resumed", first, {"round_posts": third})
    state = "later" if len(sweep.committed) > 1 and sweep.finished else "at once"
    times = F.count("*").over(Window.partitionBy("channel_id", "msg_id"))
    scored = sweep_verdicts(spark, sinks, sweep).select(
        "channel_id", "msg_id", "match", "error", times.alias("times"), F.lit(state).alias("ended")
    )
    return as_text(scored, "match")


def _mended_scorer(system: str):
    """The stand-in model when it is up again."""
    return lambda text: f'{{"match": false, "reason": "later, {len(text)} characters"}}'


@query(
    as_text_sql(
        f"""SELECT channel_id, msg_id, coalesce("match", false) AS "match",
          coalesce(reason, 'later, ' || n || ' characters') AS reason
        FROM (SELECT v.*, length({trimmed('message')}) AS n FROM ({scored_sql(HISTORY_SQL)}) AS v
          JOIN ({T.TEXTS_SQL}) AS t USING (channel_id, msg_id)) AS w""",
        "match",
    )
)
def retried_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, T4: posts whose calls failed in the first run are tried again by the second, and only they."""
    sinks, sweep = _sweep(spark, sf_dir, "retried", {}, {"make_scorer": _mended_scorer})
    kept = sweep_verdicts(spark, sinks, sweep)
    return as_text(kept.select("channel_id", "msg_id", "match", "reason"), "match")
