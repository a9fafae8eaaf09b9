"""Posts, channels, replies and calls as views of the given tables.

Wide text is only joined where a query needs it together with dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.functions.text import is_blank
from siftline.sources.channels import watch_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same text runs in both engines.
TEXTS_SQL = """SELECT CAST(substring(source, 4) AS BIGINT) AS channel_id, doc_id AS msg_id,
  text AS message FROM documents"""

UPDATES_SQL = """SELECT event_id AS msg_id, ts AS date,
  CASE WHEN event_type = 'error' THEN 'service' ELSE 'message' END AS kind,
  CASE WHEN event_type = 'signup' THEN 'user' ELSE 'channel' END AS peer_kind FROM events"""

CHANNELS_SQL = """SELECT channel_id,
  CASE WHEN channel_id % 5 = 0 THEN '' ELSE 'Channel ' || channel_id END AS title,
  CASE WHEN channel_id % 2 = 0 THEN 'chan' || channel_id ELSE '' END AS username,
  channel_id % 7 = 0 AS "left"
  FROM (SELECT DISTINCT CAST(substring(source, 4) AS BIGINT) AS channel_id FROM documents)"""

# Sixteen kinds of reply, each around the whole text of its post.
_ESCAPED = (
    "replace(replace(replace(message, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), "
    "chr(10), chr(92) || 'n')"
)
_VARIANTS = (
    ("gemma-4", "'MATCH: yes' || chr(10) || 'REASON: ' || message"),
    ("Gemma-4", "'MATCH: no' || chr(10) || 'REASON: ' || message"),
    ("gemma-4", "'MATCH: yes' || chr(10) || 'REASON: <short Russian sentence>'"),
    ("gemma-4", "message"),
    ("gemma-4", "'```' || chr(10) || 'MATCH: ДА' || chr(10) || 'REASON: ok ' || message || chr(10) || '```'"),
    ("gemma-4", "'> - match = \"TRUE\"' || chr(10) || '> - reason:' || chr(10) || '\"' || message || '\"'"),
    ("gemma-4", "'  ' || chr(10) || ' '"),
    ("json-1", "'{\"match\":true,\"reason\":\"' || escaped || '\"}'"),
    ("json-1", "'```json' || chr(10) || '{\"meta\":{\"tags\":[\"a}\",\"{b\"]},\"Match\":true,\"REASON\":\"' || escaped || '\"}' || chr(10) || '``` {x}'"),
    ("json-1", "'{\"match\":\"true\",\"reason\":\"' || escaped || '\"}'"),
    ("json-1", "'{\"match\":true,\"reason\":\"' || escaped"),
    ("json-1", "message"),
    ("json-1", "'{\"match\":null,\"reason\":null,\"n\":1}' || message"),
    ("json-1", "CAST(NULL AS VARCHAR(1))"),
    ("gemma-4", "'MATCH: yes' || chr(10) || 'REASON: one Short sentence in Russian, 140 characters at most.'"),
    ("gemma-4", "'MATCH: no' || chr(10) || 'REASON: the sentence with the actual reason'"),
)
REPLIES_SQL = (
    f"SELECT channel_id, msg_id, CASE v "
    + " ".join(f"WHEN {i} THEN '{model}'" for i, (model, _) in enumerate(_VARIANTS))
    + " END AS model, CASE v "
    + " ".join(f"WHEN {i} THEN {raw}" for i, (_, raw) in enumerate(_VARIANTS))
    + " END AS raw, CASE v WHEN 13 THEN 'quota' END AS error "
    + f"FROM (SELECT *, {_ESCAPED} AS escaped, CAST(msg_id % 16 AS INT) AS v FROM ({TEXTS_SQL}) AS t) AS r"
)

LABEL_REPLIES_SQL = """SELECT CAST(substring(source, 4) AS BIGINT) AS channel_id,
  labels.doc_id AS msg_id, 'gemma-4' AS model,
  'MATCH: ' || CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END || chr(10) ||
  'REASON: quality ' || quality || ', toxic ' || toxic AS raw, CAST(NULL AS VARCHAR(1)) AS error
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id"""

CALLS_SQL = """SELECT post % 20 AS channel_id, post AS msg_id, attempt,
  CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 429 WHEN 'signup' THEN 503 ELSE 500 END
    AS code,
  CASE event_type WHEN 'view' THEN NULL
    WHEN 'error' THEN 'Please retry in ' || CAST(value AS VARCHAR(20)) || 's.'
    WHEN 'click' THEN 'rpc error: RESOURCE_EXHAUSTED'
    WHEN 'signup' THEN 'service unavailable'
    ELSE 'googleapi: Error 429: slow down' END AS message
  FROM (SELECT *, CAST(floor(event_id / 4) AS BIGINT) AS post,
    CAST(event_id % 4 AS INT) AS attempt FROM events) AS e"""


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run shared SQL text over the named tables, without registering views."""
    text = text.replace('"left"', "`left`")
    return spark.sql(
        _braced(text, names), **{name: table(spark, sf_dir, name) for name in names}
    )


def _braced(text: str, names: tuple[str, ...]) -> str:
    """Doubled braces for literals, one pair around each table name after FROM or JOIN."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in names:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name}", f"{word} {{{name}}} AS {name}")
    return text


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without date: a plain scan of the documents."""
    return _sql(spark, sf_dir, TEXTS_SQL, "documents")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, UPDATES_SQL, "events")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with text, date and kinds."""
    return texts(spark, sf_dir).join(updates(spark, sf_dir), "msg_id")


def narrow_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a blank flag in place of the text, set before the join."""
    flagged = texts(spark, sf_dir).select(
        "channel_id", "msg_id", is_blank(F.col("message")).alias("blank")
    )
    return flagged.join(updates(spark, sf_dir), "msg_id")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHANNELS_SQL, "documents")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stands in for a stored table: built once per row, whatever is filtered later."""
    built = _sql(spark, sf_dir, REPLIES_SQL, "documents")
    return built.select(F.inline(F.array(F.struct(*built.columns))))


def label_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LABEL_REPLIES_SQL, "labels", "documents")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CALLS_SQL, "events")


def watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations outside one region, as comma lists of marked and plain ids."""
    key = F.col("n_nationkey").cast("string")
    lists = table(spark, sf_dir, "nation").where(F.col("n_regionkey") != 4)
    return watch_ids(
        lists.select(F.concat(F.lit(" -100"), key, F.lit(", "), key, F.lit(",,")).alias("csv"))
    )


WATCH_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS channel_id FROM nation WHERE n_regionkey <> 4"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark half way through each channel swept before; the other channels are new."""
    swept = table(spark, sf_dir, "nation").where(F.col("n_regionkey") < 3)
    return (
        texts(spark, sf_dir)
        .groupBy("channel_id")
        .agg(F.floor((F.min("msg_id") + F.max("msg_id")) / 2).alias("last_msg_id"))
        .join(
            swept.select(F.col("n_nationkey").cast("bigint").alias("channel_id")),
            "channel_id",
            "left_semi",
        )
    )


MARKS_SQL = f"""SELECT channel_id, (min(msg_id) + max(msg_id)) // 2 AS last_msg_id
  FROM ({TEXTS_SQL}) AS t
  WHERE channel_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY channel_id"""

POSTS_SQL = f"""SELECT t.channel_id, t.msg_id, t.message, u.date, u.kind, u.peer_kind
  FROM ({TEXTS_SQL}) AS t JOIN ({UPDATES_SQL}) AS u ON t.msg_id = u.msg_id"""
