"""WARC archives: write records, read them back through verified record chains.

Reading splits files by byte ranges at every line that begins like a record.
Such a line may also stand inside a payload, so each one is only a candidate:
its header says where the next record would begin. Records are those that the
chain of successors reaches from the start of the file. The chains are
followed by pointer jumping: candidates that simply follow one another form a
run, and pointers between runs double their reach every round.

Everything is DataFrame work; the archives are plain text files to Spark,
which writes them under its commit protocol and splits them when reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftline.llm.common import store
from siftline.operators.lookup import fits_broadcast, lookup_join
from siftline.session import scratch_path

# The format's own words.
VERSION = "WARC/1.0"
MAGIC = "WARC/1."
CRLF = "\r\n"
HEADER_END = CRLF + CRLF
RECORD_END = CRLF + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: What splits a file: no proper end of it begins it, so no match can hide another.
MARK = "\n" + MAGIC
#: Extension field, so that a revisit tells the size of the payload it leaves out.
SIZE_FIELD = "X-Payload-Length"
NAMESPACE = "urn:page:"
MIN_REVISIT_BYTES = 0

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in base32: 160 bits are 32 letters of five bits, four groups of 40 bits."""
    letters = []
    for part in range(4):
        number = F.conv(F.substring(F.sha1(data), part * 10 + 1, 10), 16, 10).cast("long")
        for place in range(7, -1, -1):
            digit = F.shiftright(number, 5 * place).bitwiseAND(31).cast("int")
            letters.append(F.substring(F.lit(_BASE32), digit + 1, F.lit(1)))
    return F.concat(*letters)


def with_revisits(
    pages: DataFrame, id_column: str, payload: str, min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """``pages`` with ``payload_digest``, ``payload_bytes`` and ``refers_to``.

    Of records with equal payloads of ``min_bytes`` or more, the one with the
    largest id is the response; the others refer to it. Only digests and ids
    are shuffled: groups of one are sorted out before anything is joined, and
    the payloads move only if the list of revisits is too long to broadcast.
    """
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    digest, size = F.sha1(raw), F.octet_length(raw).cast("long")
    keys = pages.select(F.col(id_column).alias("_id"), digest.alias("_sha"), size.alias("_size"))
    keys = store(keys.where((F.col("_size") >= min_bytes) & F.col("_id").isNotNull()), "digests")
    repeated = store(
        keys.groupBy("_sha").agg(F.max("_id").alias("refers_to"), F.min("_id").alias("_least"))
        .where("_least < refers_to").drop("_least"),
        "repeated",
    )
    # One payload may be a third of all: it is dealt out by id, or not shuffled at all.
    found = lookup_join(keys.select("_id", "_sha"), repeated, "inner", key="_sha", spread="_id")
    revisits = found.where("_id < refers_to").select("_id", "refers_to").distinct()
    revisits = store(revisits, "revisits")
    small = F.broadcast(revisits) if fits_broadcast(revisits) else revisits
    return (
        pages.join(small, F.col(id_column) == F.col("_id"), "left").drop("_id")
        .withColumn("payload_digest", sha1_base32(raw))
        .withColumn("payload_bytes", size)
    )


def record_text(record_id: Column, uri: Column, date: Column, payload: Column) -> Column:
    """One record without its closing line breaks; a revisit holds no block."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(payload, F.lit("")))

    def field(name: str, value: Column) -> Column:
        # A line break in a value would end the field.
        clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", "%0A")
        return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))

    return F.concat(
        F.lit(VERSION + CRLF),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit(f"<{NAMESPACE}"), record_id.cast("string"), F.lit(">"))),
        field("WARC-Date", date),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field(SIZE_FIELD, F.col("payload_bytes")),
        field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        field("WARC-Refers-To", F.concat(F.lit(f"<{NAMESPACE}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        F.lit("Content-Length: "),
        F.octet_length(body.cast("binary")).cast("string"),
        F.lit(HEADER_END),
        body,
    )


def write_archives(records: DataFrame, column: str, path: str) -> None:
    """One archive per partition; a record's closing line breaks are the line separator."""
    records.select(F.col(column).alias("value")).write.option("lineSep", RECORD_END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Archives cut at every ``MARK``: ``file, block, at, value``, in file order within a block."""
    return spark.read.option("lineSep", MARK).text(f"{path}/*").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place that looks like a record, stored: where it is, its header's fields, its successor.

    Offsets come from adding up the pieces before, block by block. ``whole``
    marks candidates whose payload lies in their own piece; its digest is
    taken while the piece is at hand.
    """
    # A payload may begin like a record: then the mark took the last byte of the header's end.
    text = F.concat("value", F.lit(MARK[0]))
    header = F.when(F.instr(text, HEADER_END) > 0, F.substring_index(text, HEADER_END, 1))
    pieces = (
        _pieces(spark, path)
        .withColumn("header", F.concat(F.lit(CRLF), header))
        .withColumn("piece_bytes", F.octet_length("value").cast("long"))
        .withColumn("print", F.xxhash64("value"))
        .withColumn("header_bytes", F.octet_length(header).cast("long") + len(HEADER_END))
        .withColumn("content", F.expr("try_cast(regexp_extract(header, '(?i)\\r\\nContent-Length:[ \\t]*([0-9]{1,18})(?![0-9])', 1) AS BIGINT)"))
        .withColumn("whole", F.col("header_bytes") + F.col("content") <= F.col("piece_bytes"))
        .withColumn(
            "digest",
            F.when(
                F.col("whole"),
                sha1_base32(F.substring(F.col("value").cast("binary"), (F.col("header_bytes") + 1).cast("int"), F.col("content").cast("int"))),
            ),
        )
    )
    rows = store(
        pieces.select(
            "file", "block", "at", "piece_bytes", "print", "header_bytes", "content", "whole", "digest",
            F.startswith("value", F.lit(MAGIC)).alias("magic"),
            _field(F.col("header"), "WARC-Type").alias("record_type"),
            _field(F.col("header"), "WARC-Record-ID").alias("record_id"),
            _field(F.col("header"), "WARC-Target-URI").alias("uri"),
            _field(F.col("header"), "WARC-Refers-To").alias("refers_to"),
            _field(F.col("header"), "WARC-Payload-Digest").alias("stated_digest"),
            _field(F.col("header"), SIZE_FIELD).alias("stated_bytes"),
        ),
        "candidates",
    )
    step = F.col("piece_bytes") + len(MARK)
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("_bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_before", F.coalesce(F.sum(step).over(before), F.lit(0)))
        .join(bases, ["file", "block"])
        .withColumn("piece_start", F.col("_base") + F.col("_before"))
    )
    # The first piece of a file holds the magic itself, the others follow their mark.
    first = F.col("piece_start") == 0
    start = F.when(first, 0).otherwise(F.col("piece_start") - len(MAGIC))
    return (
        placed.withColumn("start", start)
        .withColumn("header_bytes", F.when(~first | F.col("magic"), F.col("header_bytes")))
        .withColumn("successor", F.col("piece_start") + F.col("header_bytes") + F.col("content") + len(RECORD_END))
        .drop("_base", "_before", "magic")
    )


def reachable(placed: DataFrame) -> DataFrame:
    """Candidates that the chain from their file's start reaches.

    A run is a stretch of neighbours, within a block, each the successor of
    the one before. Runs point at the run their last candidate leads to, and
    to the place there. Marks spread from each file's first run by pointer
    jumping: in round r marked runs mark what lies 2**r pointers ahead.
    """
    order = Window.partitionBy("file", "block").orderBy("start")
    breaks = F.coalesce(F.lag("successor").over(order) != F.col("start"), F.lit(True))
    runs = store(
        placed.where("header_bytes IS NOT NULL AND content IS NOT NULL")
        .withColumn("_break", breaks.cast("int"))
        .withColumn("run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_break"),
        "chains",
    )
    tails = runs.groupBy("file", "block", "run").agg(F.max_by("successor", "start").alias("to"))
    heads = runs.select("file", F.col("block").alias("to_block"), F.col("run").alias("to_run"), F.col("start").alias("to"))
    # entry: where the pointer lands in its run.
    jumps = store(
        tails.join(heads, ["file", "to"]).select(
            "file", "block", "run", "to_block", "to_run", F.col("to").alias("entry")
        ),
        "jumps",
    )
    marked = store(runs.where("start = 0").select("file", "block", "run", F.col("start").alias("entry")), "marks")
    known = marked.count()
    while known:
        ahead = marked.drop("entry").join(jumps, ["file", "block", "run"]).select(
            "file", F.col("to_block").alias("block"), F.col("to_run").alias("run"), "entry"
        )
        # A run has one place at which the chain enters it.
        marked = store(
            marked.unionByName(ahead).groupBy("file", "block", "run").agg(F.min("entry").alias("entry")), "marks"
        )
        now = marked.count()
        if now == known:
            break
        known = now
        after = jumps.select(
            "file", F.col("block").alias("to_block"), F.col("run").alias("to_run"),
            F.col("to_block").alias("_block"), F.col("to_run").alias("_run"), F.col("entry").alias("_entry"),
        )
        jumps = store(
            jumps.drop("entry").join(after, ["file", "to_block", "to_run"]).select(
                "file", "block", "run", F.col("_block").alias("to_block"), F.col("_run").alias("to_run"), F.col("_entry").alias("entry")
            ),
            "jumps",
        )
    return runs.join(marked, ["file", "block", "run"]).where("start >= entry").drop("entry", "run")


def _cut_payloads(spark: SparkSession, path: str, placed: DataFrame, kept: DataFrame) -> DataFrame:
    """Digests of records whose payload holds the mark: their pieces are read again and joined up.

    The second read may be split otherwise than the first, so nothing that
    splits give, numbers or blocks, is compared: pieces are told by file,
    size and hash, and pieces of equal content stand for one another.
    """
    split = kept.where("NOT whole").select(
        "file", F.col("start").alias("_record"), F.col("piece_start").alias("_from"), "successor", "header_bytes", "content"
    )
    content = ["file", "piece_bytes", "print"]
    parts = store(
        placed.select(*content, "piece_start").join(split, "file")
        .where("piece_start >= _from AND piece_start < successor"),
        "parts",
    )
    if parts.isEmpty():
        return parts.select("file", F.col("_record").alias("start"), F.lit(None).cast("string").alias("joined"))
    again = _pieces(spark, path).select(
        "file", F.octet_length("value").cast("long").alias("piece_bytes"), F.xxhash64("value").alias("print"), "value"
    )
    needed = again.join(parts.select(content).distinct(), content, "left_semi").groupBy(content).agg(F.first("value").alias("value"))
    lost = F.raise_error(F.concat(F.lit("archive changed between two reads: "), F.col("file")))
    texts = parts.join(needed, content, "left").withColumn("value", F.coalesce("value", lost))
    payload = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_start", "value"))), lambda p: p["value"]), MARK)
    whole = texts.groupBy("file", "_record", "header_bytes", "content").agg(payload.alias("text"))
    body = F.substring(F.col("text").cast("binary"), (F.col("header_bytes") + 1).cast("int"), F.col("content").cast("int"))
    return whole.select("file", F.col("_record").alias("start"), sha1_base32(body).alias("joined"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``: place, fields, payload size and verified digest.

    For a revisit, size and digest are those its header states. A folder
    without records gives no rows. What follows a broken link of a chain is
    not reached, as its boundaries cannot be trusted.
    """
    placed = store(candidates(spark, path), "placed")
    kept = store(reachable(placed), "records")
    cut = _cut_payloads(spark, path, placed, kept)
    revisit = F.col("record_type") == "revisit"
    computed = F.coalesce("digest", "joined")
    return kept.join(cut, ["file", "start"], "left").select(
        "file", "start", "record_type", "record_id", "uri", "refers_to",
        F.when(revisit, F.expr("try_cast(stated_bytes AS BIGINT)")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(computed).alias("payload_digest"),
        (revisit | (F.concat(F.lit("sha1:"), computed) == F.col("stated_digest"))).alias("digest_holds"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as archives and read them back, one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, and
    ``digest_holds``. Null html is an empty payload; rows without page_id are
    responses of their own; rows that share an id and a payload are one
    record's copies and get its type. An empty table gives no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    marked = with_revisits(pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id", "html", min_bytes)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    record = record_text(name, F.col("url"), F.lit("2024-01-01T00:00:00Z"), F.col("html"))
    write_archives(marked.select(record.alias("record")), "record", path)

    def number(column: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({column}, '{NAMESPACE}([-0-9]+)', 1) AS BIGINT)")

    return read_archives(spark, path).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "digest_holds",
    )
