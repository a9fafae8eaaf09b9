import datetime as dt

import pytest
from pyspark.sql import functions as F

from rows import apply
from siftline import constants as K
from siftline.functions import scalars as S
from siftline.functions import text as X
from siftline.functions.quota import is_quota_error, retry_wait_us
from siftline.functions.replies import response_text
from siftline.functions.prompts import build_prompt, requests, text_frame
from siftline.sources.channels import watch_ids, watch_list


def test_white_space_is_the_unicode_set():
    assert len(K.WHITE_SPACE) == 25
    assert all(c.isspace() for c in K.WHITE_SPACE)


def test_utrim_and_blank(spark):
    values = ["\t　 a b \x85\n\x0b", "", K.WHITE_SPACE, None, "​x"]
    assert apply(spark, values, "STRING", X.utrim) == ["a b", "", "", None, "​x"]
    assert apply(spark, values, "STRING", X.is_blank) == [False, True, True, True, False]


def test_normalize_channel_id(spark):
    ids = [-1001944996511, 1944996511, -42, -100, -1000, 0, 100, -10012]
    plain = apply(spark, ids, "BIGINT", S.normalize_channel_id)
    assert plain == [1944996511, 1944996511, 42, 100, 0, 0, 100, 12]
    assert apply(spark, plain, "BIGINT", S.normalize_channel_id) == plain


def test_post_link(spark):
    rows = spark.createDataFrame(
        [("jobs", 7, 348), ("", 1944996511, 348), (None, 5, 1)], "u STRING, c BIGINT, m BIGINT"
    )
    links = [r[0] for r in rows.select(S.post_link(F.col("u"), F.col("c"), F.col("m"))).collect()]
    assert links == [
        "https://t.me/jobs/348",
        "https://t.me/c/1944996511/348",
        "https://t.me/c/5/1",
    ]


def test_excerpt_counts_code_points(spark):
    exact, longer = "ж😀" * 1750, "ж😀" * 1750 + "x"
    assert apply(spark, [f" {exact}\n", longer], "STRING", X.excerpt) == [exact, exact + "…"]


def test_diag_truncate_stays_valid(spark):
    values = ["a" * 200, "a" * 201, "ж" * 101, "a" + "ж" * 100, "aaa" + "😀" * 60, "я" * 100]
    got = apply(spark, values, "STRING", X.diag_truncate)
    assert got == [
        "a" * 200, "a" * 200 + "…", "ж" * 100 + "…", "a" + "ж" * 99 + "…",
        "aaa" + "😀" * 49 + "…", "я" * 100,
    ]


def test_display_name_and_note(spark):
    rows = spark.createDataFrame(
        [("T", "u", " r ", " body\n", "L"), ("", "u", "", "", "L"), (None, None, "\xa0", None, "L")],
        "title STRING, username STRING, reason STRING, message STRING, link STRING",
    )
    names = ("title", "username", "reason", "message", "link")
    note = S.notification_text(*(F.col(c) for c in names))
    assert [r[0] for r in rows.select(note).collect()] == [
        "✅ Подходящая вакансия\n\n📢 Канал: T\n💡 r\n\n📝 body\n\n🔗 L",
        "✅ Подходящая вакансия\n\n📢 Канал: u\n\n🔗 L",
        "✅ Подходящая вакансия\n\n📢 Канал: \n\n🔗 L",
    ]


def test_model_family(spark):
    names = ["Gemma-4", "gemini-2.5-flash", " gemma", "gemma"]
    assert apply(spark, names, "STRING", S.model_family) == ["text", "json", "json", "text"]


def test_parse_since(spark):
    good = apply(spark, ["2026-04-17", " 2024-02-29\n", "", " \t", None], "STRING", S.parse_since)
    assert good == [dt.date(2026, 4, 17), dt.date(2024, 2, 29), None, None, None]
    for bad in ("2026-4-17", "2026-02-30", "17.04.2026", "2026-04-17T00"):
        with pytest.raises(Exception, match="since must be"):
            apply(spark, [bad], "STRING", S.parse_since)


def test_nonneg_int_or(spark):
    values = ["", "0", "-3", "x", " 7 ", "+7", "007", "7.5", None, "9" * 30]
    got = apply(spark, values, "STRING", lambda c: S.nonneg_int_or(c, 25))
    assert got == [25, 0, 25, 25, 7, 7, 7, 25, 25, 25]


def test_destination_class(spark):
    values = [
        "ME", "self", "https://t.me/+AbC", "t.me/joinchat/AbC", "+AbC", "https://t.me/+", "jobs",
        "@jobs", " @me ", "http://www.telegram.dog/joinchat/x", "www.https://t.me/+x",
        "https://https://t.me/+x", "joinchat/",
    ]
    got = [(r.kind, r.value) for r in apply(spark, values, "STRING", S.destination_class)]
    assert got == [
        ("self", ""), ("self", ""), ("invite", "AbC"), ("invite", "AbC"), ("invite", "AbC"),
        ("username", "https://t.me/+"), ("username", "jobs"), ("username", "jobs"), ("self", ""),
        ("invite", "x"), ("username", "www.https://t.me/+x"),
        ("username", "https://https://t.me/+x"), ("username", "joinchat/"),
    ]


def test_watch_list(spark):
    assert sorted(r[0] for r in watch_list(spark, " -1001, 5,,5 ").collect()) == [1, 5]
    with pytest.raises(ValueError):
        watch_list(spark, ",")
    with pytest.raises(ValueError):
        watch_list(spark, None)
    with pytest.raises(Exception, match="invalid channel id"):
        watch_list(spark, "5,x")
    frame = spark.createDataFrame([("1,2",), ("2,-42",)], "csv STRING")
    assert sorted(r[0] for r in watch_ids(frame).collect()) == [1, 2, 42]


def test_quota_errors_and_waits(spark):
    rows = spark.createDataFrame(
        [
            (429, "any", 0), (500, "RESOURCE_EXHAUSTED", 1), (500, "error 429", 2),
            (429, "retry in 38.341s", 2), (429, "retry in 0s", 0), (None, None, 0),
        ],
        "code INT, message STRING, attempt INT",
    )
    out = rows.select(
        is_quota_error(F.col("code"), F.col("message")),
        retry_wait_us(F.col("attempt"), F.col("message")),
    ).collect()
    assert [r[0] for r in out] == [True, True, False, True, True, False]
    assert [r[1] for r in out] == [
        11_000_000, 21_000_000, 41_000_000, 39_341_000, 11_000_000, 11_000_000,
    ]


def test_response_text(spark):
    part = "ARRAY<STRUCT<kind: STRING, text: STRING>>"
    values = [
        None, [], [("data", "x")], [("text", " ")], [("text", "a"), ("data", "b"), ("text", "c")],
    ]
    got = [(r.text, r.error) for r in apply(spark, values, part, response_text)]
    assert got == [
        (None, "empty_response"), (None, "no_content"), (None, "no_text"), (None, "no_text"),
        ("ac", None),
    ]


def test_prompts(spark):
    posts = spark.createDataFrame([(1, 1, " hi "), (1, 2, "\n")], "channel_id BIGINT, msg_id BIGINT, message STRING")
    text = requests(posts, "gemma-4", rules="RULES").collect()
    before, after = text_frame("RULES")
    assert [(r.msg_id, r.system, r.input) for r in text] == [(1, None, f"{before}hi{after}")]
    assert before.startswith("RULES\n\n") and before.endswith("\n\n---\nPOST:\n")
    json_request = requests(posts, "json-1", rules="RULES").first()
    assert json_request.input == "hi" and json_request.system.startswith("RULES")
    assert apply(spark, [" a "], "STRING", lambda c: build_prompt(c, F.lit("x"))) == ["a"]
