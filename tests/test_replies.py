import json
import random

from pyspark.sql import functions as F

from rows import apply
from siftline.functions import replies as R

TWO_LINE = [
    ("MATCH: yes\nREASON: Junior Go разработчик, удалёнка", True, "Junior Go разработчик, удалёнка"),
    ('match = "No"\nreason: x', False, "x"),
    ("> - MATCH: ДА\n> - REASON: 'ок'", True, "ок"),
    ("**MATCH**: yes\nREASON: x", "no_match_line", None),
    ("MATCH: yesterday", True, ""),
    ("MATCH: yes", True, ""),
    ("MATCH: yes\nREASON: <short Russian sentence>", "template_echo", None),
    ("MATCH: no\nREASON: <x>", False, "<x>"),
    ("MATCH: yes\nREASON: String.", "template_echo", None),
    ("MATCH: yes\nREASON: n/a", "template_echo", None),
    ("MATCH: yes\nREASON:\nтекст", True, "текст"),
    ("MATCH: maybe\nREASON: x", "no_match_line", None),
    ("Verdict: MATCH: yes", "no_match_line", None),
    ("MATCH: no\nMATCH: yes", False, ""),
    ('MATCH: true\nREASON: " a "', True, " a "),
    ("MATCH: yes\r\nREASON: ok\r\n", True, "ok"),
    ("```\nMATCH: yes\nREASON: ok\n```", True, "ok"),
    ("MATCH\n:\nнет\nREASON\t=\t`q`", False, "q"),
    ("x\n \n>\n- MATCH: TRUE\nREASON:", True, ""),
    ("MATCH: yes\nREASON:\nREASON: x", True, "REASON: x"),
    ("MATCH: yes\nREASON: a > b < c", True, "a > b < c"),
    ("MATCH: yes\nREASON: a < b > c", "template_echo", None),
    ("MATCH: yes\nREASON: at most MAX 140 chars", "template_echo", None),
    ("MATCH: yes\nREASON: strings", True, "strings"),
    ("MATCH: yes\nREASON:   \n", True, ""),
]

JSON = [
    ('{"match":true,"reason":"ok"}', True, "ok"),
    ('{"match":"true","reason":"x"}', "decode_error", None),
    ('{"match":true,"reason":5}', "decode_error", None),
    ('{ "match": boolean, "reason": string }', "decode_error", None),
    ('{"reason":"x"}', False, "x"),
    ('{"match":null,"reason":null}', False, ""),
    ('{"Match":true,"REASON":"x"}', True, "x"),
    ('{"match":true,"match":false}', False, ""),
    ('{"match":true,"MATCH":false,"Match":true}', True, ""),
    ('{"match":true,"match":null}', True, ""),
    ('{"match":1,"match":true}', "decode_error", None),
    ('{"match":true,"reason":"x","e":[1]}', True, "x"),
    ('{"e":{"a":1,"a":2},"match":true}', True, ""),
    ("{\"rea\u017fon\":\"long s\"}", False, "long s"),
    ("no", "no_json_object", None),
    ('{"a":"', "unbalanced_json", None),
    ('{"a":1} {"match":true}', False, ""),
    ("{'match':true}", "decode_error", None),
    ('{"match":true,}', "decode_error", None),
    ('{"match":NaN}', "decode_error", None),
]


def verdicts(spark, function, cases):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    got = apply(spark, [raw for raw, _, _ in cases], "STRING", function)
    return [(v.match, v.reason, v.error) for v in got]


def expected(cases):
    return [
        (None, None, flag) if isinstance(flag, str) else (flag, reason, None)
        for _, flag, reason in cases
    ]


def test_two_line_goldens(spark):
    assert verdicts(spark, R.two_line_verdict, TWO_LINE) == expected(TWO_LINE)


def test_json_goldens(spark):
    assert verdicts(spark, R.json_verdict, JSON) == expected(JSON)


def test_spans(spark):
    cases = {
        '```json\n{"match":true,"reason":"a } \\" {"}\n``` tail {x}': '{"match":true,"reason":"a } \\" {"}',
        '{"a":{"b":1}} z': '{"a":{"b":1}}',
        "no": None,
        '{"a":"': None,
        '"{" {x}': '{" {x}',
        "{\\}": "{\\}",
        "{{}": None,
        '{"a\\\\"}': '{"a\\\\"}',
        '{"a\\': None,
    }
    # An opening quote before the first brace is not looked at.
    cases['"{" {x}'] = None
    got = apply(spark, list(cases), "STRING", R.first_object)
    assert [r.span for r in got] == list(cases.values())


def _random_json(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 4:
        return [_random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {_noise(rng): _random_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [_noise(rng), rng.randrange(1000), None, True][kind]


def _noise(rng):
    return "".join(rng.choice('ab{}[]"\\\n:, жё😀') for _ in range(rng.randrange(12)))


def test_spans_of_random_objects(spark):
    rng = random.Random(7)
    texts, objects = [], []
    for _ in range(300):
        value = {_noise(rng): _random_json(rng, 4) for _ in range(rng.randrange(5))}
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5)
        objects.append(value)
        texts.append(rng.choice(["", "```json\n", 'said "so": ']) + text + rng.choice(["", "}{", "\n```"]))
    got = apply(spark, texts, "STRING", R.first_object)
    assert [json.loads(r.span) for r in got] == objects


def test_long_replies_stay_linear(spark):
    n = 200_000
    texts = [
        "\n" * n + "MATCH: yes\nREASON: ok",
        "MATCH: yes\nREASON: " + "a " * n,
        "MATCH: yes\nREASON: " + "<" * n,
    ]
    got = apply(spark, texts, "STRING", R.two_line_verdict)
    assert [len(v.reason) for v in got] == [2, 2 * n - 1, n]
    objects = ['{"match":true,"reason":"' + '\\"' * n + '"}', "{" * n, '{"e":{"a":"' + "x" * n + '"},"match":true}']
    got = apply(spark, objects, "STRING", R.json_verdict)
    assert [v.error for v in got] == [None, "unbalanced_json", None]


def test_parse_replies_by_family_and_early_errors(spark):
    rows = [
        (1, "gemma-4", "MATCH: yes", None),
        (2, "json-1", "MATCH: yes", None),
        (3, "json-1", None, None),
        (4, "gemma-4", " \n", None),
        (5, "gemma-4", None, "quota"),
        (6, "Gemma", '{"match":true}', None),
    ]
    frame = spark.createDataFrame(rows, "msg_id INT, model STRING, raw STRING, error STRING")
    got = {r.msg_id: (r.match, r.error) for r in R.parse_replies(frame).collect()}
    assert got == {
        1: (True, None),
        2: (None, "no_json_object"),
        3: (None, "empty_response"),
        4: (None, "no_text"),
        5: (None, "quota"),
        6: (None, "no_match_line"),
    }
    plain = R.parse_replies(frame.drop("error").where("msg_id = 1")).first()
    assert plain.match is True


def test_filter_does_not_parse_twice(spark):
    frame = spark.range(3).select(
        F.lit("json-1").alias("model"), F.concat(F.lit('{"match":'), F.col("id")).alias("raw")
    )
    plan = R.parse_replies(frame).where("match")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
