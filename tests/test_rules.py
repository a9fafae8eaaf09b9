import random

import pytest

from siftline.operators.lexicon import DEFAULT_LEXICON, GROUPS, Term
from siftline.operators.lookup import BroadcastBound
from siftline.operators.rules import rule_hits, rule_screen
from siftline.operators.terms import Segmenter, lexicon_parts

CASES = [
    ("Junior Go developer, remote", None),
    ("Ищем Go-разработчика (Junior/Middle), Астана", None),
    ("Golang разработчик, Kazakhstan", None),
    ("Go developer", None),
    ("Бизнес-аналитик, удалённо, SQL", "R-A"),
    ("Senior designer\nFigma", "R-A"),
    ("Python backend developer, junior, remote", "R-B"),
    ("We go fast: junior Java developer", "R-B"),
    ("Junior Python developer\nGo будет плюсом", "R-C"),
    ("Go будет плюсом\nGo developer, junior", None),
    ("Senior Go developer, remote", "R-D"),
    ("Junior Go developer, 3+ years", "R-D"),
    ("Go разработчик, от 5 лет опыта, remote", "R-D"),
    ("Go developer, 15+ years", "R-D"),
    ("Go developer, 16+ years", "R-D"),
    ("Go developer, 2+ years", None),
    ("Go, от 20 лет", "R-D"),
    ("Go, от 2 лет", None),
    ("Go developer, 3-5 years of experience", "R-D"),
    ("Go developer, 1-3 years of experience", None),
    ("Go developer, minimum 5 years", "R-D"),
    ("Go developer, 99999999999999999999+ years", "R-D"),
    ("Менеджер поддержки", "R-A"),
    ("Go developer, Almaty office", "R-E"),
    ("Go developer, Almaty, Astana", None),
    ("Go developer, Москва или remote", None),
    ("News: Go 1.30 is out", "R-F"),
    ("Ищем Go-разработчика, PHP-разработчика и дизайнера", None),
    ("Ищем дизайнера, Golang в команде", None),
    ("Ищем дизайнера и копирайтера\nсоцсети", "R-A"),
    ("", "R-B"),
]


def frame(spark):
    rows = [(1, i, text) for i, (text, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "channel_id BIGINT, msg_id BIGINT, message STRING")


def test_rules_on_hand_rows(spark):
    got = {r.msg_id: r for r in rule_screen(frame(spark)).collect()}
    assert [got[i].first_trigger for i in range(len(CASES))] == [rule for _, rule in CASES]
    for i, (_, rule) in enumerate(CASES):
        assert got[i].match == (rule is None)


def _plain_hits(text, lexicon):
    """Word by word, without the shortcuts of the job."""
    import regex

    hits = set()
    if any(t.group == "years" for t in lexicon):
        asked = regex.findall(
            r"(\d+)\+ (?:years|лет)|(\d+)(?:-\d+)? years of (?:commercial|experience)|от (\d+) лет|minimum (\d+) years",
            text.lower(),
        )
        hits |= {"years" for found in asked if int("".join(found)) >= 3}
    for segment in regex.split(r"[\n,;•|]", text):
        words = regex.findall(r"[\p{L}\p{N}+#]+", segment)
        for term in lexicon:
            own = words if term.case_sensitive else [w.lower() for w in words]
            text_ = term.text if term.case_sensitive else term.text.lower()
            *whole, last = text_.split()
            for at in range(len(own) - len(whole)):
                tail = own[at + len(whole)]
                ends = tail.startswith(last[:-1]) if last.endswith("*") else tail == last
                if own[at : at + len(whole)] == whole and ends:
                    hits.add(term.group)
    return hits


@pytest.mark.parametrize(
    "lexicon", [DEFAULT_LEXICON, (Term("x", "a*"), Term("y", "GO", True), Term("z", "go as*"))]
)
def test_hits_equal_a_word_by_word_search(spark, lexicon):
    got = {}
    for r in rule_hits(frame(spark), lexicon).collect():
        got.setdefault(r.msg_id, set()).add(r.rule_id)
    want = {i: _plain_hits(text, lexicon) for i, (text, _) in enumerate(CASES)}
    assert got == {i: hits for i, hits in want.items() if hits}


def term_table(spark, terms):
    return spark.createDataFrame([tuple(t) for t in terms], "`group` STRING, text STRING, case_sensitive BOOLEAN").repartition(4)


@pytest.mark.parametrize("size", [64 << 20, 3000])
def test_a_lexicon_table_of_any_size_gives_the_same(spark, size):
    bound = BroadcastBound(size)
    table = term_table(spark, DEFAULT_LEXICON)
    assert (len(lexicon_parts(table, bound=bound)) > 1) == (size < 10_000)
    want = sorted(map(tuple, rule_screen(frame(spark)).collect()))
    assert sorted(map(tuple, rule_screen(frame(spark), table, bound).collect())) == want
    want = sorted(map(tuple, rule_hits(frame(spark), DEFAULT_LEXICON).collect()))
    assert sorted(map(tuple, rule_hits(frame(spark), table, bound).collect())) == want


def test_thousands_of_terms(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(3000)]
    lexicon = [Term(f"g{i % 40}", w) for i, w in enumerate(words)]
    lexicon += [Term("pairs", f"{rng.choice(words)} {rng.choice(words)}") for _ in range(2000)] + [Term("caps", "T5", True), Term("starts", "t29*")]
    rows = [(1, i, ", ".join(" ".join(rng.choices(words + ["T5", "x"], k=9)) for _ in range(6))) for i in range(60)]
    posts = spark.createDataFrame(rows + [(2, 1, None), (2, 2, "")], "channel_id BIGINT, msg_id BIGINT, message STRING")
    got = {}
    for r in rule_hits(posts, term_table(spark, lexicon)).collect():
        got.setdefault((r.channel_id, r.msg_id), set()).add(r.rule_id)
    want = {(c, i): _plain_hits(text, lexicon) for c, i, text in rows}
    assert got == {k: v for k, v in want.items() if v}
    with pytest.raises(ValueError):
        rule_hits(posts, [Term(f"g{i}", "x") for i in range(70)])


def test_segments_equal_those_of_a_pattern():
    import regex

    rng = random.Random(4)
    own = Segmenter()
    for _ in range(500):
        text = "".join(rng.choice("aB1+#_ \n,;•|.-é日\u0301\u2003«»½٣\x00\x1c") for _ in range(rng.randrange(40)))
        words = regex.sub(r"[^\p{L}\p{N}+#\n,;•|]+", " ", text)
        plain = f" {' '.join(regex.sub(r'[\n,;•|]', ' | ', words).split())} "
        assert own(text) == plain


def test_null_terms_are_left_out(spark):
    rows = [("a", "go", None), (None, "go", False), ("b", None, False), ("c", " ", False), ("d", "*", False)]
    table = spark.createDataFrame(rows, "`group` STRING, text STRING, case_sensitive BOOLEAN")
    assert {r.rule_id for r in rule_hits(frame(spark), table).collect()} == {"a"}


def test_rules_move_no_rows(spark):
    plan = rule_screen(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_lexicon_groups_are_known():
    assert {t.group for t in DEFAULT_LEXICON} == set(GROUPS)
