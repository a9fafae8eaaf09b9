"""Requests for the model: the brief is a parameter, the framing is fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline import constants as K
from siftline.functions.scalars import model_family
from siftline.functions.text import is_blank, utrim

# Default brief, in our own words; rule ids are those of operators.rules.
DEFAULT_RULES = """You screen channel posts (Russian, Kazakh or English) for one person:
a backend engineer at intern, trainee or junior level who writes Go and works
fully remote, or on site or hybrid in Astana, Kazakhstan.

First look for a reason to reject. One hit is enough, and it is final:
R-A: the role is not programming (analyst, writer, designer, manager, recruiter,
     sales, accounting, law, support, manual testing, teaching, manual work).
R-B: Go or Golang is not among the required or main technologies.
R-C: Go is only a bonus next to another main language.
R-D: only middle level or above is wanted, or three or more years of experience.
R-E: on site or hybrid in another city only, and not remote. A list of cities
     that includes Astana is a choice and passes.
R-F: not a vacancy: news, jokes, articles, events, bare teasers.

A post with several roles passes when at least one of its roles passes.

Then all of these must hold:
I-1: entry level is named, is one of the levels named, or no level is named.
I-2: Go is a required or main technology.
I-3: remote, or Astana among the cities, or Kazakhstan without a city, or no place.

If a post passed the rejections and is still unclear, answer yes."""

JSON_OUTPUT = f"""Answer with one JSON object and nothing else. Key "match" is true or
false. Key "reason" is one {K.REASON_ASK}:
for true the role, level or place that fits, for false the rule that failed."""

TEXT_OUTPUT = f"""Answer with two lines and nothing else: no JSON, no Markdown.
The first line is MATCH: and yes or no. The second line is REASON: and one
{K.REASON_ASK}, with the actual reason.

A fitting post:
MATCH: yes
REASON: Junior Go, удалённо

A post that does not fit:
MATCH: no
REASON: R-B: нужен Python, Go не назван"""


def text_frame(rules: str | None = None) -> tuple[str, str]:
    """What stands before and after the post for a model with one text input."""
    brief = DEFAULT_RULES if rules is None else rules
    return f"{brief}\n\n{TEXT_OUTPUT}{K.POST_OPEN}", K.POST_CLOSE


def system_text(rules: str | None = None) -> str:
    """The system text for a model with JSON replies."""
    brief = DEFAULT_RULES if rules is None else rules
    return f"{brief}\n\n{JSON_OUTPUT}"


def build_prompt(message: Column, model: Column, rules: str | None = None) -> Column:
    before, after = text_frame(rules)
    post = utrim(message)
    return F.when(
        model_family(model) == "text", F.concat(F.lit(before), post, F.lit(after))
    ).otherwise(post)


def requests(posts: DataFrame, model: str, rules: str | None = None) -> DataFrame:
    """One request per non-blank post."""
    name = F.lit(model)
    return posts.where(~is_blank(F.col("message"))).select(
        "channel_id",
        "msg_id",
        name.alias("model"),
        F.when(model_family(name) == "json", F.lit(system_text(rules))).alias("system"),
        build_prompt(F.col("message"), name, rules).alias("input"),
    )
