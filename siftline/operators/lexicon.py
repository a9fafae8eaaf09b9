"""Word lists of the screening brief.

Fixed values: the roles, levels, places and phrases the brief names. A term is
a word or phrase; ``*`` at its end also takes inflected forms. Matching folds
case unless the term is marked.
"""

from __future__ import annotations

from typing import NamedTuple


class Term(NamedTuple):
    group: str
    text: str
    case_sensitive: bool = False


# Groups.
ROLE_OTHER = "role_other"
ROLE_ENGINEER = "role_engineer"
GO = "go"
OTHER_LANGUAGE = "other_language"
BONUS = "bonus"
SENIOR = "senior"
YEARS = "years"
JUNIOR = "junior"
OTHER_CITY = "other_city"
ASTANA = "astana"
REMOTE = "remote"
KAZAKHSTAN = "kazakhstan"
NOT_VACANCY = "not_vacancy"

GROUPS = (
    ROLE_OTHER, ROLE_ENGINEER, GO, OTHER_LANGUAGE, BONUS, SENIOR, YEARS, JUNIOR,
    OTHER_CITY, ASTANA, REMOTE, KAZAKHSTAN, NOT_VACANCY,
)

_WORDS = {
    ROLE_OTHER: (
        "аналитик*", "business analyst", "data analyst", "редактор*", "ux writer",
        "copywriter", "копирайтер*", "журналист*", "designer", "дизайнер*",
        "manager", "менеджер*", "scrum master", "hr", "recruiter", "support",
        "рекрутер*", "sourcer", "sales", "маркетолог*", "smm",
        "accountant", "бухгалтер*", "lawyer", "юрист*", "финансист*",
        "customer service", "call centre", "оператор*", "manual qa", "qa manual",
        "ручной тестировщик", "тестировщик ручной", "teacher", "tutor", "преподавател*",
    ),
    ROLE_ENGINEER: (
        "developer", "developers", "engineer", "engineers", "programmer", "backend",
        "бэкенд*", "бекенд*", "разработчик*", "программист*", "инженер*",
    ),
    OTHER_LANGUAGE: (
        "python", "java", "javascript", "js", "typescript", "ts", "php", "c#", "ruby",
        "rust", "kotlin", "swift", "scala", "elixir", "1c", "1с",
    ),
    BONUS: ("будет плюсом", "nice to have", "as a bonus"),
    SENIOR: (
        "middle", "мидл*", "senior", "сеньор*", "lead", "team lead", "head",
        "principal", "staff",
    ),
    JUNIOR: (
        "intern", "стажёр*", "стажер*", "стажировк*", "trainee", "junior", "джуниор*",
        "младш*", "без опыта", "no experience required", "students welcome",
        "entry level", "middle and below",
    ),
    OTHER_CITY: (
        "алматы", "almaty", "шымкент*", "москв*", "спб", "bishkek", "ташкент*",
    ),
    ASTANA: ("astana", "астан*"),
    REMOTE: ("remote", "удалённ*", "удаленн*", "удалёнк*", "удаленк*", "worldwide"),
    KAZAKHSTAN: ("kazakhstan", "казахстан*"),
    NOT_VACANCY: (
        "news", "новост*", "meme", "мем", "мемы", "article", "статья", "opinion",
        "мнение", "event", "meetup", "митап*", "referral",
    ),
}

# Years of experience that are too many, and how posts put them; of a span the first number counts.
YEARS_FROM = 3
YEARS_WORDS = (" years ", " лет ")
YEARS_FORMS = (
    r" ([0-9]+)\+ (?:years|лет)(?= )",
    r" ([0-9]+) (?:[0-9]+\+? )?years of (?:commercial|experience)(?= )",
    r" от ([0-9]+) лет(?= )",
    r" (?:minimum|min|at least) ([0-9]+) years(?= )",
)

DEFAULT_LEXICON = (
    *(Term(group, word) for group, words in _WORDS.items() for word in words),
    Term(YEARS, "от трёх лет"),
    Term(YEARS, "от трех лет"),
    Term(GO, "Go", True),
    Term(GO, "golang"),
)
